"""Merkle manifest: against a plain model, and odd tables."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from specmill.llm.merkle import MerkleSettings, document_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    return h(*map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def tree(leaves):
    """Root and, per leaf, its siblings as (side, digest); None for a node alone in its run."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            proofs[i].append((other > place, level[other]) if other < len(level) else None)
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [place // 2 for place in at]
    return level[0], proofs


def model(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    root, upper = tree([t[1] for t in trees])
    out = []
    for (own, subroot, proofs), above in zip(trees, upper):
        for row, proof in zip(own, proofs):
            whole = proof + above
            changed = row[0] is not None and crc32(str(row[0]).encode()) % 7 == 0
            digest = leaf(row, int(changed))
            for step in whole:
                digest = h(digest) if step is None else h(digest, step[1]) if step[0] else h(step[1], digest)
            proof_digest = h(*[s[1] for s in whole if s])
            out.append((row[0], leaf(row), subroot, root, proof_digest, digest, digest == root))
    return sorted(out, key=repr)


def rows_of(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", "", None, "z"]
    return [(i, rng.choice(["", "some text", "Ünï中", None]), rng.choice(langs), rng.choice(["a", None]), rng.choice([5, None])) for i in range(n)]


@pytest.mark.parametrize("n, bits", [(1, 2), (2, 2), (37, 1), (150, 2), (150, 10)])
def test_equals_the_plain_model(spark, n, bits):
    rows = rows_of(n, n)
    found = document_manifest(spark.createDataFrame(rows, SCHEMA), settings=MerkleSettings(bits=bits))
    assert sorted(map(tuple, found.collect()), key=repr) == model(rows)


def test_null_keys_ties_repeated_rows_and_other_columns(spark):
    rows = [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (3, "x", "en", "s", 9), (3, "x", "en", "s", 9), (3, "y", "en", "s", 2**63 - 1)]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA + ", _tree string, root int")
    found = document_manifest(docs, settings=MerkleSettings(bits=1))
    assert sorted(map(tuple, found.collect()), key=repr) == model(rows)


def test_empty_table(spark):
    found = document_manifest(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.collect() == []
