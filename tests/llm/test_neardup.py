import random

import numpy as np

from specmill.llm import neardup
from specmill.llm.neardup import SketchSettings, Sketcher, WordHashes, joint_similarity, near_duplicates, shingle_set


def shingles(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not tokens:
        return frozenset()
    size = min(words, len(tokens))
    return frozenset(tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1))


def by_hand(rows, words, similarity):
    sets = [(i, shingles(t, words)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= similarity * len(s | t):
                one, two = root(i), root(j)
                label[max(one, two)] = min(one, two)
    return {(i, len(s), root(i) if s else i) for i, s in sets}


def changed(rng, words, count):
    words = list(words)
    for _ in range(count):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(8)
    rows = []
    for group in range(14):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        for copy in range(rng.randrange(1, 14)):
            rows.append((len(rows), changed(rng, base, rng.choice([0, 0, 1, 2, 4]))))
    rng.shuffle(rows)
    first = rows[0][1]
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "oNE "), (905, "one two"), (906, first.upper()),
            (907, first), (907, first), (None, first), (None, "alone"), (909, "a b c d"), (910, "z " * 20_000)]


def check(spark, rows, words, similarity, **more):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, component_id int, _set string")
    got = near_duplicates(docs, settings=SketchSettings(words=words, similarity=similarity, **more)).collect()
    assert len(got) == len(rows)
    want = by_hand([r for r in rows], words, similarity)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_against_all_pairs(spark):
    check(spark, corpus(), 3, 85)


def test_chains_and_blocks(spark, monkeypatch):
    # Neighbours are alike, ends are not: no hub is near all. Small blocks cut the second look into many groups.
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 200)
    rng = random.Random(2)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[rng.randrange(60)] = f"n{i}"
    rows += [(None, "x"), (None, "x y")]
    check(spark, rows, 3, 85)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(docs).collect() == []


def test_estimate_and_register_agreement():
    settings, known = SketchSettings(words=1, similarity=80), WordHashes()
    sketcher = Sketcher(settings)
    for shared, own in ((400, 50), (400, 200), (100, 400), (30, 3)):
        a = shingle_set(" ".join(f"s{i}" for i in range(shared)).encode() + b" " + " ".join(f"a{i}" for i in range(own)).encode(), 1, known)
        b = shingle_set(" ".join(f"s{i}" for i in range(shared)).encode() + b" " + " ".join(f"b{i}" for i in range(own)).encode(), 1, known)
        true = shared / (shared + 2 * own)
        ra, rb = sketcher.registers(a), sketcher.registers(b)
        found = joint_similarity(ra[None], rb[None], np.array([float(len(a))]), np.array([float(len(b))]), settings.base)
        assert abs(found[0] - true) < 0.13
        assert abs((ra == rb).mean() - true) < 0.13
        # Registers of a union are the larger ones.
        assert (sketcher.registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()


def test_bands_catch_the_limit():
    for limit in (70, 80, 85, 95):
        s = SketchSettings(similarity=limit)
        assert (1 - (limit / 100) ** s.rows) ** s.bands <= s.miss
