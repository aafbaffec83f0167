import hashlib
import random
import re

import pytest

from specmill.llm.common import plain_words
from specmill.llm.decontaminate import SuffixAutomaton, contamination, decontaminated, without_spans

DOCS = "doc_id bigint, text string, n_words string, _spans int"
ITEMS = "item_id bigint, text string, text2 string"


def by_hand(text, items, window=13):
    def split(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    words, hit, names = split(text), set(), set()
    for name, item in items:
        own = split(item)
        size = min(window, len(own))
        for start in range(len(own) - size + 1) if own else []:
            gram = own[start : start + size]
            for at in range(len(words) - size + 1):
                if words[at : at + size] == gram:
                    hit.update(range(at, at + size))
                    names.add(name)
    ids = ",".join(sorted(str(n) for n in names if n is not None))
    return len(words), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture
def items():
    rng = random.Random(5)
    words = ["a", "b", "c", "Dé", "e9"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 13, 14, 30])))) for i in range(12)]
    return [*rows, (20, ""), (21, None), (22, "!!"), (3, "A b, c a b"), (30, rows[5][1])]


def docs_of(items):
    rng = random.Random(6)
    pool = ["a", "b", "c", "dÉ", "e9", "x", "y"]
    docs = []
    for i in range(60):
        words = [rng.choice(pool) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            words[rng.randrange(len(words) + 1) :] += (items[rng.randrange(12)][1] or "").split()
        docs.append((i, (" " if i % 2 else "--").join(words)))
    return [*docs, (100, None), (101, ""), (102, "... \n"), (0, docs[0][1]), (None, docs[3][1]), (104, "a b " * 30_000)]


@pytest.mark.parametrize("block", [400_000, 40])
def test_against_search_of_every_window(spark, items, block):
    rows = docs_of(items)
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    found = contamination(docs, bench, automaton_words=block).collect()
    got = sorted((tuple(r) for r in found if r.doc_id != 104), key=repr)
    want = sorted(((i, *by_hand(t, items)) for i, t in rows if i != 104), key=repr)
    assert got == want
    assert [r.n_words for r in found if r.doc_id == 104] == [60_000]


def test_no_short_items(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, passage[:-20])], "doc_id int, text string")
    bench = spark.createDataFrame([("q", passage)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in contamination(docs, bench).collect()}
    assert got == {1: (20, True), 2: (15, True)}


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert contamination(none, bench).collect() == []
    assert contamination(some, bench).first()[:4] == (1, 2, 0, 0)


def test_drop_and_cut(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    long = " ".join(f"v{i}" for i in range(400))
    rows = [(1, passage, "s"), (2, f"{long} ({passage}). End", "s"), (3, long, None), (4, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    bench = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    kept = {r.doc_id: r.text for r in decontaminated(docs, bench).collect()}
    assert kept == {2: rows[1][1], 3: long, 4: None}
    cut = {r.doc_id: r.text for r in decontaminated(docs, bench, cut=True).collect()}
    assert cut == {2: f"{long} (). End", 3: long, 4: None}


def test_spans_in_text():
    assert without_spans("One two, three four", [1, 3]) == "One  four"
    assert without_spans(None, [0, 1]) is None


def test_longest_matches():
    items = [b"a b c d".split(), b"b c e".split(), b"a b c d".split()]
    machine = SuffixAutomaton(items, 3)
    spans, found = machine.scan(plain_words(b"x a b c e b c d"))
    assert (spans, found) == ([(1, 8)], {0, 1, 2})
