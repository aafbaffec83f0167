"""Jaccard join: against a comparison of all pairs, and odd tables."""

import random

import numpy as np
import pytest

from specmill.llm.setjoin import JoinSettings, jaccard_components, parities


def grams(text, words=5):
    tokens = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() if text else []
    size = min(words, len(tokens))
    return {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if tokens else set()


def model(rows, similarity=80):
    sets = [(key, grams(text)) for key, text in rows]
    label = {key: key for key, _ in rows if key is not None}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            shared = len(x & y)
            if 100 * shared >= similarity * (len(x) + len(y) - shared):
                one, two = root(a), root(b)
                label[max(one, two)] = min(one, two)
    return sorted(((k, len(s), None if k is None else root(k)) for k, s in sets), key=repr)


def found(spark, rows, settings=JoinSettings()):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, _sid string, _n int")
    return sorted(map(tuple, jaccard_components(docs, settings=settings).collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice("uvwxyz") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed, settings", [(1, JoinSettings()), (2, JoinSettings(rounds=0, tile=3)), (3, JoinSettings(rounds=3, ample=0))])
def test_equals_all_pairs(spark, seed, settings):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(3, 25)):
            words = edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.06]))
            rows.append(words[rng.randrange(3) :])
    for _ in range(30):  # A long common passage with an own part: most pairs are next to the limit.
        rows.append([f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 14))] + passage)
    rng.shuffle(rows)
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    assert found(spark, rows, settings) == model(rows)


def test_exactly_at_the_limit(spark):
    words = [f"w{i}" for i in range(12)]  # Eight 5-grams; ten with two more words: 8 of 10 are shared.
    rows = [(1, " ".join(words)), (2, " ".join(words + ["a", "b"])), (3, " ".join(["x", "y", "z"] + words))]
    assert found(spark, rows) == model(rows)
    assert [r[2] for r in found(spark, rows)] == [1, 1, 3]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [
        (None, "a b c d e f"), (None, None), (7, None), (8, ""), (9, " \t\n"), (10, "One  two"), (4, "one two"),
        (12, "a b c d e f"), (11, "a b c d e f"), (11, "a b c d e f"), (20, long), (21, long + " end"),
    ]
    assert found(spark, rows) == model(rows)
    assert found(spark, []) == []


def test_a_document_with_several_texts_connects_them(spark):
    rows = [(5, "a b c d e f g"), (5, "h i j k l m n"), (6, "a b c d e f g"), (7, "h i j k l m n")]
    assert [r[2] for r in found(spark, rows)] == [5, 5, 5, 5]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for size in (3, 50, 900):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
        y = np.unique(np.concatenate([x[size // 4 :], rng.integers(-(2**63), 2**63 - 1, size // 3)]))
        differ = sum(int(a ^ b).bit_count() for a, b in zip(parities(x).view(np.uint64), parities(y).view(np.uint64)))
        assert differ <= len(np.setxor1d(x, y))
