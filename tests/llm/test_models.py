import random
import zlib

import numpy as np

from specmill.llm.langid import NetSettings, identified, window_matrix
from specmill.llm.toxicity import ToxicSettings, toxic_scores

TONGUES = {"aa": ["kat", "lom", "rup", "kel"], "bb": ["schi", "wöte", "gun", "fra"], "cc": ["ñelo", "dos", "ique", "zar"]}


def words(rng, tongue, count):
    return " ".join("".join(rng.choice(TONGUES[tongue]) for _ in range(rng.randrange(1, 4))) for _ in range(count))


def fold(key, folds):
    return zlib.crc32(str(key).encode()) % folds


def test_language(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, t := rng.choice(list(TONGUES)), rng.choice([2, 30, 200])), t) for i in range(240)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "aa"), (1003, words(rng, "bb", 20), None), (None, words(rng, "cc", 9), "cc"),
           rows[3], (1004, words(rng, "aa", 20_000), "cc")]
    docs = spark.createDataFrame([(i, t, g, "s") for i, t, g in rows + odd], "doc_id bigint, text string, lang string, score string")
    settings = NetSettings(sample=80, epochs=10)
    got = identified(docs, settings=settings).collect()
    assert len(got) == len(rows) + len(odd)
    named = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is None or fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    tested = [(named[i].lang_pred == t) for i, _, t in rows if fold(i, 4) == 2]
    assert len(tested) > 30 and np.mean(tested) >= 0.95
    assert [(named[i].lang_pred, named[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert (named[1003].lang_pred, named[None].lang_pred, named[1004].lang_pred) == ("bb", "cc", "aa")
    assert {tuple(r) for r in got} == {tuple(r) for r in identified(docs.repartition(5), settings=settings).collect()}
    assert identified(docs.where("false")).collect() == []
    assert {r.lang_pred for r in identified(docs.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_windows():
    matrix, counts = window_matrix([b"abcde", b"", b"abcd"], 4)
    assert counts.tolist() == [2, 1, 1]
    assert matrix.tobytes() == b"abcde\0\0\0\0\0\0\0abcd"


def test_toxicity(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    insults = ["zwark", "gribvox", "snodfuk", "pyxwit", "vlogjunk"]
    rows, labels = [], []
    for i in range(1600):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120]))]
        bad = i % 5 == 0
        if bad:
            for _ in range(5):
                text[rng.randrange(len(text))] = rng.choice(insults)
        rows.append((i, " ".join(text), "labels of no use"))
        if i % 4 < 3:
            labels.append((i, int(bad)))
    rows += [(5000, None, ""), (5001, "", ""), (5002, "!", ""), (None, "zwark gribvox", ""), rows[0], (5003, "zwark " * 30_000, "")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, toxic string, score double")
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), labels[0], (9999, 1)], "doc_id bigint, toxic int")
    settings = ToxicSettings(base=8192)
    got = toxic_scores(docs, marks, settings=settings).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is None or fold(r.doc_id, 3) == 1) for r in got)
    held = [(named[i].predicted, int(i % 5 == 0)) for i in range(1600) if fold(i, 3) == 1]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert sum(p and y for p, y in held) >= 0.9 * sum(y for _, y in held)
    assert named[5003].predicted == 1 and named[5000].score == named[5001].score == named[5002].score < 0.7
    assert {tuple(r) for r in toxic_scores(docs.repartition(5), marks, settings=settings).collect()} == {tuple(r) for r in got}
    assert {r.score for r in toxic_scores(docs, marks.where("false")).collect()} == {0.5}
    assert toxic_scores(docs.where("false"), marks).collect() == []
