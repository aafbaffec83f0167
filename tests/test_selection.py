"""Page selection: literal cases, and properties of both forms on random documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from specmill.operators import selection
from specmill.operators.selection import KEYWORDS, KeywordCounter, assembled, chosen_pages, keyword_score, with_excerpt
from specmill.sources.pages import page_rows, paginate

COVER = "The Meadow series. Quiet, small and easy to clean."
VALUES = "Technical data\nOperating voltage 9 to 36 V DC\nAmbient temperature -15 to 65 C\nOutput IO-Link\nProtection IP68"
DRAWING = "Dimensions\nDepth 41 mm\nHousing of steel\nWeight 310 g"


def frame(spark, documents):
    return spark.createDataFrame(list(enumerate(documents)), "doc int, pages array<string>")


def both_forms(spark, documents, **options):
    df = frame(spark, documents)
    wide = [r["excerpt"] for r in with_excerpt(df, **options).orderBy("doc").collect()]
    chosen = chosen_pages(page_rows(df), "doc", **options)
    long = [r["excerpt"] for r in assembled(chosen, df.select("doc"), "doc").orderBy("doc").collect()]
    assert wide == long
    return wide


def check_properties(pages, got, keywords, min_score, max_chars, fallback_pages):
    """What an excerpt has to be, whatever way it is made."""
    scores = [sum(k.lower() in p.lower() for k in keywords) for p in pages]
    any_scored = max(scores, default=0) >= min_score
    may = {i for i, s in enumerate(scores) if (s >= min_score if any_scored else i < fallback_pages) and pages[i]}
    parts = dict((int(n) - 1, text) for n, text in re.findall(r"--- page (\d+) ---\n(.*?)(?=\n\n--- page |\Z)", got, re.S))
    assert list(parts) == sorted(parts) and set(parts) <= may
    assert sum(map(len, parts.values())) == min(max_chars, sum(len(pages[i]) for i in may))
    cut = [i for i in parts if parts[i] != pages[i]]
    assert len(cut) <= 1 and all(pages[i].startswith(parts[i]) for i in parts)
    # Nothing left out or cut comes before something kept whole.
    place = {i: (-scores[i] if any_scored else 0, i) for i in may}
    whole = [place[i] for i in parts if i not in cut]
    assert all(place[i] > max(whole, default=(-99, -1)) for i in (may - set(parts)) | set(cut))


def test_specification_pages_in_document_order_under_the_cap(spark):
    pages = [COVER, VALUES, DRAWING]
    wide = both_forms(spark, [pages], max_chars=10_000)[0]
    assert wide == f"--- page 2 ---\n{VALUES}\n\n--- page 3 ---\n{DRAWING}"
    assert both_forms(spark, [pages], max_chars=len(VALUES) - 5)[0] == f"--- page 2 ---\n{VALUES[:-5]}"


def test_fallback_counts_empty_pages_and_empty_documents_are_empty(spark):
    plain = [f"Page {n} says nothing." for n in range(1, 6)]
    got = both_forms(spark, [plain, ["", *plain], []], fallback_pages=2)
    assert got[0] == "--- page 1 ---\nPage 1 says nothing.\n\n--- page 2 ---\nPage 2 says nothing."
    assert got[1] == "--- page 2 ---\nPage 1 says nothing." and got[2] == ""
    with pytest.raises(ValueError):
        with_excerpt(frame(spark, [plain]), max_chars=0)


def test_properties_on_random_documents(spark):
    rng = random.Random(11)
    words = ["alpha", "BETA", "gamma ", "ß", "é日", ""]
    documents = [
        ["".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(0, 9))]
        for _ in range(400)
    ]
    for cap, low in ((1, 1), (13, 2), (40, 1), (10_000, 3)):
        options = {"keywords": ("Alpha", "beta", "gamma", "ß"), "min_score": low, "max_chars": cap, "fallback_pages": 3}
        for pages, got in zip(documents, both_forms(spark, documents, **options)):
            check_properties(pages, got, **options)


def test_default_score_counts_distinct_phrases(spark):
    df = spark.createDataFrame([("TECHNICAL SPECIFICATIONS output Output throughput",), ("",)], "t string")
    assert [r[0] for r in df.select(keyword_score(F.col("t"))).collect()] == [3, 0]
    assert len(KEYWORDS) == 14


def test_no_shuffle_in_the_array_form(spark):
    df = with_excerpt(paginate(spark.range(3).select("id", F.lit("a\nb").alias("text"))))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_many_keywords_count_as_few_do(spark, monkeypatch):
    rng = random.Random(12)
    words = ["alpha", "BETA", "gamma ", "ß", "é日", "İ", "", "a", "lph"]
    documents = [
        [rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choices(words, k=rng.randrange(0, 6))) for _ in range(rng.randrange(0, 7))]
        for _ in range(200)
    ] + [None]
    for keywords in (("Alpha", "ALPHA", "lph", "a", "beta", "ß", "日", "", "amma al"), ("", "")):
        found = []
        for least in (10**9, 1):
            monkeypatch.setattr(selection, "AUTOMATON_FROM", least)
            df = frame(spark, documents)
            wide = with_excerpt(df, keywords=keywords, max_chars=30).orderBy("doc").collect()
            rows = page_rows(df.where("pages IS NOT NULL"))
            long = rows.select("doc", "page_no", keyword_score(F.col("text"), keywords).alias("s")).orderBy("doc", "page_no").collect()
            found.append((wide, long))
        assert found[0] == found[1]


def test_long_keyword_lists_cost_one_pass(spark):
    counter = KeywordCounter([f"word{n} " for n in range(2000)] + ["word7 "])
    assert counter("word7 word8 word7 word9") == 3 and counter("") == 0 and counter(None) is None
    df = spark.createDataFrame([("x word1999 y", 1)], "t string, n int").select(keyword_score(F.col("t"), [f"Word{n}" for n in range(2000)]))
    # word1, word19, word199 and word1999.
    assert df.first()[0] == 4 and "contains" not in df._jdf.queryExecution().executedPlan().toString().lower()
