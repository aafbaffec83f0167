"""Page selection: keyword score, qualification, ranking, character budget, excerpt.

The array form keeps a document in its row, so nothing is shuffled and copies
of one document cost nothing extra. The long form serves tables that already hold one row
per page; it needs one shuffle by document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # Without it, long keyword lists are searched word by word as well.
    ahocorasick = None

# Fixed values.
KEYWORDS = (
    "technical data",
    "technical specifications",
    "specifications",
    "electrical data",
    "operating voltage",
    "supply voltage",
    "operating temperature",
    "ambient temperature",
    "measuring range",
    "output",
    "protection",
    "response time",
    "weight",
    "housing",
)
MIN_SCORE = 2
MAX_CHARS = 12_000
FALLBACK_PAGES = 3

# From so many keywords on, one pass over a page with an automaton of all of them costs less than a search for each.
AUTOMATON_FROM = 32


def keyword_score(text: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """How many of the keywords occur in ``text``, ignoring case."""
    if _many(keywords):
        return _automaton_score(keywords)(F.lower(text))
    return _score(F.lower(text), keywords)


def _many(keywords: Sequence[str]) -> bool:
    return ahocorasick is not None and len(keywords) >= AUTOMATON_FROM


def _score(lowered: Column, keywords: Sequence[str]) -> Column:
    score = F.lit(0)
    for keyword in keywords:
        score = score + F.contains(lowered, F.lit(keyword.lower())).cast("int")
    return score


class KeywordCounter:
    """How many of the keywords occur in a lower-cased text; a repeated keyword counts each time, the empty one always.

    Its automaton is built where it is first used, once per task.
    """

    def __init__(self, keywords: Sequence[str]):
        self.times: dict[str, int] = {}
        for keyword in keywords:
            self.times[keyword.lower()] = self.times.get(keyword.lower(), 0) + 1
        self.always = self.times.pop("", 0)
        self.automaton = None

    def __call__(self, text: str | None) -> int | None:
        if text is None or not self.times:
            return None if text is None else self.always
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for keyword, times in self.times.items():
                self.automaton.add_word(keyword, (keyword, times))
            self.automaton.make_automaton()
        found = {match for _, match in self.automaton.iter(text)}
        return self.always + sum(times for _, times in found)


def _automaton_score(keywords: Sequence[str]):
    """Text column to score, in Arrow batches."""
    given = tuple(keywords)

    @F.pandas_udf("int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = KeywordCounter(given)
        for texts in batches:
            yield pd.Series([count(text) for text in texts], dtype="Int32")

    return score


def _automaton_scores(keywords: Sequence[str]):
    """Column of arrays of texts to arrays of scores, in Arrow batches."""
    given = tuple(keywords)

    @F.pandas_udf("array<int>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = KeywordCounter(given)
        for rows in batches:
            yield pd.Series([None if row is None else [count(text) for text in row] for row in rows], dtype=object)

    return scores


def excerpt(
    pages: Column,
    keywords: Sequence[str] = KEYWORDS,
    min_score: int = MIN_SCORE,
    max_chars: int = MAX_CHARS,
    fallback_pages: int = FALLBACK_PAGES,
) -> Column:
    """The excerpt of a ``pages`` array column as one expression.

    Each page is lower-cased and scored once; ranking sorts (-score, page number) pairs
    without their texts; the budget is a fold that stops taking pages once it is spent.
    """
    _check_cap(max_chars)
    lowered = F.transform(pages, F.lower)
    if _many(keywords):
        scores = _automaton_scores(keywords)(lowered)
    else:
        scores = F.transform(lowered, lambda low: _score(low, keywords))
    scored = F.transform(scores, lambda score, i: F.struct((-score).alias("worse"), (i + 1).alias("page_no")))
    # The one-element array binds the scores to a name, so they are not worked out per use.
    return F.transform(
        F.array(scored), lambda rows: _excerpt_of(pages, rows, min_score, max_chars, fallback_pages)
    )[0]


def _excerpt_of(
    pages: Column, scored: Column, min_score: int, max_chars: int, fallback_pages: int
) -> Column:
    fits = F.exists(scored, lambda p: p["worse"] <= -min_score)
    fitting = F.array_sort(F.filter(scored, lambda p: p["worse"] <= -min_score))
    ranked = F.when(fits, fitting).otherwise(F.slice(scored, 1, fallback_pages))
    start = F.struct(
        F.lit(max_chars).alias("left"),
        F.array().cast("array<struct<page_no:int,text:string>>").alias("kept"),
    )

    def take(state: Column, page: Column) -> Column:
        whole = F.element_at(pages, page["page_no"])
        text = F.substring(whole, F.lit(1), state["left"])
        taken = F.struct(
            (state["left"] - F.least(F.length(whole), state["left"])).alias("left"),
            F.array_append(state["kept"], F.struct(page["page_no"], text.alias("text"))).alias("kept"),
        )
        return F.when((state["left"] > 0) & (F.length(whole) > 0), taken).otherwise(state)

    return joined_pages(F.aggregate(ranked, start, take)["kept"])


def joined_pages(kept: Column) -> Column:
    """Chosen pages in document order, each under its marker. Fixed format."""
    return F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda p: F.concat(
                F.lit("--- page "), p["page_no"].cast("string"), F.lit(" ---\n"), p["text"]
            ),
        ),
        "\n\n",
    )


def with_excerpt(documents: DataFrame, **options) -> DataFrame:
    """Adds ``excerpt`` to a table with a ``pages`` array; no shuffle."""
    return documents.withColumn("excerpt", F.coalesce(excerpt(F.col("pages"), **options), F.lit("")))


def chosen_pages(
    pages: DataFrame,
    document: str,
    keywords: Sequence[str] = KEYWORDS,
    min_score: int = MIN_SCORE,
    max_chars: int = MAX_CHARS,
    fallback_pages: int = FALLBACK_PAGES,
) -> DataFrame:
    """Long form: the pages that enter the excerpt, cut at the cap.

    Input (document, page_no, text) with unique page numbers per document, so the windows
    hold one document's pages. Both windows share one shuffle by document.
    """
    _check_cap(max_chars)
    whole = Window.partitionBy(document)
    scored = pages.withColumn("score", keyword_score(F.col("text"), keywords))
    # Neither a page with a score nor one to fall back on: it cannot enter, and is dropped before the shuffle.
    scored = scored.where((F.col("score") >= min_score) | (F.col("page_no") <= fallback_pages))
    scored = scored.withColumn("_any", F.max("score").over(whole) >= min_score)
    eligible = scored.where(
        F.when(F.col("_any"), F.col("score") >= min_score).otherwise(
            F.col("page_no") <= fallback_pages
        )
    ).withColumn("_rank_score", F.when(F.col("_any"), F.col("score")).otherwise(0))
    before = (
        Window.partitionBy(document)
        .orderBy(F.desc("_rank_score"), "page_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    used = eligible.withColumn("_used", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    return (
        used.where((F.col("_used") < max_chars) & (F.length("text") > 0))
        .withColumn(
            "text",
            F.substring("text", F.lit(1), (F.lit(max_chars) - F.col("_used")).cast("int")),
        )
        .drop("_any", "_rank_score", "_used")
    )


def assembled(chosen: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """Long form: one ``excerpt`` per row of ``documents``; empty when nothing was chosen."""
    texts = chosen.groupBy(document).agg(
        joined_pages(F.collect_list(F.struct(F.col("page_no").cast("int").alias("page_no"), "text"))).alias(
            "excerpt"
        )
    )
    return documents.join(texts, document, "left").withColumn(
        "excerpt", F.coalesce("excerpt", F.lit(""))
    )


def _check_cap(max_chars: int) -> None:
    if max_chars < 1:
        raise ValueError("max_chars must be at least 1")
