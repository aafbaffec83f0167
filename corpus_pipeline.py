"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmill.llm.common import packed, unpacked
from specmill.llm.decontaminate import decontaminated
from specmill.llm.langid import UNDETERMINED, predicted_languages, trained_net
from specmill.llm.mixing import mixed
from specmill.llm.neardup import near_duplicates
from specmill.llm.pii import pseudonymised
from specmill.session import settled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Below this mean probability a text is not taken for the language it looks most like. Short clean texts may score little
# above an even guess among the four languages, so only what is next to even goes.
LEAST_LANGUAGE_SCORE = 0.3


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without a letter and unclear ones go."""
    net = trained_net(docs, "doc_id", "text", "lang")
    # The network reads a copy of the text: without a letter it is null there, and the row's own stays as it is.
    rows = packed(docs, "text").withColumn("_whole", F.col("_text"))
    judged = predicted_languages(rows, net, text="_whole", carried=("_packed", "_text"))
    clear = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(clear).select(*unpacked(docs.columns, "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies; five-word shingles, similarity 0.8.

    Documents without an id are in no group and stay.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    # A repeated row is a copy of itself: ids and texts are alike, and one stays.
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves, unchanged."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms for personal data and secrets."""
    return pseudonymised(docs, counts=False).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, and the slot that brings it in."""
    return mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("pseudonyms", hide_personal_data),
    ("mix_sources", mix_sources),
]

# Languages come from a network trained here: SQL cannot express the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``.

    Rows with a null id stay through all stages; null texts and texts without a letter go in the first. Of repeated rows
    one stays. An empty table gives no rows. Further columns, whatever their names, go through all stages but the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
