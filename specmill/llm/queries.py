"""The registered queries of this package: each operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specmill.llm import ann, chat, decontaminate, htmltext, langid, merkle, mixing, neardup, pii, setjoin, toxicity, urlfilter, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contamination(docs, items)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    settings = neardup.SketchSettings(words=3, similarity=85)
    return neardup.near_duplicates(table(spark, folder, "documents"), settings=settings)


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extracted(table(spark, folder, "pages"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urlfilter.judged_urls(table(spark, folder, "pages"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(table(spark, folder, "embeddings"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identified(table(spark, folder, "documents"))


def op9_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymised(table(spark, folder, "documents").select("doc_id", "text"))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repaired(table(spark, folder, "conversations"))


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_manifest(table(spark, folder, "documents"))


def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_vectors(table(spark, folder, "embeddings"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_toxicity": op2_toxicity,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_html_text": op4_html_text,
        "op5_url_filter": op5_url_filter,
        "op6_mix_sources": op6_mix_sources,
        "op7_neighbours": op7_neighbours,
        "op8_language_id": op8_language_id,
        "op9_pseudonyms": op9_pseudonyms,
        "op10_chat": op10_chat,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_whitening": op13_whitening,
    }
