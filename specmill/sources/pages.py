"""Page tables: documents cut into pages, and documents without usable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions.once import evaluated_once
from specmill.functions.text import base_name, strip

MIN_CHARS = 20


def page_array(text: Column, separator: str) -> Column:
    """The stripped pages of a text; an empty page keeps its place."""
    return F.transform(F.split(text, _literal(separator)), strip)


def _literal(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def paginate(documents: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """Replaces the ``text`` column by ``pages ARRAY<STRING>``. No shuffle; each text is cut once."""
    kept = [c for c in documents.columns if c != text]
    return evaluated_once(documents, kept, {"pages": page_array(F.col(text), separator)})


def page_rows(documents: DataFrame) -> DataFrame:
    """Long form of a table with ``pages``: one row per page with ``page_no`` from 1."""
    kept = [c for c in documents.columns if c != "pages"]
    return documents.select(*kept, F.posexplode("pages").alias("_pos", "text")).select(
        *kept, (F.col("_pos") + 1).alias("page_no"), "text"
    )


def text_length(pages: Column) -> Column:
    """Characters over all pages."""
    return F.aggregate(pages, F.lit(0), lambda total, page: total + F.length(page))


def no_text_reason(source_file: Column, pages: Column, min_chars: int = MIN_CHARS) -> Column:
    """Why a document is skipped, or null when it holds enough text."""
    total = text_length(pages)
    # Fixed format.
    reason = F.format_string(
        "%s: only %d characters of text across %d page(s). Is this a scanned image?",
        base_name(source_file),
        total,
        F.size(pages),
    )
    return F.when(total < min_chars, reason)


def without_text(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Adds ``skip_reason`` (null for readable documents). No shuffle."""
    return documents.withColumn(
        "skip_reason", no_text_reason(F.col("source_file"), F.col("pages"), min_chars)
    )
