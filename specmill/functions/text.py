"""Text helpers. All of them are built-in, code-generated Spark expressions.

Spark's ``trim`` only knows U+0020, so blanks are removed with the two-argument
``btrim`` and the full list of Unicode blanks: linear in the text length, where a
``\\s+$`` regex is quadratic on a long run of blanks.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def strip(text: Column) -> Column:
    """``text`` without leading and trailing Unicode blanks."""
    return F.btrim(text, F.lit(BLANKS))


def base_name(path: Column) -> Column:
    """Last part of a slash-separated path."""
    return F.element_at(F.split(path, "/"), -1)


def single_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def shortened(text: Column, limit: int = 40) -> Column:
    """At most ``limit`` characters of ``text``, followed by dots when cut."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("..."))
    )
