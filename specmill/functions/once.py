"""Keeping expensive columns from being evaluated again by later filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(rows: DataFrame, kept: list[str], columns: dict[str, Column]) -> DataFrame:
    """``rows.select(*kept, columns)`` whose ``columns`` no later predicate is folded into.

    Catalyst pushes a filter below a projection by repeating the projected expressions in
    it. Through several layers of parsing and checks that multiplies the work and the plan.
    The columns come out of ``inline`` over a one-element array instead: filters on ``kept``
    still reach the scan, filters on ``columns`` run on the finished values. No shuffle.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    # The struct gets its own projection: inside the generator it would run interpreted.
    return rows.select(*kept, row.alias("_row")).select(*kept, F.inline(F.array("_row")))
