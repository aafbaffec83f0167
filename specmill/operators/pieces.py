"""Search for a part of a text among many records, through a table of three-character pieces.

``contains`` looks at every record. Here a table, sorted by piece, says which records hold which pieces; a search reads the ranges of its own
pieces, keeps the records that hold all of them, and only these are read and checked exactly. A search that is shorter than a piece
has none and goes through all records as before: rows are the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions.text import strip

SIZE = 3
# Up to so many records the ids themselves reach the scan of the records; beyond, they are joined.
FEW = 1000


def folded(text: Column) -> Column:
    """The form in which texts are compared: lower case, unknown texts empty."""
    return F.lower(F.coalesce(text, F.lit("")))


def pieces_of(text: Column, size: int = SIZE) -> Column:
    """The distinct pieces of ``size`` characters of a text, none for a shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def piece_table(records: DataFrame, column: str = "part_number", key: str = "id", size: int = SIZE) -> DataFrame:
    """(piece, key): which records hold which pieces of ``column``; one row per piece of a record.

    Rows are in ranges of (piece, key), so a piece that a third of all records hold fills several
    files, and a file's least and greatest piece tell readers whether to open it. Records with a null key are left out.
    """
    found = records.where(F.col(key).isNotNull()).select(F.explode(pieces_of(folded(F.col(column)), size)).alias("piece"), key)
    return found.repartitionByRange("piece", key).sortWithinPartitions("piece", key)


def searched(
    records: DataFrame,
    pieces: DataFrame,
    search: str,
    column: str = "part_number",
    key: str = "id",
    size: int = SIZE,
    few: int = FEW,
) -> DataFrame:
    """The ``records`` whose ``column`` holds ``search``, ignoring case and blanks around it; all of them for a blank search.

    ``pieces`` is the stored :func:`piece_table` of the same records. ``few`` bounds the ids that pass through the driver; more are joined.
    """
    if not search or search.isspace():
        return records
    # Spark folds the search as it folded the texts.
    wanted = folded(strip(F.lit(search)))
    exact = F.contains(folded(F.col(column)), wanted)
    own = sorted(records.sparkSession.range(1).select(pieces_of(wanted, size).alias("p")).first()["p"])
    if not own:
        return records.where(exact)
    held = pieces.where(F.col("piece").isin(own)).groupBy(key).agg(F.count("*").alias("_held"))
    ids = held.where(F.col("_held") == len(own)).select(key)
    near = [row[key] for row in ids.take(few + 1)]
    if len(near) <= few:
        return records.where(F.col(key).isin(sorted(near)) & exact)
    return records.join(ids, key, "left_semi").where(exact)
