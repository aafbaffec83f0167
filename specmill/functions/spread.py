"""Shuffle helpers for keys that may hold a large share of all rows.

None of them caps, samples or drops rows, and none of them puts all rows of a key
into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key that may meet in one window: unique sequence numbers are cut into
# blocks of this many values.
BLOCK_BITS = 20
LANES = 64


def is_small(rows: DataFrame) -> bool:
    """Whether Spark's estimate of the size of ``rows`` is within ``spark.sql.autoBroadcastJoinThreshold``.

    Estimates are upper bounds for tables read from files, filtered, projected or aggregated, so a large side is never taken for a small one there.
    """
    limit = rows._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def spread_left_join(
    left: DataFrame, right: DataFrame, key: str, by: Column, lanes: int | None = None
) -> DataFrame:
    """``left`` left-joined to ``right`` (unique in ``key``), hot keys spread over lanes.

    Each left row gets a lane from ``by``. The right row of a key is first handed to
    the lanes that key really uses (at most ``lanes``, found by a distinct with map-side
    combine), then both sides meet on (key, lane). A key with a third of all rows
    ends in ``lanes`` tasks; a rare key is copied as often as it has rows at most. There are as many
    lanes as shuffle partitions if not given: a hot key gets as many tasks as the session has.

    A right side below Spark's own broadcast limit needs none of this: Spark sends it to every task, and no
    left row moves, whatever its key.
    """
    if is_small(right):
        return left.join(right, key, "left")
    lanes = lanes or max(LANES, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = left.withColumn("_lane", F.pmod(F.xxhash64(by), F.lit(lanes)))
    used = marked.select(key, "_lane").where(F.col(key).isNotNull()).distinct()
    handed = used.join(right, key)
    return marked.join(handed, [key, "_lane"], "left").drop("_lane")


def block_of(seq: Column, bits: int = BLOCK_BITS) -> Column:
    """Block number of a non-negative sequence number."""
    return F.shiftright(seq.cast("bigint"), bits)


def running_count(
    rows: DataFrame, key: str, seq: str, flag: Column, out: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Adds ``out``: how many flagged rows of the key come strictly before the row.

    ``seq`` is unique per key up to ties between flagged rows and others; the
    window runs inside one block of sequence numbers, and block totals are carried over
    in a second, much smaller window.
    """
    cut = rows.withColumn("_block", block_of(F.col(seq), bits)).withColumn(
        "_flag", F.when(flag, 1).otherwise(0).cast("bigint")
    )
    inside = Window.partitionBy(key, "_block").orderBy(seq).rangeBetween(
        Window.unboundedPreceding, -1
    )
    totals = cut.groupBy(key, "_block").agg(F.sum("_flag").alias("_total"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        key, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried")
    )
    return (
        cut.withColumn("_inside", F.coalesce(F.sum("_flag").over(inside), F.lit(0)))
        .join(carried, [key, "_block"])
        .withColumn(out, F.col("_inside") + F.col("_carried"))
        .drop("_block", "_flag", "_inside", "_carried")
    )


def previous_value(
    rows: DataFrame, key: str, seq: str, value: str, out: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Adds ``out``: ``value`` of the key's row just before this one, null for the first."""
    cut = rows.withColumn("_block", block_of(F.col(seq), bits))
    inside = Window.partitionBy(key, "_block").orderBy(seq)
    ends = cut.groupBy(key, "_block").agg(F.max_by(value, seq).alias("_end"))
    carried = ends.select(
        key, "_block", F.lag("_end").over(Window.partitionBy(key).orderBy("_block")).alias("_before")
    )
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .withColumn("_lag", F.lag(value).over(inside))
        .join(carried, [key, "_block"])
        .withColumn(out, F.when(F.col("_rank") == 1, F.col("_before")).otherwise(F.col("_lag")))
        .drop("_block", "_rank", "_lag", "_before")
    )


def dense_position(rows: DataFrame, seq: str, out: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Adds ``out``: 1-based position of each row in the order of a unique ``seq`` >= 0.

    Two levels of blocks instead of one unpartitioned window: a block holds at most
    ``2**bits`` rows because ``seq`` is unique, and so does a block of blocks.
    """
    cut = rows.withColumn("_block", block_of(F.col(seq), bits)).withColumn(
        "_upper", block_of(F.col(seq), 2 * bits)
    )
    sizes = cut.groupBy("_upper", "_block").agg(F.count("*").alias("_size"))
    tops = sizes.groupBy("_upper").agg(F.sum("_size").alias("_top"))
    # At most max(seq) / 2**(2 * bits) rows, so the unpartitioned window is tiny.
    before_top = Window.orderBy("_upper").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        "_upper", F.coalesce(F.sum("_top").over(before_top), F.lit(0)).alias("_outer")
    )
    before = Window.partitionBy("_upper").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sizes.withColumn("_inner", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .join(tops, "_upper")
        .select("_block", (F.col("_inner") + F.col("_outer")).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(seq))
    return (
        cut.withColumn("_rank", rank)
        .join(offsets, "_block")
        .withColumn(out, F.col("_rank") + F.col("_offset"))
        .drop("_block", "_upper", "_rank", "_offset")
    )
