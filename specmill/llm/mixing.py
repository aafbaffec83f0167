"""Mixing sources to target weights: a low-discrepancy schedule over equal-token blocks.

Slot ``j`` of the schedule takes the van der Corput point of ``j`` (its bits, reversed) through the
cumulative weights of the sources; its rank among the slots of its source says which block of
the source's shuffled token stream it takes, going round when the stream is used up. Everything
is DataFrame work: no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmill.functions.spread import running_count
from specmill.session import settled

# Points are exact integers of so many bits; a schedule has fewer slots than 2**POINT_BITS.
POINT_BITS = 40
STREAM_BUCKETS = 4096


def token_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One narrow row per document: id, source with its null flag, size, and its place in the shuffle."""
    order = F.xxhash64(F.col(key), F.lit(20261))
    return docs.select(
        F.col(key).alias("_id"),
        F.col(source).isNull().alias("_none"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        token_count(F.col(text)).alias("size"),
        order.alias("_order"),
        F.pmod(F.shiftright(order, 40), F.lit(STREAM_BUCKETS)).cast("int").alias("_bucket"),
    )


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(_none, _source, source_size, weight, target): each source's words in the mix.

    ``sizes`` has one row per source. Sources stand in code point order, null last, and repeat ``weights``. Targets are
    proportional to the weights up to ``cap`` times the source's size; the excess is shared
    again by weight until none is above. That fixed point is one water level: sources are sorted by
    the level at which they fill, and running sums give the level that holds for the rest.
    """
    everything = Window.orderBy("_none", "_source")
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int"),
        ),
    ).withColumn("_cap", F.col("source_size") * F.lit(cap))
    filling = Window.orderBy(F.col("_cap") / F.col("weight"), "_none", "_source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("_total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("_filled", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_filled")) / F.col("_weight_left"))
        # The first source that the level of the rest does not fill fixes that level.
        .withColumn("_open", F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level")))
    )
    return level.withColumn(
        "target",
        F.least(F.col("_cap"), F.coalesce(F.max("_open").over(whole) * F.col("weight"), F.col("_cap"))),
    ).select("_none", "_source", "source_size", "weight", "target")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, _none, _source): the source of every slot, in van der Corput order.

    There are floor(sum of targets / block) slots. The cumulative weights are cut into intervals of
    the points; slots look their interval up through cells of equal width, so no slot meets every source.
    """
    spark = targets.sparkSession
    total = targets.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    slots = int(total // block)
    running = Window.orderBy("_none", "_source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell_bits = POINT_BITS - 9
    scale = F.lit(float(1 << POINT_BITS) / (total or 1.0))
    # An end is computed once and is the next source's beginning: the intervals have no gaps.
    ends = (
        targets.where(F.col("target") > 0)
        .withColumn("_high", F.floor(F.sum("target").over(running) * scale))
        .withColumn("_low", F.coalesce(F.lag("_high").over(Window.orderBy("_none", "_source")), F.lit(0)))
        .withColumn("_last", F.lead("_high").over(Window.orderBy("_none", "_source")).isNull())
        .withColumn("_high", F.when(F.col("_last"), F.lit(1 << POINT_BITS)).otherwise(F.col("_high")))
        .where(F.col("_high") > F.col("_low"))
    )
    cells = ends.select(
        "_none",
        "_source",
        "_low",
        "_high",
        F.explode(F.sequence(F.shiftright("_low", cell_bits), F.shiftright(F.col("_high") - 1, cell_bits))).alias(
            "_cell"
        ),
    )
    bits = F.reverse(F.lpad(F.bin("id"), POINT_BITS, "0"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.conv(bits, 2, 10).cast("bigint").alias("_point"))
    return (
        points.withColumn("_cell", F.shiftright("_point", cell_bits))
        .join(cells, "_cell")
        .where((F.col("_point") >= F.col("_low")) & (F.col("_point") < F.col("_high")))
        .select("slot", "_none", "_source")
    )


def scheduled_blocks(targets: DataFrame, block: int) -> DataFrame:
    """(slot, _none, _source, _rank, _block): the block of its source that each slot takes.

    A slot's rank among its source's slots, modulo the blocks of the stream, is its block. The rank is counted in
    two levels, so no task holds all slots of a source.
    """
    slots = settled(schedule(targets, block).withColumn("_key", F.struct("_none", "_source")), "mix-slots")
    ranked = running_count(slots, "_key", "slot", F.lit(True), "_rank", bits=12)
    return ranked.join(targets, ["_none", "_source"]).select(
        "slot", "_none", "_source", "_rank", F.pmod("_rank", blocks_of(block)).alias("_block")
    )


def blocks_of(block: int) -> Column:
    """Blocks of a source's stream; the last one may be short."""
    return F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block)))


def with_closing(scheduled: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """``scheduled`` and the closing slots (``slot`` null) of sources that it leaves short, with ``_words`` each brings.

    Slots go round a source's blocks. They bring whole blocks until the target, rounded down, is reached: the slot that reaches
    it is cut short and later ones bring nothing. A source of fewer slots than that gets closing slots for its next blocks.
    """
    source = ["_none", "_source"]
    had = scheduled.groupBy(*source).agg((F.max("_rank") + 1).alias("_had"))
    rounds = F.floor(F.floor("target") / F.col("source_size"))
    rest = F.floor("target") - rounds * F.col("source_size")
    wanted = (rounds * blocks_of(block) + F.ceil(rest / F.lit(block))).cast("bigint")
    short = targets.where(F.col("source_size") > 0).join(had, source, "left")
    short = short.withColumns({"_had": F.coalesce("_had", F.lit(0).cast("bigint")), "_wanted": wanted})
    closing = short.where(F.col("_had") < F.col("_wanted")).select(
        F.lit(None).cast("bigint").alias("slot"), *source, F.explode(F.sequence("_had", F.col("_wanted") - 1)).alias("_rank"), "source_size"
    )
    closing = closing.withColumn("_block", F.pmod("_rank", blocks_of(block))).drop("source_size")
    every = scheduled.unionByName(closing).join(targets.select(*source, "source_size", "target"), source)
    size = F.least(F.lit(block).cast("bigint"), F.col("source_size") - F.col("_block") * block)
    start = F.floor(F.col("_rank") / blocks_of(block)) * F.col("source_size") + F.col("_block") * block
    words = F.greatest(F.lit(0).cast("bigint"), F.least(size, F.floor("target") - start))
    return every.select("slot", *source, "_rank", "_block", size.alias("_size"), words.cast("bigint").alias("_words"))


def dealt_blocks(slots: DataFrame) -> DataFrame:
    """(_none, _source, _block, _whole, _part, _slot): how often slots bring a block as a whole, how many words one more
    brings of it, and the first slot of all."""
    whole = F.col("_words") == F.col("_size")
    return slots.groupBy("_none", "_source", "_block").agg(
        F.count(F.when(whole, 1)).alias("_whole"),
        F.coalesce(F.sum(F.when(~whole, F.col("_words"))), F.lit(0)).alias("_part"),
        F.min(F.when(F.col("_words") > 0, F.col("slot"))).alias("_slot"),
    )


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 1024,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_word, first_slot), a row per row of ``docs``.

    ``first_word`` is the document's place in its source's shuffled stream, ``first_slot`` the first slot that brings
    words of it into the mix. The slots deal blocks, and ``taken`` counts the document's words in the blocks that they deal;
    closing slots fill up a source that the schedule leaves a few blocks short, and what it is ahead is cut off, so
    a source's words are its target rounded down. Streams are taken in turn, so no document passes ``cap`` times its size.
    ``first_slot`` is null for documents that only closing slots bring, and for those not taken.

    A null text has no words; null sources are one source, placed last; an empty table gives no
    rows; repeated rows are documents of their own. Results depend on ids, sizes and sources only;
    other columns are not read.
    """
    rows = settled(sized(docs, key, text, source), "mix-sizes")
    buckets = settled(rows.groupBy("_none", "_source", "_bucket").agg(F.sum("size").alias("_words")), "mix-buckets")
    targets = settled(
        source_targets(
            buckets.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size")), weights, share, cap
        ),
        "mix-targets",
    )
    carried_over = Window.partitionBy("_none", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        buckets.withColumn("_offset", F.coalesce(F.sum("_words").over(carried_over), F.lit(0)))
        .join(targets, ["_none", "_source"])
        .select("_none", "_source", "_bucket", "_offset", "source_size", F.col("target").cast("double").alias("target"))
    )
    inside = (
        Window.partitionBy("_none", "_source", "_bucket")
        .orderBy("_order", "_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    begin = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = rows.join(offsets, ["_none", "_source", "_bucket"]).withColumn("first_word", begin)
    placed = settled(placed.withColumn("_row", F.monotonically_increasing_id()), "mix-placed")
    dealt = dealt_blocks(with_closing(scheduled_blocks(targets, block), targets, block))
    # Documents without words lie at one place, many at a time: they take no part in the join.
    last = F.col("first_word") + F.col("size") - 1
    pieces = placed.where(F.col("size") > 0).select(
        "_row",
        "_none",
        "_source",
        "first_word",
        "size",
        F.explode(F.sequence(F.floor(F.col("first_word") / block), F.floor(last / block))).alias("_block"),
    )
    start = F.col("_block") * block
    low = F.greatest(F.col("first_word"), start)
    high = F.least(F.col("first_word") + F.col("size"), start + block)
    cut = F.greatest(F.lit(0), F.least(high, start + F.col("_part")) - low)
    words = F.col("_whole") * (high - low) + cut
    brought = pieces.join(dealt, ["_none", "_source", "_block"]).withColumn("_words", words)
    counted = brought.where(F.col("_words") > 0).groupBy("_row").agg(
        F.sum("_words").alias("taken"), F.min("_slot").alias("first_slot")
    )
    return placed.join(counted, "_row", "left").select(
        F.col("_id").alias(key),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        "first_word",
        "first_slot",
    )
