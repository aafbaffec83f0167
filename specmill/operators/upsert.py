"""Upsert of a batch into the record table, with the result of applying it row by row.

Row-by-row meaning: a batch row replaces the record that now carries its
``source_hash``; failing that, and if it has a part number, the record with its
manufacturer and part number (the lowest id if several); failing that it becomes a new
record with the next id. A replaced record keeps its id.

How this becomes set logic. Call manufacturer plus part number (or the hash, where there
is no part number) the *identity* of a row. A batch row is a *mover* when the row
before it with the same hash has another identity: only movers can carry a record from
one identity to another. Between two movers touching an identity its set of records
stands still, and its rows follow a closed rule:

* a row whose hash sits on a record that is not the identity's lowest one goes there,
* every other row goes to the lowest record, or creates it.

Identities without movers, which in practice is all of them, are therefore solved
by grouping alone, whatever share of the batch they hold. Identities with movers are
first condensed per stretch between movers, then only the condensed (hash, identity)
pairs of each connected group of identities are replayed in order, streamed through
a sorted partition with the live records as state. Payloads never enter the replay.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.spread import (
    BLOCK_BITS,
    dense_position,
    previous_value,
    running_count,
    spread_left_join,
)
from specmill.operators.components import connected_components
from specmill.session import settled

# Tokens at or above this value stand for records to be created, in creation order.
NEW = 1 << 61


def identity(manufacturer: Column, part_number: Column, source_hash: Column) -> Column:
    """Exact text key: equal for equal (manufacturer, part number), null manufacturers included."""
    maker = F.coalesce(
        F.concat(F.length(manufacturer).cast("string"), F.lit(":"), manufacturer), F.lit("-")
    )
    named = F.concat(F.lit("p|"), maker, F.lit("|"), part_number)
    has_number = part_number.isNotNull() & (part_number != "")
    return F.when(has_number, named).otherwise(F.concat(F.lit("h|"), source_hash))


def _keys(rows: DataFrame, order: str) -> DataFrame:
    return rows.select(
        F.col(order).cast("bigint").alias(order),
        F.col("source_hash").alias("hash"),
        identity(F.col("manufacturer"), F.col("part_number"), F.col("source_hash")).alias("k"),
    )


def targets(current: DataFrame, batch: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(seq, token): the record each batch row lands on.

    A token below ``NEW`` is an existing id; otherwise it is ``NEW`` plus the ``seq`` of
    the row that creates the record. ``current`` has unique hashes, as every table built
    by this operator has; ``batch`` has a unique ``seq`` >= 0.
    """
    have, events = _keys(current, "id"), _keys(batch, "seq")
    # The table is cut down to what the batch can reach before anything is shuffled;
    # a small batch reaches the scan of the table as a broadcast.
    moved = _movers(have.join(events.select("hash").distinct(), "hash", "left_semi"), events, bits)
    reached = have.join(events.select("k").distinct(), "k", "left_semi")
    if moved is None:
        return _grouped_targets(reached, events)
    touched = moved.select("k").union(moved.select(F.col("before").alias("k"))).distinct()
    touched = settled(touched, "touched")
    # An identity may hold much of the batch: its rows are marked lane by lane.
    marked = spread_left_join(events, touched.withColumn("touched", F.lit(True)), "k", F.col("seq"))
    marked = settled(marked, "marked-events")
    still = marked.where("touched IS NULL").drop("touched")
    calm = _grouped_targets(reached.join(touched, "k", "left_anti"), still)
    stormy = _replayed_targets(
        have.join(touched, "k", "left_semi"), marked.where("touched").drop("touched"), moved, bits
    )
    return calm.unionByName(stormy)


def _movers(have: DataFrame, events: DataFrame, bits: int) -> DataFrame | None:
    """(seq, hash, k, before): batch rows whose hash was last seen under another identity."""
    seen = have.select("hash", "k", F.lit(-1).cast("bigint").alias("seq")).unionByName(
        events.select("hash", "k", "seq")
    )
    # Only hashes seen under two identities can have movers; the aggregate combines map-side.
    several = seen.groupBy("hash").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    several = settled(several.where("low <> high").select("hash"), "hashes")
    if several.isEmpty():
        return None
    history = previous_value(seen.join(several, "hash", "left_semi"), "hash", "seq", "k", "before", bits)
    return settled(history.where("seq >= 0 AND before <> k"), "movers")


def _grouped_targets(have: DataFrame, events: DataFrame) -> DataFrame:
    """Targets where no identity has movers: grouping and equi-joins only."""
    lowest = have.groupBy("k").agg(F.min("id").alias("lowest"))
    firsts = events.groupBy("k").agg(F.min("seq").alias("first"))
    home = firsts.join(lowest, "k", "left").select(
        "k", F.coalesce("lowest", F.lit(NEW) + F.col("first")).alias("home")
    )
    # Records below the lowest of their identity keep their hash, so a hash match decides.
    others = (
        have.join(lowest, "k").where(F.col("id") > F.col("lowest")).select("hash", F.col("id").alias("own"))
    )
    placed = spread_left_join(events, home, "k", F.col("seq"))
    placed = spread_left_join(placed, others, "hash", F.col("seq"))
    return placed.select("seq", F.coalesce("own", "home").alias("token"))


def _replayed_targets(have: DataFrame, events: DataFrame, moved: DataFrame, bits: int) -> DataFrame:
    """Targets for identities touched by movers: condense, replay, spread back."""
    condensed_input = events.join(moved.select("seq", "before"), "seq", "left")
    # Stretches: how many movers touched the identity before a row.
    borders = moved.select("seq", "k").union(moved.select("seq", F.col("before").alias("k")))
    lined = condensed_input.select("seq", "hash", "k", "before", F.lit(False).alias("border")).unionByName(
        borders.select(
            "seq", F.lit(None).cast("string").alias("hash"), "k",
            F.lit(None).cast("string").alias("before"), F.lit(True).alias("border"),
        )
    )
    counted = running_count(lined, "k", "seq", F.col("border"), "stretch", bits).where(~F.col("border"))
    # A hash can matter by itself only if it sits on a record, moves, or recurs in a later stretch.
    spans = counted.groupBy("hash").agg(
        F.min("stretch").alias("lo"), F.max("stretch").alias("hi"), F.min("k").alias("k_lo"), F.max("k").alias("k_hi")
    )
    sticky = (
        spans.where("lo <> hi OR k_lo <> k_hi").select("hash")
        .union(have.select("hash")).union(moved.select("hash")).distinct()
    )
    marked = spread_left_join(counted, sticky.withColumn("sticky", F.lit(True)), "hash", F.col("seq"))
    lane = F.when(F.col("before").isNotNull(), F.concat(F.lit("m"), F.col("seq").cast("string"))).when(
        F.col("sticky"), F.concat(F.lit("h"), F.col("hash"))
    ).otherwise("")
    marked = marked.withColumn(
        "slot", F.concat_ws("\u0001", F.col("k"), F.col("stretch").cast("string"), lane)
    )
    marked = settled(marked.select("seq", "hash", "k", "stretch", "before", "slot"), "marked")
    slots = marked.groupBy("slot").agg(
        F.max("seq").alias("at"), F.min("seq").alias("first"), F.max_by("hash", "seq").alias("hash"),
        F.first("k").alias("k"), F.first("stretch").alias("stretch"),
    )
    # The first row of a stretch that is no mover is the one that would create the record.
    opening = marked.where(F.col("before").isNull()).groupBy("k", "stretch").agg(F.min("seq").alias("opening"))
    is_mover = F.element_at(F.split("slot", "\u0001"), -1).startswith("m")
    slots = slots.join(opening, ["k", "stretch"], "left").select(
        "slot", "at", "hash", "k", F.when(is_mover, F.col("first")).otherwise(F.col("opening")).alias("creates")
    )
    component = connected_components(moved.select(F.col("k").alias("a"), F.col("before").alias("b")))
    component = component.select(F.col("node").alias("k"), "component")
    null_text, null_long = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    script = slots.select("at", "hash", "k", "creates", "slot", null_long.alias("id")).unionByName(
        have.select(
            F.lit(-1).cast("bigint").alias("at"), "hash", "k", null_long.alias("creates"),
            null_text.alias("slot"), "id",
        )
    )
    script = spread_left_join(script, component, "k", F.coalesce("slot", "hash"))
    # Ids stay integers in the replay: a null would turn their column into floating point.
    script = script.withColumns({c: F.coalesce(c, F.lit(-1).cast("bigint")) for c in ("creates", "id")})
    script = script.repartition("component").sortWithinPartitions("component", "at", "id")
    landed = settled(script.mapInPandas(_replay, "slot string, token bigint"), "landed")
    return spread_left_join(marked.select("seq", "slot"), landed, "slot", F.col("seq")).select("seq", "token")


def _replay(batches):
    """Replays sorted rows; keeps only the live records of the component at hand."""
    component, by_hash, rows, members = None, {}, {}, {}
    for batch in batches:
        slots, tokens = [], []
        for comp, at, digest, k, creates, slot, known in zip(
            batch["component"], batch["at"], batch["hash"], batch["k"], batch["creates"], batch["slot"], batch["id"]
        ):
            if comp != component:
                component, by_hash, rows, members = comp, {}, {}, {}
            if at < 0:
                token = int(known)
            else:
                token = by_hash.get(digest)
                if token is None:
                    heap = members.get(k, [])
                    while heap and rows[heap[0]][1] != k:
                        heapq.heappop(heap)
                    token = heap[0] if heap else NEW + int(creates)
                slots.append(slot)
                tokens.append(token)
            old = rows.get(token)
            if old is not None and by_hash.get(old[0]) == token:
                del by_hash[old[0]]
            by_hash[digest] = token
            if old is None or old[1] != k:
                heapq.heappush(members.setdefault(k, []), token)
            rows[token] = (digest, k)
        yield pd.DataFrame({"slot": pd.Series(slots, dtype=object), "token": pd.Series(tokens, dtype="int64")})


def upserted(
    current: DataFrame, batch: DataFrame, bits: int = BLOCK_BITS
) -> tuple[DataFrame, DataFrame]:
    """Apply ``batch`` (record columns plus ``seq``) to ``current``.

    Returns the new table and (seq, record_id, created) for every batch row. The keys
    are resolved on narrow columns; the payload of the batch is shuffled once, for the rows
    that win.
    """
    columns = [c for c in current.columns if c != "id"]
    landed = settled(targets(current, batch, bits), "targets")
    winners = landed.groupBy("token").agg(F.max("seq").alias("seq"))
    created = dense_position(
        landed.where(F.col("token") >= NEW).select((F.col("token") - NEW).alias("born")).distinct(),
        "born", "place", bits,
    )
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ids = settled(
        created.select(
            (F.col("born") + NEW).alias("token"), (F.col("place") + top.scalar()).cast("bigint").alias("new_id")
        ),
        "ids",
    )
    final_id = F.coalesce("new_id", "token")
    winners = winners.join(ids, "token", "left").select("seq", final_id.alias("id"))
    filled = batch.withColumn("extracted_at", F.coalesce("extracted_at", F.current_timestamp()))
    replacing = filled.join(winners, "seq").select("id", *columns)
    kept = current.join(winners.select("id"), "id", "left_anti").select("id", *columns)
    placed = spread_left_join(landed, ids, "token", F.col("seq"))
    report = placed.select(
        "seq", final_id.alias("record_id"), (F.col("seq") == F.col("token") - NEW).alias("created")
    )
    return kept.unionByName(replacing), report


def by_id(records: DataFrame, record_id: int) -> DataFrame:
    """The record with one id, or no row."""
    return records.where(F.col("id") == record_id)


def record_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"))
