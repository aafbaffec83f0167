"""Jaccard similarity join on word n-grams by vertical partitioning.

All n-grams have one global order, that of their hashes, which is cut into fragments of equal ranges; a set falls into segments,
one per fragment. Pairs that may be linked (the first n-grams of both sets meet) have their overlaps counted separately in every
fragment, and the counts are summed per pair. A hot text or passage is never turned into all pairs of its documents: copies
are one set, sets are compared with hubs of their n-grams first, and only pairs of sets that are still unconnected follow.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specmill.functions.spread import spread_left_join
from specmill.llm.common import as_bytes, slices
from specmill.llm.neardup import WordHashes, shingle_set
from specmill.operators.components import connected_components
from specmill.session import settled


@dataclass(frozen=True)
class JoinSettings:
    """Sets of ``words``-grams, linked from ``similarity`` hundredths on; the global order has ``2**cut_bits`` fragments.

    The prefix of a set is longer by a share of one ``deeper``-th of it than one common n-gram calls for: then more must be common.
    Hubs are tried ``rounds`` times at most, as long as more than ``ample`` pairs per entry are left; members of one n-gram
    meet in tiles of ``tile``; a hub's pairs are dealt over ``lanes``.
    """

    words: int = 5
    similarity: int = 80
    cut_bits: int = 3
    deeper: int = 20
    rounds: int = 1
    ample: int = 4
    tile: int = 512
    lanes: int = 8

    def most_missing(self, n):
        """What any partner of a set of ``n`` may lack of it, at most."""
        return n * (100 - self.similarity) // 100

    def extra(self, n):
        """How many n-grams the prefixes of two sets of ``n`` share at least, if they are linked and of equal size."""
        return max(1, n // self.deeper)

    def prefix(self, n):
        return min(n, self.most_missing(n) + self.extra(n))


def whole(quotient: Column) -> Column:
    return F.floor(quotient).cast("bigint")


def extra(n: Column, settings: JoinSettings) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), whole(n / settings.deeper))


def needed(n: Column, settings: JoinSettings) -> Column:
    """How many n-grams of its prefix a set of ``n`` shares with that of any partner, at least.

    Two linked sets share ``extra`` of the smaller one, which has ``similarity`` hundredths of the larger at least.
    """
    return extra(F.ceil(n * settings.similarity / F.lit(100)).cast("bigint"), settings)


def reaches(shared: Column, n_x: Column, n_y: Column, settings: JoinSettings) -> Column:
    """100 * shared >= similarity * united, in whole numbers."""
    return shared * (100 + settings.similarity) >= (n_x + n_y) * settings.similarity


def gram_set(data: bytes | None, settings: JoinSettings, known: WordHashes) -> np.ndarray:
    """The n-grams of a text in the global order."""
    return np.sort(shingle_set(data, settings.words, known).view(np.int64))


# 64-bit words of a set's parities.
WORDS = 16


def parities(found: np.ndarray) -> np.ndarray:
    """A bit per class of n-grams: whether the set holds an odd number of them.

    Bits in which two sets differ are at most as many as n-grams that only one of them holds.
    """
    odd = np.bincount(found & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def apart(bits_x: str, bits_y: str) -> Column:
    """In how many parities two sets differ."""
    return sum(F.bit_count(F.col(bits_x)[i].bitwiseXOR(F.col(bits_y)[i])) for i in range(WORDS)).cast("bigint")


def name_of(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))))


def marked_sets(docs: DataFrame, key: str, text: str, settings: JoinSettings) -> DataFrame:
    """(_key, _n, _sid, _first, _bits) per row: size of the set, its 64-bit name (null if empty), its prefix, its parities."""
    kind = docs.schema[key].dataType.simpleString()

    def mark(batches):
        known = WordHashes()
        for rows in batches:
            for batch in slices(rows, "_text"):
                sets = [gram_set(data, settings, known) for data in as_bytes(batch.column("_text"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([name_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([s[: settings.prefix(len(s))] for s in sets], pa.list_(pa.int64())),
                        pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["_key", "_n", "_sid", "_first", "_bits"],
                )

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(mark, f"_key {kind}, _n bigint, _sid bigint, _first array<bigint>, _bits array<bigint>")


def gram_facts(usable: DataFrame) -> DataFrame:
    """(_gram, _held) of n-grams that several prefixes hold, and by how many rows; (_sid, _alone) of sets with others, counted."""
    spread = usable.select("_sid", F.explode("_first").alias("_gram"))
    held = spread.groupBy("_gram").agg(F.min("_sid").alias("_sid"), F.max("_sid").alias("_b"), F.count("*").alias("_held"))
    shared = held.where(F.col("_sid") != F.col("_b")).select("_gram", "_held")
    alone = held.where(F.col("_sid") == F.col("_b")).groupBy("_sid").agg(F.count("*").alias("_alone"))
    return shared.unionByName(alone, allowMissingColumns=True)


def with_partners(sets: DataFrame, usable: DataFrame, facts: DataFrame, settings: JoinSettings) -> DataFrame:
    """(_sid, _n, _rep, _count, _first, _bits) of the ``sets`` that may have a partner.

    Of a prefix ``needed`` n-grams are common with any partner's: a set with fewer shared ones has none. Prefixes come from the
    one row that each set is read from, so no join meets all copies of a text.
    """
    alone = facts.where(F.col("_sid").isNotNull()).select("_sid", "_alone")
    judged = sets.join(alone, "_sid", "left").withColumn("_alone", F.coalesce("_alone", F.lit(0)))
    kept = judged.where(F.col("_p") - F.col("_alone") >= needed(F.col("_n"), settings))
    kept = kept.select("_sid", "_n", "_rep", "_row", (F.col("_p") - F.col("_alone")).alias("_count"))
    return kept.join(usable.select("_row", "_first", "_bits"), "_row").drop("_row")


def prefix_entries(sets: DataFrame, facts: DataFrame, settings: JoinSettings) -> DataFrame:
    """(_gram, _sid, _n, _open): what the sets that may have a partner hold of shared n-grams, common ones left out.

    Of the ``_count`` shared n-grams of a prefix, rare ones first, all but the last ``needed - 1`` are enough to meet every partner.
    ``_open`` is the share of the prefix that no other set holds.
    """
    spread = sets.select("_sid", "_n", "_count", F.size("_first").alias("_p"), F.explode("_first").alias("_gram"))
    found = spread.join(facts.where(F.col("_gram").isNotNull()).select("_gram", "_held"), "_gram")
    rank = F.row_number().over(Window.partitionBy("_sid").orderBy("_held", "_gram"))
    placed = found.withColumn("_rank", rank)
    return placed.where(F.col("_rank") <= F.col("_count") - needed(F.col("_n"), settings) + 1).select(
        "_gram", "_sid", "_n", (1 - F.col("_count") / F.col("_p")).alias("_open")
    )


def segments_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, settings: JoinSettings) -> DataFrame:
    """(_sid, _n, _f, _s): the segments of the sets ``wanted`` (_sid, _rep), from the texts of the documents _rep."""
    edges = np.arange(-(1 << settings.cut_bits - 1), (1 << settings.cut_bits - 1) + 1) << (64 - settings.cut_bits)

    def make(batches):
        known = WordHashes()
        for rows in batches:
            for batch in slices(rows, "_text"):
                out = [[], [], [], []]
                for data in as_bytes(batch.column("_text")):
                    found = gram_set(data, settings, known)
                    ends = [0, *np.searchsorted(found, edges[1:-1]), len(found)]
                    for f, (a, b) in enumerate(zip(ends, ends[1:])):
                        if b > a:
                            for column, value in zip(out, (name_of(found), len(found), f, found[a:b])):
                                column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out[0], pa.int64()),
                        pa.array(out[1], pa.int64()),
                        pa.array(out[2], pa.int32()),
                        pa.array(out[3], pa.list_(pa.int64())),
                    ],
                    names=["_sid", "_n", "_f", "_s"],
                )

    rows = docs.select(F.col(key).alias("_rep"), F.col(text).alias("_text"))
    texts = rows.join(wanted.select("_rep").distinct(), "_rep", "left_semi")
    made = texts.mapInArrow(make, "_sid bigint, _n bigint, _f int, _s array<bigint>")
    # A document may come several times, or with other texts that have no partner.
    return made.join(wanted.select("_sid"), "_sid", "left_semi").dropDuplicates(["_sid", "_f"])


def may_reach(n_x: Column, n_y: Column, bits_x: str, bits_y: str, settings: JoinSettings) -> Column:
    """Whether sizes and parities leave two sets a chance; true for every linked pair."""
    shared = (n_x + n_y - apart(bits_x, bits_y)) / 2
    return alike_in_size(n_x, n_y, settings) & reaches(shared, n_x, n_y, settings)


def likely(pairs: DataFrame, sets: DataFrame, settings: JoinSettings) -> DataFrame:
    """The ``pairs`` (x, y) that sizes and parities leave."""
    wide = pairs.join(sets.withColumnsRenamed({"_sid": "x", "_n": "_nx", "_bits": "_bx"}), "x").join(
        sets.withColumnsRenamed({"_sid": "y", "_n": "_ny", "_bits": "_by"}), "y"
    )
    return wide.where(may_reach(F.col("_nx"), F.col("_ny"), "_bx", "_by", settings)).select("x", "y")


def linked(pairs: DataFrame, segments: DataFrame, settings: JoinSettings) -> DataFrame:
    """The ``pairs`` (x, y) that are linked: partial overlaps per fragment, summed per pair.

    Segments of x travel to those of y; a y of many pairs has lanes, so its fragments spread over many tasks.
    """
    laned = pairs.withColumn("_lane", F.pmod(F.xxhash64("x"), F.lit(settings.lanes)))
    left = laned.join(segments.withColumnsRenamed({"_sid": "x", "_n": "_nx", "_s": "_sx"}), "x")
    right = laned.select("y", "_lane").distinct().join(
        segments.withColumnsRenamed({"_sid": "y", "_n": "_ny", "_s": "_sy"}), "y"
    )
    met = left.join(right, ["y", "_lane", "_f"])
    partial = F.size(F.array_intersect("_sx", "_sy")).cast("bigint")
    overlaps = met.groupBy("x", "y", "_nx", "_ny").agg(F.sum(partial).alias("_shared"))
    return overlaps.where(reaches(F.col("_shared"), F.col("_nx"), F.col("_ny"), settings)).select("x", "y")


def alike_in_size(n_x: Column, n_y: Column, settings: JoinSettings) -> Column:
    return F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * settings.similarity


def star_pairs(entries: DataFrame, score: Column, settings: JoinSettings) -> DataFrame:
    """Every set with the hub, the one of highest ``score``, of each n-gram of its prefix; sets of another component only."""
    hubs = entries.groupBy("_gram").agg(
        F.max(F.struct(score.alias("_score"), F.col("_sid").alias("_hub"), F.col("_n").alias("_nh"), F.col("_comp").alias("_ch"))).alias("_best")
    )
    near = spread_left_join(entries, hubs, "_gram", F.col("_sid"))
    apart = near.where((F.col("_comp") != F.col("_best._ch")) & alike_in_size(F.col("_n"), F.col("_best._nh"), settings))
    return apart.select(F.col("_sid").alias("x"), F.col("_best._hub").alias("y")).distinct()


def open_entries(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries, with components, of the n-grams whose members are not all in one; ``_members`` counts them.

    Without labels every set is its own component.
    """
    if labels is None:
        placed = entries.withColumn("_comp", F.col("_sid"))
    else:
        named = labels.select(F.col("node").alias("_sid"), F.col("component").alias("_known"))
        placed = entries.join(named, "_sid", "left").withColumn("_comp", F.coalesce("_known", "_sid")).drop("_known")
    mixed = placed.groupBy("_gram").agg(
        F.min("_comp").alias("_low"), F.max("_comp").alias("_high"), F.count("*").alias("_members")
    )
    mixed = mixed.where(F.col("_low") != F.col("_high")).select("_gram", "_members")
    return spread_left_join(placed, mixed, "_gram", F.col("_sid")).where(F.col("_members").isNotNull())


def pairs_left(entries: DataFrame) -> int:
    """How many pairs of different components the n-grams of ``entries`` hold, pairs of several n-grams several times."""
    comps = entries.groupBy("_gram", "_comp").agg(F.count("*").cast("decimal(38,0)").alias("_c"))
    grams = comps.groupBy("_gram").agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    return int(grams.agg(F.sum((F.col("_s") * F.col("_s") - F.col("_q")) / 2)).first()[0] or 0)


def rest_pairs(entries: DataFrame, sets: DataFrame, settings: JoinSettings) -> DataFrame:
    """The pairs of different components that share an n-gram of both prefixes, and that sizes and parities leave.

    The members of an n-gram meet tile by tile, so a common one is many small joins; other pairs end inside the join.
    """
    tiles = F.ceil(F.col("_members") / F.lit(settings.tile)).cast("int")
    own = entries.join(sets.select("_sid", "_bits"), "_sid").withColumn("_tiles", tiles)
    own = own.withColumn("_t", F.pmod(F.xxhash64("_sid"), F.col("_tiles")).cast("int"))
    columns = ["_gram", "_sid", "_n", "_comp", "_bits"]
    a = own.select(*columns, F.col("_t").alias("_i"), F.explode(F.sequence(F.col("_t"), F.col("_tiles") - 1)).alias("_j"))
    b = own.select(*columns, F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("_i"), F.col("_t").alias("_j"))
    b = b.withColumnsRenamed({c: f"{c}2" for c in columns[1:]})
    met = a.join(b, ["_gram", "_i", "_j"]).where(
        (F.col("_comp") != F.col("_comp2"))
        & ((F.col("_i") != F.col("_j")) | (F.col("_sid") < F.col("_sid2")))
        & may_reach(F.col("_n"), F.col("_n2"), "_bits", "_bits2", settings)
    )
    return met.select(F.least("_sid", "_sid2").alias("x"), F.greatest("_sid", "_sid2").alias("y")).distinct()


def edges_of(links: DataFrame) -> DataFrame:
    return links.select(F.col("x").alias("a"), F.col("y").alias("b"))


@contextmanager
def bloom_filters(spark: SparkSession):
    """Spark's own runtime filters, for joins that keep few rows of a table below the size from which Spark makes them."""
    setting = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "0")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def set_components(
    docs: DataFrame, marks: DataFrame, named: DataFrame, key: str, text: str, settings: JoinSettings
) -> DataFrame:
    """(_sid, _component): the least key of the sets that links reach, for sets that reach another one.

    ``named`` has a row per set: its size, the size of its prefix, its least key and one of its rows.
    """
    usable = marks.where(F.col("_sid").isNotNull())
    facts = settled(gram_facts(usable), "setjoin-facts")
    sets = settled(with_partners(named, usable, facts, settings), "setjoin-partners")
    entries = settled(prefix_entries(sets, facts, settings), "setjoin-prefixes")
    entries = settled(open_entries(entries, None).drop("_comp"), "setjoin-entries")
    sets = sets.select("_sid", "_n", "_rep", "_bits").join(entries.select("_sid").distinct(), "_sid", "left_semi")
    sets = settled(sets, "setjoin-candidates")
    with bloom_filters(docs.sparkSession):
        segments = settled(segments_of(docs, sets.where("_n > 0"), key, text, settings), "setjoin-segments")
    sets = sets.drop("_rep")
    total = entries.count()
    # Documents that come with several texts connect the sets of these.
    several = usable.groupBy("_key").agg(F.min("_sid").alias("y"), F.max("_sid").alias("_high"))
    several = several.where(F.col("y") != F.col("_high")).select("_key", "y")
    links = usable.join(several, "_key").where(F.col("_sid") != F.col("y")).select(F.col("_sid").alias("x"), "y").distinct()
    links, labels = settled(links, "setjoin-links"), None
    for turn in range(settings.rounds + 1):
        if turn:
            labels = connected_components(edges_of(links))
        left = settled(open_entries(entries.drop("_members"), labels), "setjoin-open")
        # The set with most n-grams of others is likely the text that the others were made from; later on, any may do.
        score = -F.col("_open") if turn == 0 else (F.xxhash64("_sid", F.lit(turn)) % 1000).cast("double")
        last = turn == settings.rounds or pairs_left(left) <= settings.ample * total
        if last:
            pairs = rest_pairs(left, sets, settings)
        else:
            pairs = likely(star_pairs(left, score, settings), sets, settings)
        pairs = settled(pairs, "setjoin-pairs")
        links = settled(links.union(linked(pairs, segments, settings)), "setjoin-links")
        if last:
            break
    labels = connected_components(edges_of(links)).select(F.col("node").alias("_sid"), "component")
    least = named.join(labels, "_sid").groupBy("component").agg(F.min("_rep").alias("_component"))
    return labels.join(least, "component").select("_sid", "_component")


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: JoinSettings = JoinSettings()
) -> DataFrame:
    """(key, n_shingles, component_id), a row per row of ``docs``.

    Documents with 100 * shared >= similarity * united n-grams are linked; ``component_id`` is the least key that links reach, the row's own
    included. Texts with fewer words are one n-gram; null texts and texts without words have none, and no links. Rows with a
    null key are linked with nothing and have a null component. Rows that share a key are one document with several texts.
    An empty table gives no rows. Further columns are ignored, whatever their names.
    """
    every = settled(marked_sets(docs, key, text, settings).withColumn("_row", F.monotonically_increasing_id()), "setjoin-sets")
    marks = every.withColumn("_sid", F.when(F.col("_key").isNotNull(), F.col("_sid")))
    sets = marks.where(F.col("_sid").isNotNull()).groupBy("_sid")
    sized = sets.agg(
        F.min("_key").alias("_rep"), F.min("_row").alias("_row"), F.first("_n").alias("_n"), F.first(F.size("_first")).alias("_p")
    )
    named = settled(sized, "setjoin-named")
    found = set_components(docs, marks, named, key, text, settings)
    named = settled(named.select("_sid", "_rep").join(found, "_sid", "left"), "setjoin-components")
    rows = marks.select("_key", "_n", "_sid", "_row")
    labelled = spread_left_join(rows, named, "_sid", F.col("_row"))
    return labelled.select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_shingles"),
        F.coalesce("_component", "_rep", "_key").alias("component_id"),
    )
