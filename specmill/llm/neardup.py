"""Near-duplicate groups from SetSketch registers, banding, and checks on full shingle sets.

A register is the least of exponentially distributed hashes of a set's shingles on a logarithmic
scale; registers of two sets agree about as often as their shingles do. Bands of registers propose
candidates, the registers of both sides together give a likelihood estimate that drops hopeless ones, and
every link is confirmed on the full sets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.common import as_bytes, grouped, perhaps_in, slices, spaced_words
from specmill.session import settled

# Shingles that one group of the second look may hold on either side; larger groups are cut into several.
BLOCK_SHINGLES = 1 << 20


@dataclass(frozen=True)
class SketchSettings:
    """``similarity`` in hundredths. ``base`` and ``rate`` are the scale and rate of the registers.

    Enough bands are taken that two sets at the limit share none with a probability of ``miss`` only.
    """

    words: int = 5
    similarity: int = 80
    rows: int = 5
    miss: float = 1e-9
    base: float = 1.001
    rate: float = 20.0
    most: int = 65_535
    seed: int = 4711

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.similarity / 100) ** self.rows))

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambling of each number."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words.

    A text with fewer words has one, its whole sequence; without words or text there is none.
    """
    tokens = spaced_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(codes))
    total = np.full(len(codes) - size + 1, size, np.uint64)
    for i in range(size):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - size + 1 + i])
    return np.unique(total)


class Sketcher:
    """Registers and band keys of shingle sets."""

    def __init__(self, settings: SketchSettings):
        self.settings = settings
        rng = np.random.default_rng(settings.seed)
        self.factor = rng.integers(0, 1 << 63, settings.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, settings.registers, dtype=np.uint64)

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        """max over shingles of floor(1 - log_base(h)), cut to [0, most], with h exponential: uint16 each."""
        s = self.settings
        least = np.full(s.registers, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048, None] * self.factor + self.shift
            np.minimum(least, part.min(axis=0), out=least)
        uniform = (least.astype(np.float64) + 1.0) / 2.0**64
        hashes = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / s.rate
        return np.clip(np.floor(1 - np.log(hashes) / math.log(s.base)), 0, s.most).astype(np.uint16)

    def bands(self, registers: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        rows = registers.reshape(self.settings.bands, self.settings.rows).astype(np.uint64)
        key = np.arange(1, len(rows) + 1, dtype=np.uint64)
        for column in rows.T:
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
        return key.astype(np.int64)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Most likely similarity of pairs of sets of known sizes, given how many registers of ``a`` are larger, smaller, equal.

    Of u + v = 1, u is the share of the first set in the sum of the sizes; a register of the first is larger with probability
    p(u - v J), of the second with p(v - u J), where p(x) = -log_base(1 - x (base - 1) / base). The likelihood has one peak.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x):
        return np.maximum(-np.log1p(-x * (base - 1) / base) / math.log(base), 1e-12)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def sketches(docs: DataFrame, key: str, text: str, settings: SketchSettings) -> DataFrame:
    """(key, _n, _set, _regs, _bands) per row: size and 128-bit digest of the set, registers, band keys."""
    kind = docs.schema[key].dataType.simpleString()

    def sketch(batches):
        sketcher, known = Sketcher(settings), WordHashes()
        for whole in batches:
            for batch in slices(whole, text):
                sizes, digests, registers, bands = [], [], [], []
                for data in as_bytes(batch.column(text)):
                    found = shingle_set(data, settings.words, known)
                    sizes.append(len(found))
                    if not len(found):
                        for column in (digests, registers, bands):
                            column.append(None)
                        continue
                    values = sketcher.registers(found)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    registers.append(values.tobytes())
                    bands.append(sketcher.bands(values))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(registers, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=[key, "_n", "_set", "_regs", "_bands"],
                )

    return docs.select(key, text).mapInArrow(
        sketch, f"`{key}` {kind}, _n bigint, _set binary, _regs binary, _bands array<bigint>"
    )


def likely(pairs: DataFrame, members: DataFrame, settings: SketchSettings) -> DataFrame:
    """The pairs (x, y) that sizes and the joint estimate leave: five standard errors below the limit and more."""
    ends = settled(pairs.select(F.explode(F.array("x", "y")).alias("rep")).distinct(), "neardup-ends")
    sides = settled(perhaps_in(members.select("rep", "_n", "_regs"), "rep", ends), "neardup-sides")
    wide = pairs.join(
        sides.select(F.col("rep").alias("x"), F.col("_n").alias("_nx"), F.col("_regs").alias("_rx")), "x"
    )
    wide = wide.join(
        sides.select(F.col("rep").alias("y"), F.col("_n").alias("_ny"), F.col("_regs").alias("_ry")), "y"
    ).where(F.least("_nx", "_ny") * 100 >= F.greatest("_nx", "_ny") * settings.similarity)
    limit = settings.similarity / 100
    cut = limit - 5 * math.sqrt(limit * (1 - limit) / settings.registers)

    def estimate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                for c in ("_rx", "_ry")
            ]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_nx", "_ny")]
            keep = joint_similarity(*sides, *sizes, settings.base) >= cut
            yield pa.RecordBatch.from_arrays(
                [batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep))], names=["x", "y"]
            )

    return wide.select("x", "y", "_nx", "_ny", "_rx", "_ry").mapInArrow(estimate, "x bigint, y bigint").distinct()


def texts_of(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(rep, text) of the documents named in ``ids``, repeated rows once."""
    found = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("_text")).where(F.col(text).isNotNull())
    return perhaps_in(found, "rep", ids).join(ids, "rep", "left_semi").dropDuplicates(["rep", "_text"])


def confirmed(pairs: DataFrame, texts: DataFrame, settings: SketchSettings) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    wide = pairs.join(texts.select(F.col("rep").alias("x"), F.col("_text").alias("_tx")), "x").join(
        texts.select(F.col("rep").alias("y"), F.col("_text").alias("_ty")), "y"
    )

    def check(batches):
        known, last, other = WordHashes(), None, None
        for whole in batches:
            for batch in slices(whole, "_tx"):
                keep = []
                for one, two in zip(as_bytes(batch.column("_tx")), as_bytes(batch.column("_ty"))):
                    if last != two:
                        last, other = two, shingle_set(two, settings.words, known)
                    own = shingle_set(one, settings.words, known)
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * shared >= settings.similarity * (len(own) + len(other) - shared))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep))],
                    names=["x", "y"],
                )

    return wide.select("x", "y", "_tx", "_ty").mapInArrow(check, "x bigint, y bigint").distinct()


def linked_between(rows: DataFrame, settings: SketchSettings) -> DataFrame:
    """Links across components inside groups (_k, _i, _j) of rows (rep, _comp, _side, _text), on full sets.

    Every "m" row is counted against all rows of its group through an index of shingles; of the links found,
    those that join components not joined yet are enough.
    """

    def search(batches):
        known = WordHashes()
        for group in grouped(batches, ("_k", "_i", "_j")):
            sets = [shingle_set(t, settings.words, known) for t in group["_text"]]
            side = np.array(group["_side"])
            base = np.flatnonzero(side == "a")
            if not len(base) or len(base) == len(side):
                continue
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(base)), sizes[base])
            flat = np.concatenate([sets[i] for i in base])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            parent: dict[int, int] = {}

            def root(c):
                while parent.get(c, c) != c:
                    c = parent[c]
                return c

            links = []
            for i in np.flatnonzero(side == "m"):
                begins, ends = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                lengths = ends - begins
                places = np.repeat(begins - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
                shared = np.bincount(owner[places + np.arange(len(places))], minlength=len(base))
                near = 100 * shared >= settings.similarity * (sizes[i] + sizes[base] - shared)
                for j in base[near]:
                    one, two = root(group["_comp"][i]), root(group["_comp"][j])
                    if one != two:
                        parent[max(one, two)] = min(one, two)
                        links.append((group["rep"][i], group["rep"][j]))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())],
                    names=["x", "y"],
                )

    dealt = rows.repartition("_k", "_i", "_j").sortWithinPartitions("_k", "_i", "_j")
    return dealt.mapInArrow(search, "x bigint, y bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the least node that is reached.

    In every round a node takes the least label among its neighbours and itself, then that label's label, so the
    distance to the least node at least halves. Labels only ever fall: the rounds end when their sum stands still. A hub's rows are
    split by Spark's skew handling; the aggregate combines before its shuffle.
    """
    ends = edges.select("a", F.explode(F.array("a", "b")).alias("b")).unionByName(
        edges.select(F.col("b").alias("a"), F.explode(F.array("a", "b")).alias("_c")).withColumnRenamed("_c", "b")
    )
    both = settled(ends.distinct(), "edges")
    labels, total = both.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), None
    while True:
        labels = settled(labels, "labels")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(labels.select(F.col("node").alias("a"), F.col("component").alias("_near")), "a")
        near = near.groupBy(F.col("b").alias("node")).agg(F.min("_near").alias("_near"))
        parents = labels.select(F.col("node").alias("_near"), "component")
        labels = near.join(parents, "_near").select("node", F.least("_near", "component").alias("component"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: SketchSettings = SketchSettings()
) -> DataFrame:
    """(key, n_shingles, component_id, kept), a row per row of ``docs``.

    Documents with 100 * shared >= similarity * united shingles are linked; ``component_id`` is the least id that links
    reach, the row's own included, and ``kept`` marks it. Texts without words are linked with nothing. Rows
    with a null id are linked with nothing either, have a null component and are kept. Rows that share an id are one
    document with several texts. An empty table gives no rows.

    1. Equal sets are one member, named by the least id: copies end here, whatever their number.
    2. In every band, members are compared with one hub only, the member that shares most bands with others.
    3. Members of a bucket that are still in different components form groups that are searched in full, in
       blocks of bounded size: nothing that shares a band is left out, and no list of all pairs is made.
    """
    rows = docs.select(F.col(key), F.col(text))
    marks = settled(sketches(rows, key, text, settings), "neardup-sketches")
    named = marks.where(F.col("_set").isNotNull() & F.col(key).isNotNull())
    reps = settled(named.groupBy("_set").agg(F.min(F.col(key).cast("bigint")).alias("rep")), "neardup-reps")
    members = named.withColumnRenamed("_set", "_own").join(
        reps, (F.col(key).cast("bigint") == F.col("rep")) & (F.col("_own") == F.col("_set"))
    )
    members = settled(
        members.select("rep", "_set", "_n", "_regs", "_bands").dropDuplicates(["rep", "_set"]), "neardup-members"
    )
    banded = members.select("rep", F.explode("_bands").alias("_band"))
    shared = banded.groupBy("_band").agg(F.count("*").alias("_size")).where(F.col("_size") > 1)
    shared = settled(shared, "neardup-shared")
    # Most bands have one member: they are left out before the shuffle.
    common = perhaps_in(banded, "_band", shared.select("_band"))
    buckets = settled(common.join(shared, "_band"), "neardup-buckets")
    degrees = buckets.groupBy("rep").agg(F.sum("_size").alias("_degree"))
    hubs = (
        buckets.select("_band", "rep")
        .join(degrees, "rep")
        .groupBy("_band")
        .agg(F.max(F.struct("_degree", (-F.col("rep")).alias("_least"))).alias("_best"))
        .select("_band", (-F.col("_best._least")).alias("y"))
    )
    stars = (
        buckets.select("_band", F.col("rep").alias("x"))
        .join(hubs, "_band")
        .where(F.col("x") != F.col("y"))
        .select("x", "y")
        .distinct()
    )
    pairs = settled(likely(settled(stars, "neardup-stars"), members, settings), "neardup-pairs")
    ids = settled(pairs.select(F.explode(F.array("x", "y")).alias("rep")).distinct(), "neardup-ids")
    links = settled(
        confirmed(pairs, settled(texts_of(rows, ids, key, text), "neardup-texts"), settings), "neardup-links"
    )
    first = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = settled(
        links.union(second_look(rows, buckets, members, first, key, text, settings)).distinct(), "neardup-links"
    )
    last = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    own_set = F.when(F.col(key).isNotNull(), F.col("_set")).alias("_set")
    labelled = marks.select(F.col(key), F.col("_n"), own_set).join(reps, "_set", "left")
    labelled = labelled.join(last.select(F.col("node").alias("rep"), "component"), "rep", "left")
    own = F.col(key).cast("bigint")
    component = F.least(F.coalesce("component", "rep", own), own)
    return labelled.select(
        F.col(key),
        F.col("_n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == own, F.lit(True)).alias("kept"),
    )


def second_look(
    rows: DataFrame, buckets: DataFrame, members: DataFrame, first: DataFrame, key: str, text: str, settings: SketchSettings
) -> DataFrame:
    """Links between components that share a bucket of three members or more."""
    open_buckets = buckets.where(F.col("_size") > 2).select("_band", "rep")
    placed = open_buckets.join(first.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = settled(placed.select("_band", "rep", F.coalesce("component", "rep").alias("_comp")), "neardup-placed")
    mixed = (
        placed.groupBy("_band")
        .agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high"))
        .where(F.col("_low") != F.col("_high"))
    )
    mixed = settled(placed.join(mixed.select("_band", "_low"), "_band"), "neardup-mixed")
    clusters = connected_components(
        mixed.where(F.col("_comp") != F.col("_low")).select(F.col("_comp").alias("a"), F.col("_low").alias("b")).distinct()
    )
    who = mixed.select("rep", "_comp").distinct().join(members.select("rep", "_n"), "rep")
    who = who.join(clusters.select(F.col("node").alias("_comp"), F.col("component").alias("_k")), "_comp", "left")
    who = settled(who.select("rep", "_comp", "_k", "_n"), "neardup-who")
    # The largest component of a cluster stays; the others look for links to it and to each other.
    weights = who.groupBy("_k", "_comp").agg(F.sum("_n").alias("_w"))
    sums = weights.groupBy("_k").agg(
        F.max(F.struct("_w", "_comp")).alias("_main"), F.sum("_w").alias("_total")
    )
    blocks = sums.select(
        "_k",
        F.col("_main._comp").alias("_stay"),
        F.ceil((F.col("_total") - F.col("_main._w")) / F.lit(BLOCK_SHINGLES)).cast("int").alias("_nm"),
        F.ceil(F.col("_total") / F.lit(BLOCK_SHINGLES)).cast("int").alias("_na"),
    )
    who = who.join(blocks, "_k", "left")
    who = settled(who.select("rep", "_comp", "_k", "_stay", "_nm", "_na"), "neardup-blocks")
    placed_texts = texts_of(rows, who.select("rep").distinct(), key, text).join(who, "rep")
    h = F.xxhash64("rep")
    one = F.struct(F.lit("m").alias("_side"), F.pmod(h, F.col("_nm")).cast("int").alias("_i"))
    searchers = (
        placed_texts.where(F.col("_comp") != F.col("_stay"))
        .select("*", one.alias("_one"), F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("_j"))
        .select("_k", F.col("_one._i").alias("_i"), "_j", F.col("_one._side").alias("_side"), "rep", "_comp", "_text")
    )
    searched = placed_texts.select(
        "_k",
        F.explode(F.sequence(F.lit(0), F.col("_nm") - 1)).alias("_i"),
        F.pmod(h, F.col("_na")).cast("int").alias("_j"),
        F.lit("a").alias("_side"),
        "rep",
        "_comp",
        "_text",
    )
    return linked_between(searchers.unionByName(searched), settings)
