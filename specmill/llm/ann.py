"""Approximate nearest neighbours with a hash-prefix forest.

Every tree hashes vectors to long bit strings and keeps them as a sorted array. A query descends each tree to
its longest matching prefix and then ascends all trees together, one bit at a time, until enough vectors share a
prefix with it in some tree. Rows are searched in blocks: each block holds a forest over its own distinct vectors, and
the best of all blocks are merged, so no bucket of a popular hash ever meets in one task. Rows are dealt over
the blocks by a hash, whatever order they are stored in: every block is a sample of the table, as the one that fits the forest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specmill.llm.common import share_of


@dataclass(frozen=True)
class ForestSettings:
    """``trees`` arrays of ``bits``-bit strings; blocks of ``block_bytes`` of vectors; ``query_bytes`` of them per pass.

    ``sample`` rows and ``trials`` of them as queries fit the forest: the centre of the vectors, and the least share of the
    rows to ascend to (of ``shares``) that finds ``recall`` of the true neighbours.
    """

    trees: int = 24
    bits: int = 24
    block_bytes: int = 8 << 20
    query_bytes: int = 8 << 20
    sample: int = 4_000
    trials: int = 200
    recall: float = 0.96
    shares: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)
    seed: int = 97


class Planes:
    """The hash functions: signs of projections of centred unit vectors."""

    def __init__(self, dimension: int, centre: np.ndarray, settings: ForestSettings):
        rng = np.random.default_rng(settings.seed)
        self.settings, self.centre = settings, centre
        self.normals = rng.normal(size=(dimension, settings.trees * settings.bits)).astype(np.float32)

    def codes(self, units: np.ndarray) -> np.ndarray:
        """uint32[tree, row]: the hash strings, first bit highest."""
        s = self.settings
        bits = ((units - self.centre).astype(np.float32) @ self.normals > 0).reshape(len(units), s.trees, s.bits)
        weights = (1 << np.arange(s.bits - 1, -1, -1)).astype(np.uint32)
        return np.ascontiguousarray((bits * weights).sum(axis=2, dtype=np.uint32).T)


class Forest:
    """Sorted arrays of the codes of one block of unit vectors."""

    def __init__(self, units: np.ndarray, planes: Planes):
        self.planes = planes
        codes = planes.codes(units)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def candidates(self, codes: np.ndarray, wanted: float, enough_of=lambda query, found: True):
        """For each query, given its codes, the rows that share a prefix with it in some tree.

        The prefix is the longest for which all trees together offer ``wanted`` rows (a row counts once for each tree) and
        ``enough_of(query, rows)`` holds, or else the empty one, which all rows share.
        """
        trees, bits, rows = len(codes), self.planes.settings.bits, self.sorted.shape[1]
        low = np.zeros((bits + 1, trees, codes.shape[1]), np.int64)
        high = np.full_like(low, rows)
        for level in range(1, bits + 1):
            mask = np.uint32((1 << (bits - level)) - 1)
            for tree in range(trees):
                low[level, tree] = np.searchsorted(self.sorted[tree], codes[tree] & ~mask, "left")
                high[level, tree] = np.searchsorted(self.sorted[tree], codes[tree] | mask, "right")
        offered = (high - low).sum(axis=1)
        enough = offered >= min(wanted, rows * trees)
        level = bits - np.argmax(enough[::-1], axis=0)
        for query in range(codes.shape[1]):
            for depth in range(level[query], -1, -1):
                found = np.zeros(rows, bool)
                for tree in range(trees):
                    at = (depth, tree, query)
                    found[self.order[tree, low[at] : high[at]]] = True
                found = np.flatnonzero(found)
                if depth == 0 or enough_of(query, found):
                    break
            yield found


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as float64 rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(_id, _v): rows with an id, whose vector is neither null, empty nor zero and has finite components only."""
    value = F.col(embedding)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(
        F.col(key).isNotNull() & value.isNotNull() & ~bad & F.exists(value, lambda x: x != 0)
    ).select(F.col(key).cast("bigint").alias("_id"), value.cast("array<double>").alias("_v"))


def fitted(rows: DataFrame, dimension: int, k: int, settings: ForestSettings, total: int) -> tuple[Planes, float]:
    """Planes around the centre of a bounded sample, and the share of a block's distinct vectors to ascend to."""
    taken = share_of(rows, F.col("_id"), settings.sample, total).limit(2 * settings.sample).collect()
    sample = np.array([r["_v"] for r in sorted(taken, key=lambda r: (r["_id"], r["_v"]))], np.float64).reshape(-1, dimension)
    units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    units = np.unique(units, axis=0)
    planes = Planes(dimension, units.mean(axis=0), settings)
    forest = Forest(units, planes)
    rng = np.random.default_rng(settings.seed + 1)
    tries = rng.permutation(len(units))[: settings.trials]
    near = units[tries] @ units.T
    near[np.arange(len(tries)), tries] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, max(0, len(units) - 1))]
    codes = planes.codes(units[tries])
    for share in settings.shares:
        hits = sum(
            np.isin(best[i], found).sum() for i, found in enumerate(forest.candidates(codes, share * len(units)))
        )
        if hits >= settings.recall * best.size:
            return planes, share
    return planes, float(settings.trees)


def neighbours(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    every: int = 50,
    k: int = 5,
    settings: ForestSettings = ForestSettings(),
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the ``k`` nearest of all other rows.

    ``score`` is the cosine of the original vectors in double precision; ties go to the smaller id. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id; vectors of
    another length than a query's are no candidates for it. Repeated rows are candidates each, also for their
    own copy unless they share its id; a repeated query id is one query with its smallest vector. Empty tables give no rows.
    """
    usable_rows = usable(vectors, key, embedding)
    spark = vectors.sparkSession
    out = None
    for size in [r["n"] for r in usable_rows.select(F.size("_v").alias("n")).distinct().collect()]:
        rows = usable_rows.where(F.size("_v") == size)
        asked = rows.where(F.pmod("_id", F.lit(every)) == 0)
        count = asked.count()
        if not count:
            continue
        total = rows.count()
        planes, share = fitted(rows, size, k, settings, total)
        block = max(k, settings.block_bytes // (8 * size))
        # Equal rows meet in one partition, so blocks do not depend on how the table is stored. The order by the same hash
        # makes each block of a partition a sample as well.
        mixed_up = F.xxhash64("_id", "_v", F.lit(settings.seed))
        dealt = rows.withColumn("_at", mixed_up).repartition(max(1, -(-total // block)), "_at")
        dealt = dealt.sortWithinPartitions("_at").select("_id", "_v")
        for part in range(passes := -(-count * size * 8 // settings.query_bytes)):
            chosen = asked.where(F.pmod(F.xxhash64("_id"), F.lit(passes)) == part)
            # About settings.query_bytes: a pass sends no more than that to every task.
            known = {}
            for row in chosen.collect():
                known[row["_id"]] = min(known.get(row["_id"], row["_v"]), row["_v"])
            ids = np.array(sorted(known), np.int64)
            queries = spark.sparkContext.broadcast((ids, np.array([known[i] for i in ids.tolist()]), planes, share))
            found = dealt.mapInArrow(_searcher(queries, k, block), "query_id bigint, vec_id bigint, score double")
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        out.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _searcher(broadcast, k: int, block: int):
    def search(batches):
        ids, queries, planes, share = broadcast.value
        lengths = np.linalg.norm(queries, axis=1)
        units = queries / lengths[:, None]
        codes = planes.codes(units)
        best: list[list[tuple[float, int]]] = [[] for _ in ids]

        def look(rows: np.ndarray, names: np.ndarray) -> None:
            norms = np.linalg.norm(rows, axis=1)
            # Copies count as one: a large group of them would end the ascent before other near vectors are met.
            distinct, copy_of = np.unique(rows / norms[:, None], axis=0, return_inverse=True)
            copy_of = copy_of.reshape(-1)
            forest = Forest(distinct, planes)

            def others(q: int, found: np.ndarray) -> np.ndarray:
                held = np.zeros(len(distinct), bool)
                held[found] = True
                return np.flatnonzero(held[copy_of] & (names != ids[q]))

            wanted = forest.candidates(codes, share * len(distinct), lambda q, found: len(others(q, found)) >= k)
            for q, found in enumerate(wanted):
                found = others(q, found)
                if not len(found):
                    continue
                rough = (rows[found] @ queries[q]) / (norms[found] * lengths[q])
                if len(found) > k:
                    # Everything that may be among the first k is measured anew, each row by itself, so that equal rows tie.
                    found = found[rough >= np.partition(rough, -k)[-k] - 1e-9]
                scores = (rows[found] * queries[q]).sum(axis=1) / (norms[found] * lengths[q])
                first = np.lexsort((names[found], -scores))[:k]
                merged = best[q] + list(zip(scores[first].tolist(), names[found][first].tolist()))
                best[q] = sorted(merged, key=lambda x: (-x[0], x[1]))[:k]

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((_matrix(batch.column("_v")), batch.column("_id").to_numpy()))
                count += batch.num_rows
            if count >= block:
                look(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held, count = [], 0
        if held:
            look(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        flat = [(int(ids[q]), name, score) for q, rows in enumerate(best) for score, name in rows]
        if flat:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in flat], pa.int64()),
                    pa.array([f[1] for f in flat], pa.int64()),
                    pa.array([f[2] for f in flat], pa.float64()),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return search
