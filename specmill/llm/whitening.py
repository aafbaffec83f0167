"""Whitening of vectors: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Spark sums integers that stand for the entries, so sums and scatter are exact and do not depend on how rows are dealt.
The covariance, dimension times dimension, is all that reaches the driver: its pivoted Cholesky factor L has orthogonal columns
after rotations from the right; their norms are the roots of the eigenvalues, the normalised columns the components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WhiteningSettings:
    """``x = floor(scale * c) + offset``; at most ``components`` are returned.

    Vectors with an entry beyond ``largest`` have no x that a long holds.
    """

    scale: int = 1024
    offset: int = 100_000
    components: int = 8
    largest: float = 2.0**51

    def grid(self, entries: np.ndarray) -> np.ndarray:
        return np.floor(self.scale * entries).astype(np.int64) + self.offset


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with ``a = L L^T`` up to rounding, a column per rank: the largest remaining diagonal entry is the next pivot.

    With rows in pivot order L is lower trapezoidal; rows are returned in the order of ``a``.
    """
    size = len(a)
    left = np.diag(a).astype(np.float64).copy()
    factor = np.zeros((size, size))
    floor = size * np.finfo(np.float64).eps * left.max(initial=0.0)
    for rank in range(size):
        pivot = int(np.argmax(left))
        if left[pivot] <= floor:
            return factor[:, :rank]
        column = (a[:, pivot] - factor[:, :rank] @ factor[pivot, :rank]) / np.sqrt(left[pivot])
        # Rows chosen before are zero from here on.
        column[left == -np.inf] = 0.0
        column[pivot] = np.sqrt(left[pivot])
        factor[:, rank] = column
        left -= column * column
        left[pivot] = -np.inf
    return factor


def tournament(count: int):
    """Rounds of disjoint pairs in which each of ``count`` columns meets every other once."""
    seats = list(range(count + count % 2))
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], seats[:half - 1:-1]) if max(a, b) < count]
        yield np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of ``factor factor^T``.

    Pairs of columns are rotated until all are orthogonal to double precision; disjoint pairs rotate at once.
    """
    columns = factor.copy()
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for i, j in tournament(columns.shape[1]):
            a, b = columns[:, i], columns[:, j]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            apart = np.abs(gamma) > eps * np.sqrt(alpha * beta)
            if not apart.any():
                continue
            turned = True
            zeta = np.where(apart, (beta - alpha) / np.where(apart, 2 * gamma, 1.0), 0.0)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            tangent = np.where(apart, tangent, 0.0)
            cosine = 1 / np.sqrt(1 + tangent * tangent)
            sine = cosine * tangent
            columns[:, i], columns[:, j] = cosine * a - sine * b, sine * a + cosine * b
        if not turned:
            break
    norms = np.sqrt((columns * columns).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    norms, columns = norms[order], columns[:, order]
    return norms**2, columns / norms


@dataclass(frozen=True)
class Whitener:
    """What the fit list gives: its size, exact sums per dimension, components (rows) and their eigenvalues."""

    settings: WhiteningSettings
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A row per vector, a column per component."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n for s in self.sums], np.float64) / self.n
        return ((x - whole) - part) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 per row, exact."""
        # x - S // n times n less the remainder: small numbers where the entries are near their mean.
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        near = x - whole
        most = int(np.abs(near).max(initial=0)) * self.n + self.n
        if most * most * max(1, x.shape[1]) < 1 << 62:
            return ((near * self.n - rest) ** 2).sum(axis=1).tolist()
        return [sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(row, rest)) for row in near]


def usable(vector: Column, settings: WhiteningSettings) -> Column:
    """Not null, without null and non-finite entries, and within what a long holds."""
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= settings.largest))
    return F.coalesce(vector.isNotNull() & sound, F.lit(False))


# Entries of one batch that are worked on at a time.
ENTRIES = 1 << 20


def pieces(batches, name: str, dimension: int):
    """(rows, their vectors as a matrix) in pieces of about ``ENTRIES`` entries."""
    step = max(1, ENTRIES // dimension)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            values = part.column(name).flatten().to_numpy(zero_copy_only=False)
            yield part, values.reshape(part.num_rows, dimension)


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y^T y`` of whole numbers as Python integers, without rounding."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 1 << 53:
        # Every partial sum is a whole number that a double holds.
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T.dot(z)


# Whole numbers beyond a long travel as a high part times this, and a low part.
LIMB = 1 << 62


def totals(rows: DataFrame, vector: str, dimension: int, per_piece, count: int) -> list[int]:
    """Exact sums over all rows of ``count`` whole numbers, which ``per_piece`` gives for a matrix of vectors.

    Each task sends one row per number; Spark adds them up. The driver sees ``count`` numbers.
    """

    def gather(batches):
        total = np.zeros(count, object)
        for _, entries in pieces(batches, vector, dimension):
            total = total + per_piece(entries)
        parts = [divmod(int(v), LIMB) for v in total]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(count), pa.int64()),
                pa.array([str(high) for high, _ in parts], pa.string()),
                pa.array([low for _, low in parts], pa.int64()),
            ],
            names=["_cell", "_high", "_low"],
        )

    cells = rows.mapInArrow(gather, "_cell bigint, _high string, _low bigint").groupBy("_cell")
    added = cells.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in ("_high", "_low")])
    held = [0] * count
    for cell, high, low in added.collect():
        held[cell] = int(high) * LIMB + int(low)
    return held


def fitted(rows: DataFrame, vector: str, settings: WhiteningSettings) -> Whitener | None:
    """The whitener of ``rows``, whose vectors are all usable; None without rows.

    Two passes: sums first, then products of entries less the whole part of their mean. Both are exact in integers, so is
    the covariance until its one division.
    """
    sizes = rows.groupBy(F.size(vector).alias("_d")).count()
    first = sizes.orderBy(F.col("count").desc(), "_d").first()
    if first is None or not first["_d"]:
        return None
    dimension = first["_d"]
    rows = rows.where(F.size(vector) == dimension).select(vector)
    n = first["count"]
    sums = totals(rows, vector, dimension, lambda c: settings.grid(c).astype(object).sum(axis=0), dimension)
    centre = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(dimension)

    def products(entries):
        return exact_products(settings.grid(entries) - centre)[upper]

    scatter = totals(rows, vector, dimension, products, len(upper[0]))
    rest = [s % n for s in sums]
    covariance = np.zeros((dimension, dimension))
    for i, j, s in zip(*upper, scatter):
        covariance[i, j] = covariance[j, i] = (n * s - rest[i] * rest[j]) / (n * n)
    values, vectors = jacobi(pivoted_cholesky(covariance))
    kept = min(settings.components, len(values))
    return Whitener(settings, n, tuple(sums), values[:kept], vectors[:, :kept].T, float(np.trace(covariance)))


def identity_error(rows: DataFrame, vector: str, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity, measured over all of them."""
    size = len(model.values)

    def gather(batches):
        total = np.zeros((size, size + 1))
        for _, entries in pieces(batches, vector, model.dimension):
            w = model.whitened(model.settings.grid(entries))
            total += np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], names=["_cell", "_value"]
        )

    cells = rows.select(vector).mapInArrow(gather, "_cell bigint, _value double")
    found = np.zeros(size * (size + 1))
    for cell, value in cells.groupBy("_cell").agg(F.sum("_value")).collect():
        found[cell] = value / model.n
    found = found.reshape(size, size + 1)
    mean = found[:, -1]
    return float(np.abs(found[:, :-1] - np.outer(mean, mean) - np.eye(size)).max())


def whitened_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    settings: WhiteningSettings = WhiteningSettings(),
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component, from 1.

    Null vectors, vectors with null or non-finite entries, and vectors with entries beyond ``settings.largest`` in size are dropped;
    of vectors of different lengths, those of the most frequent one stay (of several, the shortest). There are as many
    components as the covariance has rank, ``settings.components`` at most: equal vectors, a single one or vectors without entries
    have none and give no rows, as does an empty table. Repeated rows and null keys count like others, and come back as often.
    A deviation that a long does not hold is null. Further columns are ignored.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where(usable(F.col("_v"), settings))
    model = fitted(rows, "_v", settings)
    outcome = (
        f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], outcome)
    rows = rows.where(F.size("_v") == model.dimension)
    error = identity_error(rows, "_v", model)
    size = len(model.values)
    explained = model.values / model.trace

    def apply(batches):
        for batch, entries in pieces(batches, "_v", model.dimension):
            x = model.settings.grid(entries)
            count = len(x) * size
            deviations = [d if d < 1 << 63 else None for d in model.deviations(x)]
            take = pa.array(np.repeat(np.arange(len(x)), size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(take),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, model.n, np.int64)),
                    pa.array(deviations, pa.int64()).take(take),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(count, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("_key", "_v").mapInArrow(apply, outcome)
