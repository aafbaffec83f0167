"""Whitening: against a library's eigenvalues, exact sums, and odd tables."""

import numpy as np
import pytest

from specmill.llm.whitening import jacobi, pivoted_cholesky, tournament, whitened_vectors

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows):
    x = np.floor(1024 * np.array(rows, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1], vectors[:, ::-1], centred


def frame(rows):
    return {(r.vec_id, r.component): r for r in rows}


@pytest.mark.parametrize("size, dimension", [(40, 3), (300, 12), (90, 17)])
def test_equals_a_plain_solution(spark, size, dimension):
    rng = np.random.default_rng(size)
    rows = (rng.normal(size=(size, dimension)) * np.linspace(0.1, 3, dimension) + 5).tolist()
    out = frame(whitened_vectors(spark.createDataFrame(list(enumerate(rows)), SCHEMA)).collect())
    x, n, s, values, vectors, centred = plain(rows)
    count = min(8, dimension)
    assert len(out) == size * count
    for k in range(count):
        own = np.array([out[i, k + 1].whitened for i in range(size)])
        want = centred @ vectors[:, k] / np.sqrt(values[k])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-9
        assert abs(out[0, k + 1].explained - values[k] / values.sum()) < 1e-12
    exact = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    assert [out[i, 1].deviation for i in range(size)] == exact
    assert {r.n for r in out.values()} == {size} and out[0, 1].identity_error < 1e-9


def test_rank_and_factor():
    rng = np.random.default_rng(2)
    wide = rng.normal(size=(4, 9))
    a = wide.T @ wide
    factor = pivoted_cholesky(a)
    assert factor.shape == (9, 4) and np.allclose(factor @ factor.T, a)
    values, vectors = jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:4]) and np.allclose(vectors.T @ vectors, np.eye(4))
    assert pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


@pytest.mark.parametrize("count", [0, 1, 2, 5, 8])
def test_tournament_meets_all_pairs_once(count):
    met = [pair for i, j in tournament(count) for pair in zip(i.tolist(), j.tolist())]
    assert sorted(met) == [(a, b) for a in range(count) for b in range(a + 1, count)]


def test_odd_rows_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.0], [0.0, 5.0]]
    rows = [(1, good[0], 0), (None, good[1], 0), (3, good[2], 0), (3, good[2], 0)]
    bad = [(4, None, 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0], 0), (9, [], 0), (10, [3e38, 1.0], 0)]
    docs = spark.createDataFrame(rows + bad, SCHEMA + ", n int")
    out = whitened_vectors(docs).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 1), (3, 1), (3, 2), (3, 2)]
    assert {r.n for r in out} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]])
def test_tables_without_components(spark, rows):
    found = whitened_vectors(spark.createDataFrame(rows, SCHEMA))
    assert found.collect() == []
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [0.0, 1e12]), (3, [-1e12, 3.0])]
    out = whitened_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.deviation for r in out} == {None} and max(r.identity_error for r in out) < 1e-9
