import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreloom.llm.whitening import deviations, eigenvalue_intervals, inertia, largest_eigenpairs, whitened


def symmetric(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * np.array(values, float)) @ q.T


def plain(rows, k=4):
    """The contract by numpy's own eigenvalues: {(vec_id, component): (n, deviation, |whitened|, explained)}."""
    kept = [(i, [int(np.floor(256.0 * np.float64(c))) for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return {(i, c + 1): (n, sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)),
                         abs((np.array(v) - np.array([s / n for s in sums])) @ vectors[:, c] / np.sqrt(values[c])), values[c] / np.trace(cov))
            for i, v in kept for c in range(len(values))}


@given(st.lists(st.integers(-5, 5), min_size=1, max_size=9), st.integers(0, 50))
@settings(max_examples=100, deadline=None)
def test_inertia_counts_signs(values, seed):
    negative, zero, positive = inertia(symmetric([v + 0.5 for v in values], seed))
    assert (negative, zero, positive) == (sum(v < 0 for v in values), 0, sum(v >= 0 for v in values))


def test_inertia_of_special_matrices():
    assert inertia(np.zeros((3, 3))) == (0, 3, 0)
    assert inertia(np.array([[0.0, 2], [2, 0]])) == (1, 0, 1)
    assert inertia(np.diag([1.0, 0, -4])) == (1, 1, 1)


def test_intervals_hold_the_largest():
    values = [100, 60, 59.9, 59.8, 30, 5, 4, 3, 2, 1]
    intervals = eigenvalue_intervals(symmetric(values), 4)
    assert sum(i.count for i in intervals) >= 4
    for low, high, count in intervals:
        assert count == sum(low < v <= high for v in values)


@pytest.mark.parametrize("values", [
    [9, 5, 3, 2, 1, 0.5], [10, 10, 10, 10, 10, 1, 1], [7, 7, 7, 7], [5, 0, 0, 0, 0, 0], [1e-9, 1e-10, 1e-11, 1e-12, 1e-13],
    list(np.linspace(2, 1, 40)), [3, 2], [1], [1000, 999.9999, 999.9998, 2, 1, 1, 1, 1, 1, 1],
    [50, 40, 30, 20, *[19.99] * 20]])
def test_eigenpairs_are_those_of_a_dense_solver(spark, values):
    matrix = symmetric(values)
    found, vectors = largest_eigenpairs(spark, matrix, 4)
    want = sorted(values, reverse=True)[:4]
    assert np.allclose(found, want, rtol=0, atol=1e-12 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * found) <= 1e-11 * max(values)


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(5)
    scale = np.array([3, 2.2, 1.7, 1.2, 0.8, 0.6, 0.4, 0.2, 0.1])
    vectors = [(i, [float(np.float32(c)) for c in random.standard_normal(9) * scale + 0.3]) for i in range(300)]
    same = [(400 + i, vectors[7][1]) for i in range(150)]
    odd = [(901, None), (902, []), (903, [1.0] * 8 + [None]), (904, [float("nan")] * 9), (905, [float("inf")] + [0.0] * 8), (906, [0.5])]
    return vectors, same, odd, [(None, vectors[3][1]), (600, vectors[4][1]), (600, vectors[4][1])]


def test_whitened_like_plain_numpy(spark, rows):
    vectors, same, odd, more = rows
    table = spark.createDataFrame([(i, v, 1, "x") for part in rows for i, v in part],
                                  "vec_id bigint, embedding array<float>, n int, component string").repartition(5)
    got = whitened(table).collect()
    want = plain([r for r in vectors + same + more])
    assert len(got) == 4 * (len(vectors) + len(same) + len(more))
    by_sign = {}
    for r in got:
        n, deviation, size, explained = want[(r.vec_id, r.component)]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - size) <= 1e-9 * max(1, size) and abs(r.explained - explained) <= 1e-9
        assert 0 <= r.identity_error <= 1e-9
        by_sign.setdefault(r.component, []).append((r.vec_id, r.whitened))
    # The same sign for all rows: equal vectors have equal values, and values have mean 0 over the fit list.
    for pairs in by_sign.values():
        alike = [w for i, w in pairs if i is not None and (400 <= i < 600 or i == 7)]
        assert max(alike) - min(alike) <= 1e-12
        assert abs(sum(w for i, w in {i: w for i, w in pairs if i is not None and i < 300}.items())) < 1e-8


def test_tables_without_variance_and_without_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitened(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitened(spark.createDataFrame([(1,)], "vec_id bigint")).collect() == []
    got = whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [
        (1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)] * 2
    got = whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, None if r.whitened is None else round(abs(r.whitened), 9), round(r.explained, 9)) for r in got) == [
        (1, 1, 1.0, 1.0), (1, 2, None, 0.0), (2, 1, 1.0, 1.0), (2, 2, None, 0.0)]


def test_deviations_are_exact_however_large():
    x = np.array([[2**40, -3], [5, 7]])
    assert deviations(x, 10, [2**40 + 5, 4]) == [None, (50 - 2**40 - 5) ** 2 + 66**2 if (50 - 2**40 - 5) ** 2 < 2**63 else None]
    assert deviations(np.array([[3, 4], [-1, 0]]), 2, [2, 4]) == [(6 - 2) ** 2 + 4**2, 4**2 + 4**2]
    big = np.array([[2**31, 1], [2**31 + 1, 2**31]])
    assert deviations(big, 1, [2**31, 0]) == [1, 1 + 2**62]


def test_numbers_beyond_a_long(spark):
    got = whitened(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-1e30, 1.0])], "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 6 and all(r.n == 3 for r in got)
