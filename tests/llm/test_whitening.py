"""Whitening against numpy on well-conditioned data, and its exact parts against Python's integers."""

import numpy as np
import pytest

from blockloom.llm.whitening import characteristic_polynomial, components_of, largest_roots, moments, polynomial_modulo, prepared, roots_above, whitened


def determinant_polynomial(m):
    """Faddeev and LeVerrier's recurrence in exact integers."""
    d = len(m)
    a = np.array(m, object)
    c, b = [0] * d + [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        b = a.dot(b) + c[d - k + 1] * np.identity(d, dtype=object).astype(int).astype(object)
        c[d - k] = -int(np.trace(a.dot(b))) // k
    return c


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (5, 5), (9, 3), (12, 12)):
        x = rng.integers(-500, 500, (d, rank)).astype(object)
        m = x.dot(x.T)
        want = determinant_polynomial(m.tolist())
        assert characteristic_polynomial(spark, m.tolist()) == want
        assert polynomial_modulo(np.array([[v % 97 for v in r] for r in m.tolist()], np.int64), 97).tolist() == [c % 97 for c in want]
    assert characteristic_polynomial(spark, [[0, 0], [0, 0]]) == [0, 0, 1]
    assert characteristic_polynomial(spark, [[4, 0], [0, 4]]) == [16, -8, 1]


def test_roots_with_multiplicity():
    poly = [1]
    for r in (0, 0, 3, 7, 7, 1_000_003):
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    assert [roots_above(poly, a, 0) for a in (0, 2, 3, 6, 7, 2_000_000)] == [4, 4, 3, 3, 1, 0]
    roots, bits = largest_roots(poly, 6)
    assert np.allclose([r / 2**bits for r in roots], [1_000_003, 7, 7, 3, 0, 0], rtol=1e-25)


def test_components_of_equal_and_zero_roots():
    m = [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0]]
    v = components_of(m, [2 << 100, 2 << 100, 2 << 100, 0], 100)
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-15) and np.allclose(np.array(m) @ v[:3].T, 2 * v[:3].T) and np.allclose(np.array(m) @ v[3], 0)


def reference(vectors, count):
    x = (np.floor(np.array(vectors, float) * 1024) + 100_000).astype(int)
    n, s = len(x), x.sum(0)
    values, vecs = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1))
    order = np.argsort(-values)[:count]
    w = (x - s / n) @ vecs[:, order] / np.sqrt(values[order])
    return [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s))) for r in x], w, values[order] / values.sum()


def test_whitened(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 10)) * np.linspace(0.2, 3, 10)).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 7) for i, v in enumerate(base)] + [(300, base[5].tolist(), 1), (300, base[5].tolist(), 1), (None, base[6].tolist(), 1)]
    bad = [(901, None, 1), (902, [], 1), (903, [None] * 10, 1), (904, [float("nan")] * 10, 1), (905, [float("inf")] + [0.0] * 9, 1), (906, [1.0] * 9, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component int").repartition(4)
    got = whitened(df).collect()
    deviation, w, explained = reference([r[1] for r in rows], 8)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)}
    signs = {r.component: np.sign(r.whitened * w[0][r.component - 1]) for r in got if r.vec_id == 0}
    at = {r[0]: i for i, r in enumerate(rows)}
    for r in got:
        i, c = at[r.vec_id], r.component - 1
        assert r.deviation == deviation[i] and r.whitened * signs[r.component] == pytest.approx(w[i][c], abs=1e-8)
        assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9


def test_whitened_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitened(spark.createDataFrame([], schema)).count() == 0
    one = whitened(spark.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    flat = whitened(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in flat) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    assert {abs(r.whitened) for r in flat if r.component == 1} == {1.0}
    huge = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-3e12, 5.0]), (3, [1e300, 1.0])], schema)
    n, sums, products = moments(*prepared(huge))
    y = [[1024 * 10**12, 0], [-3072 * 10**12, 5120], [2**62, 1024]]
    assert n == 3 and sums == [sum(c) for c in zip(*y)] and products == [[sum(r[i] * r[j] for r in y) for j in range(2)] for i in range(2)]
    assert {r.deviation for r in whitened(huge).collect()} == {None}
