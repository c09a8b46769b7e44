"""Quantile regressions against all vertices of their linear programmes, and against the conditions of an optimum."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from loomline.operators import quantile as Q


def loss(u, tau, w=1.0):
    return float((w * np.where(u >= 0, tau * u, (tau - 1) * u)).sum())


def by_vertices(y, X, tau, w=1.0):
    """The best of all fits through as many rows as there are coefficients."""
    best = np.inf, None
    for rows in combinations(range(len(y)), X.shape[1]):
        a = X[list(rows)]
        if abs(np.linalg.det(a)) > 1e-9:
            b = np.linalg.solve(a, y[list(rows)])
            best = min(best, (loss(y - X @ b, tau, w), tuple(b)))
    return best


def frame(groups):
    return pd.concat([pd.DataFrame({"g": g, "tau": tau, "y": y, "a": X[:, 1], "b": X[:, 2], "w": w}) for g, (y, X, tau, w) in groups.items()])


def test_small_groups_against_vertices(spark):
    r, groups = np.random.default_rng(1), {}
    for g, tau in enumerate([0.1, 0.25, 0.5, 0.9, 0.5, 0.75]):
        n = 22
        X = np.column_stack([np.ones(n), r.normal(size=n) * 10 ** (g - 2), r.integers(0, 3, n)])
        y = X @ [1, 0.5 * 10 ** (2 - g), -1] + r.standard_t(3, n) * (1 + abs(X[:, 2]))
        w = r.integers(0, 4, n).astype(float) if g > 3 else np.ones(n)
        if g == 4:
            y[:6] = y[6]  # ties
        groups[g] = (y, X, tau, w)
    got = {x.g: x for x in Q.quantile_fit(spark.createDataFrame(frame(groups)).repartition(3), ["g"], "y", ["a", "b"], "tau", "w").collect()}
    for g, (y, X, tau, w) in groups.items():
        best, beta = by_vertices(y, X, tau, w)
        assert abs(got[g].objective - best) <= 1e-8 * best and loss(y - X @ np.array(got[g].beta), tau, w) <= best * (1 + 1e-8) and got[g].n == w.sum()
        if g not in (4, 5):  # weights and ties may leave several minima
            assert np.allclose(got[g].beta, beta, rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("most", [40, 400])
def test_large_group_is_optimal(spark, most):
    r = np.random.default_rng(2)
    n, tau = 4000, 0.8
    X = np.column_stack([np.ones(n), r.normal(size=(n, 2))])
    y = X @ [1, 2, -1] + r.standard_t(2, n) * np.exp(X[:, 1] / 2)
    (got,) = Q.quantile_fit(spark.createDataFrame(frame({0: (y, X, tau, 1.0)})), ["g"], "y", ["a", "b"], "tau", most=most).collect()
    u = y - X @ np.array(got.beta)
    on = np.argsort(np.abs(u))[:3]
    vertex = np.linalg.solve(X[on], y[on])
    v = y - X @ vertex
    # dual values of the rows on the fit lie between tau - 1 and tau only at an optimum
    rest = np.setdiff1d(np.arange(n), on)
    dual = np.linalg.solve(X[on].T, -X[rest].T @ np.where(v[rest] > 0, tau, tau - 1))
    assert ((dual >= tau - 1) & (dual <= tau)).all()
    assert abs(got.objective - loss(v, tau)) <= 1e-8 * loss(v, tau) and np.allclose(got.beta, vertex, atol=1e-5)


def test_projections_and_replicates(spark):
    r = np.random.default_rng(3)
    rows = []
    for c in ("one", "two"):
        x = r.normal(size=160)
        y = np.cumsum(0.4 * x + r.normal(size=160) * (1 + 0.5 * np.abs(x)))
        rows += [(c, t, float(x[t]), float(y[t])) for t in range(160)]
    d = pd.DataFrame(rows, columns=["c", "t", "x", "y"])
    df = spark.createDataFrame(d)
    got = {(g.c, g.h, g.tau): g for g in Q.quantile_lp(df, ["c"], "t", "y", "x", [0, 2], [0.25, 0.5], 1, replicates=30).collect()}
    assert len(got) == 8
    for (c, h, tau), g in got.items():
        s = d[d.c == c]
        z = pd.DataFrame({"dy": s.y.shift(-h) - s.y.shift(1), "x": s.x, "x1": s.x.shift(1), "y1": s.y.shift(1)}).dropna()
        X, y = np.column_stack([np.ones(len(z)), z[["x", "x1", "y1"]]]), z.dy.to_numpy()
        assert g.n == len(z) and g.lo < g.beta < g.hi
        # the objective as a function of the target alone, around the estimate
        assert all(g.objective <= loss(y - X @ np.array(b), tau) + 1e-7 for b in [np.linalg.lstsq(X, y, rcond=None)[0]])


def test_nulls_collinear_exact_and_empty(spark):
    rows = [(1, 0.5, float(t), float(t), float(2 * t)) for t in range(8)] + [(2, 0.5, float(t % 3), float(t), 1.0) for t in range(9)] + [(2, 0.5, None, 1.0, 1.0), (2, 0.5, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, tau double, y double, a double, b double")
    got = {x.g: x for x in Q.quantile_fit(df, ["g"], "y", ["a", "b"], "tau").collect()}
    assert got[1].objective < 1e-6 and got[1].n == 8 and got[2].n == 9
    X, y = np.column_stack([np.ones(9), np.arange(9.0)]), np.arange(9) % 3.0
    assert np.isclose(got[2].objective, by_vertices(y, X, 0.5)[0], rtol=1e-8)
    assert Q.quantile_fit(df.where("g > 5"), ["g"], "y", ["a", "b"], "tau").count() == 0
    with pytest.raises(RuntimeError, match="passes"):
        Q.quantile_fit(df, ["g"], "y", ["a", "b"], "tau", most=5, passes=1)


def test_few_rows(spark):
    """The solver alone: with sums of far rows, and with more regressors than rows say."""
    r = np.random.default_rng(4)
    for n, k in ((1, 1), (2, 3), (9, 2), (30, 3)):
        x, y, w = np.column_stack([np.ones(n), r.normal(size=(n, k - 1))]), r.normal(size=n), r.integers(1, 4, n).astype(float)
        b = Q.minimum(y, x, w, 0.3, np.zeros(k))
        if n >= k:
            assert loss(y - x @ b, 0.3, w) <= by_vertices(y, x, 0.3, w)[0] * (1 + 1e-8) + 1e-10
        else:
            assert loss(y - x @ b, 0.3, w) < 1e-8
    x, y = np.column_stack([np.ones(40), r.normal(size=40)]), r.normal(size=40)
    far = x[:5].T @ np.full(5, 0.3)
    y[:5] += 100
    assert np.allclose(Q.minimum(y[5:], x[5:], np.ones(35), 0.3, far), by_vertices(y, x, 0.3)[1])
