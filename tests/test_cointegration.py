"""Unit-root and cointegration statistics against plain numpy."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from loomline.functions import stats
from loomline.operators import cointegration as C


def series(seed=2, n=80):
    r = np.random.default_rng(seed)
    rows = []
    for code in "ab":
        x = np.cumsum(r.standard_normal(n)) + (5 * (np.arange(n) > 40) if code == "b" else 0)
        y = 1 + 2 * x + r.standard_normal(n)
        rows += [(code, t, float(x[t]), float(y[t])) for t in range(n)]
    return pd.DataFrame(rows, columns=["code", "t", "x", "y"])


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(series())


def ols(y, a):
    inv = np.linalg.inv(a.T @ a)
    b = inv @ a.T @ y
    u = y - a @ b
    return b, inv, u, b / np.sqrt(u @ u / (len(y) - a.shape[1]) * np.diag(inv))


def lagged(v, k):
    d = np.diff(v)
    return d[k:], np.column_stack([v[k:-1], *[d[k - j : len(d) - j] for j in range(1, k + 1)]])


def test_phillips_perron(frame):
    got = {(r.code, k): r.pp_t for k in (None, 3) for r in C.phillips_perron(frame, ["code"], "t", "x", k).collect()}
    for code, g in series().groupby("code"):
        v = g.x.to_numpy()
        d, a = np.diff(v), np.column_stack([np.ones(79), v[:-1]])
        _, inv, u, t = ols(d, a)
        for k in (None, 3):
            lags = int(np.ceil(4 * (80 / 100) ** 0.25)) if k is None else k
            g0 = u @ u / 79
            s = g0 + sum(2 * (1 - l / (lags + 1)) * (u[l:] @ u[:-l]) / 79 for l in range(1, lags + 1))
            assert np.isclose(got[code, k], np.sqrt(g0 / s) * t[1] - 0.5 * (s - g0) * np.sqrt(79 * inv[1, 1]) / s)


def test_zivot_andrews_and_gls(frame):
    got = {r.code: r for r in C.zivot_andrews(frame, ["code"], "t", "x", 2).collect()}
    gls = {r.code: r.dfgls_t for r in C.df_gls(frame, ["code"], "t", "x", 1).collect()}
    for code, g in series().groupby("code"):
        v = g.x.to_numpy()
        d, a = lagged(v, 2)
        all_ = [(ols(d, np.column_stack([a, np.ones(len(d)), np.arange(3, 80) > b]))[3][0], b) for b in range(12, 69)]
        assert np.isclose(got[code].za_t, min(all_)[0]) and got[code].break_at == min(all_)[1]
        alpha = 1 - 7 / 80
        z = np.concatenate([[1], np.full(79, 1 - alpha)])
        q = np.concatenate([v[:1], v[1:] - alpha * v[:-1]])
        d, a = lagged(v - z @ q / (z @ z), 1)
        assert np.isclose(gls[code], ols(d, a)[3][0])


def test_engle_granger_and_dynamic_ols(frame):
    got = {r.code: r for r in C.engle_granger(frame, ["code"], "t", "y", "x").collect()}
    dyn = {r.code: r for r in C.dynamic_ols(frame, ["code"], "t", "y", "x").collect()}
    for code, g in series().groupby("code"):
        x, y = g.x.to_numpy(), g.y.to_numpy()
        b, _, u, _ = ols(y, np.column_stack([np.ones(80), x]))
        d, a = lagged(u, 4)
        t = ols(d, np.column_stack([a, np.ones(len(d))]))[3][0]
        assert np.isclose(got[code].beta, b[1]) and np.isclose(got[code].adf_t, t) and np.isclose(got[code].p_value, stats.norm_cdf((t + 1.61) / 0.94))
        dx = np.concatenate([[0], np.diff(x)])
        a = np.column_stack([np.ones(76), x[2:78], *[dx[2 + s : 78 + s] for s in (-2, -1, 1, 2)]])
        b, inv, u, _ = ols(y[2:78], a)
        q = (a @ inv[1]) * u
        v = q @ q + sum(2 * (1 - l / 4) * (q[l:] @ q[:-l]) for l in (1, 2, 3))
        assert np.isclose(dyn[code].beta, b[1]) and np.isclose(dyn[code].se, np.sqrt(v))


def test_johansen(spark):
    g = series()[series().code == "a"]
    got = C.johansen(spark.createDataFrame(g[["t", "x", "y"]]), "t", ["x", "y"], 2)
    v = g[["x", "y"]].to_numpy()
    d, l, s = np.diff(v, axis=0)[1:], v[1:-1], np.column_stack([np.ones(78), np.diff(v, axis=0)[:-1]])
    r0, r1 = d - s @ np.linalg.lstsq(s, d, rcond=None)[0], l - s @ np.linalg.lstsq(s, l, rcond=None)[0]
    m = np.linalg.inv(r1.T @ r1) @ r1.T @ r0 @ np.linalg.inv(r0.T @ r0) @ r0.T @ r1
    e = np.sort(np.linalg.eigvals(m).real)[::-1]
    assert np.allclose(got.trace, [-78 * np.log(1 - e).sum(), -78 * np.log(1 - e[1])]) and list(got.cv_5) == [12.32, 3.84]


def test_breaks_are_the_least_of_all(spark):
    v = np.random.default_rng(3).standard_normal(24) + np.repeat([0, 3, -2], 8)
    df = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate(v)], "code string, t int, y double")
    got = {r.breaks: r for r in C.bai_perron(df, ["code"], "t", "y", 2).collect()}
    sse = lambda cuts: sum(((p - p.mean()) ** 2).sum() for p in np.split(v, cuts))
    for m in (0, 1, 2):
        every = [c for c in combinations(range(3, 22), m) if all(b - a >= 3 for a, b in zip((0, *c), (*c, 24)))]
        want = min(every, key=lambda c: sse(list(c)))
        assert np.isclose(got[m].ssr, sse(list(want))) and tuple(got[m].at) == want
