"""Priors, smoothing, shares of variance and table functions."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest

from loomline.functions import tables
from loomline.operators import bayes as B
from loomline.operators import regression as G
from loomline.operators import smoothing as M


def system(n=120, seed=3):
    r = np.random.default_rng(seed)
    a, y = np.array([[0.5, 0.1, 0], [-0.2, 0.3, 0.1], [0, 0.2, 0.6]]), np.zeros((n, 3))
    for t in range(1, n):
        y[t] = a @ y[t - 1] + r.normal(size=3) * [1, 2, 0.5] + 0.3
    return y


@pytest.mark.parametrize("p", [1, 3])
def test_minnesota(spark, p):
    y, n, cols = system(), 3, ["a", "b", "c"]
    m = B.var_moments(spark.createDataFrame(pd.DataFrame(y, columns=cols).assign(t=range(len(y)))), "t", cols, p)
    x, d = np.column_stack([np.ones(len(y) - p), *[y[p - k : len(y) - k] for k in range(1, p + 1)]]), y[p:]
    sd = []
    for i in range(n):
        own = x[:, [0, *[1 + k * n + i for k in range(p)]]]
        sd.append(np.std(d[:, i] - own @ np.linalg.lstsq(own, d[:, i], rcond=None)[0]))
    assert np.allclose(B.own_deviations(m), sd) and m.t == len(d)
    constant, a, sigma = B.minnesota_mean(m, 0.3, 0.4, 1.5)
    betas = []
    for i in range(n):
        rows, right = [np.eye(1 + n * p)[0] / 1e3], [0.0]
        for lag in range(1, p + 1):
            for j in range(n):
                w = sd[j] * lag**1.5 / (0.3 if i == j else 0.12)
                rows.append(np.eye(1 + n * p)[1 + (lag - 1) * n + j] * w)
                right.append(w if lag == 1 and i == j else 0.0)
        beta = np.linalg.lstsq(np.vstack([x, rows]), np.concatenate([d[:, i], right]), rcond=None)[0]
        betas.append(beta)
        assert np.isclose(constant[i], beta[0]) and np.allclose(a[:, i], beta[1:].reshape(p, n))
    u = d - x @ np.array(betas).T
    assert np.allclose(sigma, u.T @ u / (len(d) - 1))
    post = B.minnesota_posterior(m, 0.3, 1.5)
    w = np.array([sd[j] * lag**1.5 / 0.3 for lag in range(1, p + 1) for j in range(n)])
    xd = np.vstack([np.eye(1 + n * p)[:1] / 1e3, np.column_stack([np.zeros(n * p), np.diag(w)]), np.zeros((n, 1 + n * p))])
    yd = np.vstack([np.zeros((1, n)), np.diag(w[:n]), np.zeros((n * p - n, n)), np.diag(sd)])
    xs, ys = np.vstack([x, xd]), np.vstack([d, yd])
    mean = np.linalg.lstsq(xs, ys, rcond=None)[0]
    v = ys - xs @ mean
    assert np.allclose(post.mean, mean) and np.allclose(post.scale, v.T @ v) and np.allclose(post.inverse, np.linalg.inv(xs.T @ xs)) and post.freedom == len(xs) - xs.shape[1]


def test_posterior_draws(spark):
    y, cols = system(), ["a", "b", "c"]
    post = B.minnesota_posterior(B.var_moments(spark.createDataFrame(pd.DataFrame(y, columns=cols).assign(t=range(len(y)))), "t", cols, 1))
    draws = [B.draw(post, 5, k) for k in range(4000)]
    sigma = np.mean([s for _, s in draws], axis=0)
    assert np.allclose(sigma, post.scale / (post.freedom - 4), rtol=0.05, atol=0.02) and np.allclose(np.mean([b for b, _ in draws], axis=0), post.mean, atol=0.03)
    assert np.allclose(np.var([b[1, 0] for b, _ in draws]), sigma[0, 0] * post.inverse[1, 1], rtol=0.12)
    got = {(r.draw, r.h, r.response, r.shock): r.value for r in B.posterior_responses(spark, cols, post, 7, 2, 5).collect()}
    b, s = draws[6]
    assert len(got) == 7 * 3 * 9 and np.isclose(got[6, 1, "b", "a"], (b[1:].T @ np.linalg.cholesky(s))[1, 0])


def test_splines_and_smooth_responses(spark):
    x = np.arange(13.0)
    b = M.spline_basis(x, 6)
    assert b.shape == (13, 8) and np.allclose(b.sum(axis=1), 1) and (b >= 0).all()
    for f in (np.ones(13), x, x**2, x**3):  # cubics are in their span
        assert np.allclose(b @ np.linalg.lstsq(b, f, rcond=None)[0], f)
    assert np.allclose(M.smoother(x, 6, 2.0) @ np.ones(13), 1) and np.allclose(M.smoother(x, 6, 1e9) @ b @ np.arange(8.0), b @ np.arange(8.0), atol=1e-5)  # lines of coefficients cost nothing
    r = np.random.default_rng(1)
    rows = [(g, h, float(np.sin(h / 3) + 0.3 * r.normal()), 0.1 + 0.01 * h) for g in "ab" for h in range(13)] + [("c", h, 1.0, 0.1) for h in range(3)] + [("a", 13, None, 0.1)]
    d = spark.createDataFrame(rows, "g string, h int, beta double, se double")
    for penalty in (None, 2.0):
        got = M.smooth_responses(d, ["g"], penalty=penalty).toPandas().sort_values(["g", "h"])
        assert set(got.g) == {"a", "b"}
        for g, s in got.groupby("g"):
            raw = np.array([v for k, _, v, _ in rows if k == g and v is not None])
            D = np.diff(np.eye(8), n=2, axis=0)
            lam = penalty
            if lam is None:
                fits = {p: b @ np.linalg.lstsq(np.vstack([b, np.sqrt(p) * D]), np.concatenate([raw, np.zeros(6)]), rcond=None)[0] for p in np.logspace(-3, 4, 30)}
                trace = {p: np.trace(b @ np.linalg.solve(b.T @ b + p * D.T @ D, b.T)) for p in fits}
                lam = min(fits, key=lambda p: ((raw - fits[p]) ** 2).sum() / (1 - trace[p] / 13) ** 2)
            want = b @ np.linalg.lstsq(np.vstack([b, np.sqrt(lam) * D]), np.concatenate([raw, np.zeros(6)]), rcond=None)[0]
            assert np.allclose(s.beta, want) and np.allclose(s.penalty, lam) and (s.se < 0.25).all()


def test_shapley_of_all_orders(spark):
    r = np.random.default_rng(2)
    g, w = r.normal(size=(30, 4)) @ r.normal(size=(4, 4)), r.uniform(0.1, 1, 4)
    rows = [("k", t, f"c{i}", float(g[t, i]), float(w[i])) for t in range(30) for i in range(4)] + [("k", 30, "c0", 9.0, 1.0), ("k", 31, "c1", None, 1.0), ("flat", 1, "x", 1.0, 1.0), ("flat", 2, "x", 1.0, 1.0)]
    got = {(s.k, s.component): s for s in M.shapley_variance(spark.createDataFrame(rows, "k string, t int, c string, g double, w double"), ["k"], "t", "c", "g", "w").collect()}
    parts, phi = g * w, np.zeros(4)
    v = lambda s: np.var(parts[:, s].sum(axis=1)) if s else 0.0
    for order in permutations(range(4)):
        for k, i in enumerate(order):
            phi[i] += (v(list(order[: k + 1])) - v(list(order[:k]))) / 24
    assert all(np.isclose(got["k", f"c{i}"].phi, phi[i]) and np.isclose(got["k", f"c{i}"].share, phi[i] / phi.sum()) and got["k", f"c{i}"].n == 30 for i in range(4))
    assert got["flat", "x"].phi == 0 and got["flat", "x"].share is None


def test_table_function(spark):
    r = np.random.default_rng(4)
    rows = [(k, t, None if t == 9 else float(r.normal()), float(r.normal())) for k in (1, 2) for t in range(60)] + [(3, t, 1.0, 1.0) for t in range(3)]
    df = spark.createDataFrame(rows, "code long, date int, y double, x double")
    df.createOrReplaceTempView("series")
    tables.register(spark)
    got = spark.sql("SELECT * FROM lp_hac(TABLE(SELECT * FROM series) PARTITION BY code ORDER BY (date), 'code', 'date', 'y', 'x', 3)")
    assert got.dtypes == [("code", "bigint"), ("h", "int"), ("beta", "double"), ("se", "double"), ("t", "double"), ("n", "bigint")]
    want = {(w.code, w.h): w for w in G.lp_hac(df.where("code < 3"), ["code"], "date", "y", "x", [0, 1, 2, 3]).collect()}
    rows = got.collect()
    assert len(rows) == len(want) == 8
    assert all(np.allclose([g.beta, g.se, g.t, g.n], [w.beta, w.se, w.t, w.n]) for g in rows for w in [want[g.code, g.h]])
    for bad in ("'nothing', 'date', 'y', 'x', 3", "'code', 'date', 'y', 'x', -1"):
        with pytest.raises(Exception, match="column|whole"):
            spark.sql(f"SELECT * FROM lp_hac(TABLE(series) PARTITION BY code ORDER BY (date), {bad})").collect()
    assert spark.sql("SELECT * FROM lp_hac(TABLE(SELECT * FROM series WHERE code > 5) PARTITION BY code ORDER BY (date), 'code', 'date', 'y', 'x', 3, 1)").count() == 0
