"""Identification, draws and systems against dense linear algebra."""

import numpy as np
import pandas as pd
import pytest

from loomline.operators import series, svar


def system(n=150, seed=21):
    r = np.random.default_rng(seed)
    a, mix, y = np.array([[0.5, 0.1], [-0.2, 0.3]]), np.array([[1.0, 0.2], [0.5, 0.8]]), np.zeros((n, 2))
    e = r.standard_normal((n, 2)) * np.where(np.arange(n)[:, None] > n // 2, [2.0, 1.0], 1.0)
    for t in range(1, n):
        y[t] = 0.1 + a @ y[t - 1] + mix @ e[t]
    return pd.DataFrame({"t": range(n), "a": y[:, 0], "b": y[:, 1], "z": e[:, 0] + 0.5 * r.standard_normal(n), "r": (np.arange(n) > n // 2).astype(int)})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(system())


def dense(p, d=None):
    y = (system() if d is None else d)[["a", "b"]].to_numpy()
    x = np.column_stack([np.ones(len(y) - p), *[y[p - k - 1 : len(y) - k - 1] for k in range(p)]])
    b = np.linalg.lstsq(x, y[p:], rcond=None)[0]
    u = y[p:] - x @ b
    return b, u, u.T @ u / (len(u) - x.shape[1])


def test_lag_choice_and_block_exogeneity(frame):
    c = svar.lag_criteria(frame, "t", ["a", "b"], 3)
    got = {r.p: r for r in c.collect()}
    for p in (1, 2, 3):
        t, logdet = 150 - p, np.linalg.slogdet(dense(p)[2])[1]
        assert np.allclose([got[p].aic, got[p].bic, got[p].hq], [logdet + 8 * p / t, logdet + 4 * p * np.log(t) / t, logdet + 8 * p * np.log(np.log(t)) / t])
    assert svar.lag_choice(c) == min(got.values(), key=lambda r: (r.bic, r.p)).p
    stat, p, d1, d2 = svar.block_exogeneity(frame, "t", ["a", "b"], ["b"], 2)
    y = system()[["a", "b"]].to_numpy()
    one = np.column_stack([np.ones(148), y[1:-1, 0], y[:-2, 0]])
    full = np.column_stack([one, y[1:-1, 1], y[:-2, 1]])
    r0, r1 = (((y[2:, 0] - x @ np.linalg.lstsq(x, y[2:, 0], rcond=None)[0]) ** 2).sum() for x in (one, full))
    assert (d1, d2) == (2, 143) and np.isclose(stat, (r0 - r1) / 2 / (r1 / 143)) and 0 < p < 1


def test_identification(frame):
    constant, a, sigma, _ = series.var_ols(frame, "t", ["a", "b"], 1)
    _, u, s = dense(1)
    got = svar.residuals(frame, "t", ["a", "b"], 1, constant, a).orderBy("t").toPandas()
    assert np.allclose(got[["u_a", "u_b"]], u)
    for k in (0, 1):
        b = svar.long_run(a, sigma, k)
        c = np.linalg.inv(np.eye(2) - a[0]) @ b
        assert np.allclose(b @ b.T, sigma) and abs(c[k, 1 - k]) < 1e-10
    d = system().iloc[1:]
    pi = u.T @ d.z / (d.z @ d.z)
    column, f = svar.proxy_impact(frame, "t", ["a", "b"], "z", 1)
    z, v = d.z - d.z.mean(), u[:, 0] - u[:, 0].mean()
    slope = z @ v / (z @ z)
    assert np.allclose(column, s @ pi / np.sqrt(pi @ s @ pi)) and np.isclose(f, slope**2 * (z @ z) ** 2 / ((z * (v - slope * z)) ** 2).sum())
    news = svar.max_share(a, sigma, 1, 10)
    share = lambda c: ((series.moving_average(a, 10) @ c)[:, 1] ** 2).sum()
    chol = np.linalg.cholesky(sigma)
    assert all(share(chol @ [np.cos(x), np.sin(x)]) <= share(news) + 1e-9 for x in np.linspace(0, np.pi, 40))
    impact, variances = svar.by_variance(frame, "t", ["a", "b"], "r", 1)
    u0, u1 = u[d.r == 0], u[d.r == 1]
    assert np.allclose(impact @ impact.T, u0.T @ u0 / (len(u0) - 1)) and np.allclose(impact @ np.diag(variances) @ impact.T, u1.T @ u1 / (len(u1) - 1))


def test_history_adds_up(frame):
    constant, a, sigma, _ = series.var_ols(frame, "t", ["a", "b"], 1)
    got = svar.history(frame, "t", ["a", "b"], 1, np.linalg.cholesky(sigma)).toPandas()
    y = system()[["a", "b"]].to_numpy()
    base = [y[0]]
    for _ in range(149):
        base.append(constant + a[0] @ base[-1])
    total = got.groupby(["t", "column"]).value.sum().unstack()
    assert np.allclose(total.to_numpy(), (y - np.array(base))[1:])


def test_rotations_and_bands(spark, frame):
    _, a, sigma, _ = series.var_ols(frame, "t", ["a", "b"], 1)
    draws = svar.rotations(spark, a, sigma, {0: [1, 1], 1: [1, 0]}, 300, 4)
    p = draws.toPandas()
    kept = p.pivot(index="draw", columns=["h", "response"], values="value")
    assert 10 < len(kept) < 300 and (kept[(0, 0)] >= 0).all() and (kept[(0, 1)] >= 0).all() and (kept[(1, 0)] >= 0).all()
    chol = np.linalg.cholesky(sigma)
    assert np.allclose((np.linalg.solve(chol, kept[[(0, 0), (0, 1)]].to_numpy().T) ** 2).sum(axis=0), 1)
    b = svar.bands(draws, ["h", "response"], 0.2).where("h = 1 and response = 1").first()
    assert np.allclose([b.median, b.lo, b.hi], np.percentile(kept[(1, 1)], [50, 10, 90])) and b.n == len(kept)
    j = {(r.h, r.response): r for r in svar.joint_bands(draws, ["h", "response"]).collect()}
    far = (np.abs(kept - kept.mean()) / kept.std()).max(axis=1)
    assert all(np.isclose(j[k].hi, kept[k].mean() + np.quantile(far, 0.9) * kept[k].std()) for k in kept.columns)


@pytest.mark.parametrize("kind", ["recursive", "wild", "block"])
def test_bootstrap(frame, kind):
    identify = lambda a, s: np.linalg.cholesky(s)
    d = svar.bootstrap(frame, "t", ["a", "b"], 1, identify, 40, 3, kind)
    p, again = d.toPandas(), d.toPandas()
    _, a, sigma, _ = series.var_ols(frame, "t", ["a", "b"], 1)
    point = np.linalg.cholesky(sigma)
    mean = p[p.h == 0].groupby(["response", "shock"]).value.mean()
    assert len(p) == 40 * 4 * 4 and p.equals(again) and abs(mean["a", "a"] - point[0, 0]) < 0.2 and (p[(p.h == 0) & (p.response == "a") & (p.shock == "b")].value == 0).all()


def test_threshold_is_the_best_of_all(spark):
    r = np.random.default_rng(5)
    y = np.zeros((120, 1))
    s = r.standard_normal(120)
    for t in range(1, 120):
        y[t] = (2.0 if s[t - 1] > 0.3 else -1.0) + 0.3 * y[t - 1] + 0.2 * r.standard_normal()
    df = spark.createDataFrame([(t, float(y[t, 0]), float(s[t])) for t in range(120)], "t int, y double, s double")
    got = svar.threshold_var(df, "t", ["y"], "s", 1, (1, 2)).first()
    cells = []
    for q in np.quantile(s[:-1], 0.15 + 0.7 * np.arange(25) / 24):
        high, ssr = s[:-1] > q, 0.0
        for side in (high, ~high):
            x, v = np.column_stack([np.ones(119), y[:-1, 0]])[side], y[1:, 0][side]
            ssr += ((v - x @ np.linalg.lstsq(x, v, rcond=None)[0]) ** 2).sum()
        if min(high.sum(), (~high).sum()) >= 0.15 * 119:
            cells.append((ssr, q))
    assert np.isclose(got.ssr, min(cells)[0]) and np.isclose(got.threshold, min(cells)[1]) and got.delay == 1


@pytest.mark.parametrize("p,block", [(1, None), (2, 3.0)])
def test_replicates_of_resampled_rows(frame, p, block):
    import hashlib

    draw = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32
    got = {(r.draw, r.h, r.response, r.shock): r.value for r in svar.replicates(frame, "t", ["a", "b"], p, lambda a, s: np.linalg.cholesky(s), 5, 3, block, 7).collect()}
    y = system()[["a", "b"]].to_numpy()
    x = np.column_stack([np.ones(len(y) - p), *[y[p - k - 1 : len(y) - k - 1] for k in range(p)]])
    t, y = len(x), y[p:]
    length = block or round(t ** (1 / 3))
    assert len(got) == 5 * 4 * 4
    for k in range(5):
        at = []
        for place in range(1, t + 1):
            new = place == 1 or draw("new", 7, 1, k + 1, place) < 1 / length
            at.append(int(draw("at", 7, 1, k + 1, place) * t) if new else (at[-1] + 1) % t)
        beta = np.linalg.lstsq(x[at], y[at], rcond=None)[0]
        u = y[at] - x[at] @ beta
        path = series.moving_average(np.array([beta[1 + 2 * j : 3 + 2 * j].T for j in range(p)]), 3) @ np.linalg.cholesky(u.T @ u / (t - 1 - 2 * p))
        assert all(np.isclose(got[k, h, "ab"[i], "ab"[j]], path[h, i, j]) for h in range(4) for i in range(2) for j in range(2))
