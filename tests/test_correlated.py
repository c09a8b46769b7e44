"""Numbers of factors and variances with constant correlations, against plain numpy."""

import numpy as np
import pandas as pd

from loomline.operators import series


def test_factor_criteria(spark):
    # columns with the same share of noise, as the penalties suppose
    r = np.random.default_rng(5)
    x = r.standard_normal((120, 2)) @ r.choice([-1.0, 1.0], (2, 30)) + 0.5 * r.standard_normal((120, 30))
    cols = [f"c{i}" for i in range(30)]
    got = series.factor_criteria(spark.createDataFrame(pd.DataFrame(x, columns=cols)), cols, 5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    for k in range(6):
        left = ((z - (u[:, :k] * s[:k]) @ v[:k]) ** 2).mean()
        rate = (30 + 120) / (30 * 120)
        assert np.isclose(got.unexplained[k], left)
        assert np.allclose(got.loc[k, ["ic1", "ic2", "ic3"]].astype(float), np.log(left) + k * np.array([rate * np.log(1 / rate), rate * np.log(30), np.log(30) / 30]))
    assert got.ic2.idxmin() == 2


def test_constant_correlations(spark):
    r = np.random.default_rng(8)
    e = r.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 300)
    h, u = np.ones(2), np.zeros((300, 2))
    for t in range(300):
        u[t] = np.sqrt(h) * e[t]
        h = 0.1 + 0.1 * u[t] ** 2 + 0.8 * h
    rows = [(c, t, float(u[t, i])) for i, c in enumerate("xy") for t in range(300) if (c, t) != ("y", 17)] + [("short", 0, 1.0), ("x", 400, None)]
    df = spark.createDataFrame(rows, "code string, t int, r double")
    paths, pairs, loglik = series.ccc_garch(df, "code", "t", "r")
    fit = {f.code: f for f in series.garch_fit(df, ["code"], "t", "r").collect()}
    s = {}
    for c in "xy":
        own = sorted((t, v) for k, t, v in rows if k == c and v is not None)
        var = series.garch_variance(np.array([v for _, v in own]), fit[c].omega, fit[c].alpha, fit[c].beta)
        s |= {(c, t): (v, w) for (t, v), w in zip(own, var, strict=True)}
    assert {(p.code, p.t) for p in paths.collect()} == set(s) and all(np.isclose(p.sigma2, s[p.code, p.t][1]) for p in paths.collect())
    dates = [t for t in range(300) if t != 17]
    z = np.array([[s[c, t][0] / np.sqrt(s[c, t][1]) for c in "xy"] for t in dates])
    rho = np.corrcoef(z, rowvar=False)
    got = {(p.i, p.j): p.rho for p in pairs.collect()}
    assert np.isclose(got["x", "y"], rho[0, 1]) and abs(got["x", "y"] - 0.6) < 0.1 and np.isclose(got["x", "x"], 1)
    want = 0.0
    for t in dates:
        d = np.diag([np.sqrt(s[c, t][1]) for c in "xy"])
        cov, v = d @ rho @ d, np.array([s[c, t][0] for c in "xy"])
        want += -0.5 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(cov)) + v @ np.linalg.solve(cov, v))
    assert np.isclose(loglik, want)
    cov = {(c.t, c.i, c.j): c.cov for c in series.ccc_covariance(paths, pairs, "code", "t").collect()}
    assert np.isclose(cov[3, "x", "y"], rho[0, 1] * np.sqrt(s["x", 3][1] * s["y", 3][1])) and (17, "x", "y") not in cov and (17, "x", "x") in cov
