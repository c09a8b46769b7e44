"""Estimators against closed forms in numpy."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from loomline.operators import did, regression, series


def panel(n=6, t=60, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = r.standard_normal(t)
        y = np.zeros(t)
        for k in range(1, t):
            y[k] = 0.5 * y[k - 1] + 0.6 * x[k] + 0.3 * r.standard_normal() + 0.1 * i
        rows += [(f"c{i}", k, float(y[k]), float(x[k])) for k in range(t)]
    return pd.DataFrame(rows, columns=["code", "t", "y", "x"])


def design(g, h, p):
    d = pd.DataFrame({"dy": g.y.shift(-h) - g.y.shift(1), "x": g.x})
    for l in range(1, p + 1):
        d[f"xl{l}"], d[f"yl{l}"] = g.x.shift(l), g.y.shift(l)
    return d.dropna()


def ols(y, X):
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    return b, inv, y - X @ b


def hac(s, lags):
    out = s.T @ s
    for l in range(1, lags + 1):
        g = s[l:].T @ s[:-l]
        out += (1 - l / (lags + 1)) * (g + g.T)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(panel())


def test_lp_hac(frame):
    got = {(r.code, r.h): r for r in regression.lp_hac(frame, ["code"], "t", "y", "x", [0, 1, 3], 2).collect()}
    for code, g in panel().groupby("code"):
        for h in (0, 1, 3):
            d = design(g, h, 2)
            X = np.column_stack([np.ones(len(d)), d.drop(columns="dy")])
            b, inv, u = ols(d.dy.to_numpy(), X)
            v = inv @ hac(X * u[:, None], h + 1) @ inv
            r = got[code, h]
            assert r.n == len(d) and np.isclose(r.beta, b[1]) and np.isclose(r.se, np.sqrt(v[1, 1]))


def within(d, cols):
    return d[cols] - d.groupby("code")[cols].transform("mean") - d.groupby("t")[cols].transform("mean") + d[cols].mean()


def test_panel_lp_and_identity_across_errors(frame):
    a = {r.h: r for r in regression.panel_lp(frame, "code", "t", "y", "x", [0, 2], 1).collect()}
    b = {r.h: r for r in regression.panel_lp(frame, "code", "t", "y", "x", [0, 2], 1, se="dk").collect()}
    for h in (0, 2):
        parts = [design(g, h, 1).assign(code=c, t=design(g, h, 1).index.map(g.t)) for c, g in panel().groupby("code")]
        d = pd.concat(parts).reset_index(drop=True)
        w = within(d, ["dy", "x", "xl1", "yl1"])
        X = w[["x", "xl1", "yl1"]].to_numpy()
        beta, inv, u = ols(w.dy.to_numpy(), X)
        s = pd.DataFrame(X * u[:, None]).groupby(d.code).sum().to_numpy()
        v = inv @ (s.T @ s) @ inv
        assert np.isclose(a[h].beta, beta[0]) and np.isclose(a[h].se, np.sqrt(v[0, 0])) and abs(a[h].beta - b[h].beta) < 1e-12
        times = pd.DataFrame(X * u[:, None]).groupby(d.t).sum().to_numpy()
        lags = int(max(1, np.floor(4 * (len(d) / 100) ** (2 / 9) + 0.5)))
        assert np.isclose(b[h].se, np.sqrt((inv @ hac(times, lags) @ inv)[0, 0]))


def test_iv_with_the_regressor_itself_is_ols(frame):
    f = frame.withColumn("z", frame.x)
    iv = {(r.code, r.h): r.beta for r in regression.lp_iv(f, ["code"], "t", "y", "x", "z", [0, 1], 1).collect()}
    own = {(r.code, r.h): r.beta for r in regression.lp_hac(frame, ["code"], "t", "y", "x", [0, 1], 1).collect()}
    assert all(np.isclose(iv[k], own[k]) for k in own)


def test_iv_keeps_its_digits_where_levels_exceed_spreads(spark):
    """Series around 23 and 10 that move by hundredths, and an instrument close to the regressor."""
    r, n = np.random.default_rng(5), 80
    x = 10 + 0.05 * r.standard_normal(n)
    g = pd.DataFrame({"t": range(n), "y": 13 + x + 0.02 * r.standard_normal(n), "x": x, "z": x + 3e-4 * (np.arange(n) % 3) + 1e-5 * r.standard_normal(n), "flat": 0.1})
    df = spark.createDataFrame(g.assign(code="a"))
    (got,) = regression.lp_iv(df, ["code"], "t", "y", "x", "z", [0], 1).collect()
    d = design(g, 0, 1).assign(z=g.z)
    Q, _ = np.linalg.qr((d[["xl1", "yl1"]] - d[["xl1", "yl1"]].mean()).to_numpy())
    out = lambda v: (lambda c: c - Q @ (Q.T @ c))((v - v.mean()).to_numpy())
    z, w = out(d.z), out(d.x)
    pi = z @ w / (z @ z)
    assert np.isclose(got.first_stage_f, pi**2 / hac((z * (w - pi * z) / (z @ z))[:, None], 1)[0, 0], rtol=1e-9, atol=0)
    # a regressor of one value is the constant again, and takes no part
    a, b = (regression.ols(df, ["code"], "y", xs, "x").first() for xs in (["x"], ["x", "flat"]))
    assert np.isclose(a.beta, b.beta) and np.isclose(a.se, b.se)


def test_mean_group_recovers_the_effect(frame):
    (r,) = regression.mean_group(frame, "code", "t", "y", "x", [0], 1).collect()
    assert abs(r.beta - 0.6) < 0.1 and r.n == 6 and r.lo < r.beta < r.hi


def test_adf_hamilton_and_granger(frame):
    got = {r.code: r for r in series.adf(frame, ["code"], "t", "y", 1).collect()}
    for code, g in panel().groupby("code"):
        d = pd.DataFrame({"dy": g.y.diff(), "l": g.y.shift(1), "d1": g.y.diff().shift(1)}).dropna()
        X = np.column_stack([np.ones(len(d)), d.l, d.d1])
        b, inv, u = ols(d.dy.to_numpy(), X)
        assert np.isclose(got[code].adf_t, b[1] / np.sqrt(u @ u / (len(d) - 3) * inv[1, 1]))
    cycle = series.hamilton(frame, ["code"], "t", "y", 4, 2).toPandas()
    assert np.allclose(cycle.groupby("code").cycle.mean(), 0, atol=1e-9)
    for r in series.granger(frame, ["code"], "t", "y", "x", 1).collect():
        g = panel()[lambda d: d.code == r.code]
        d = pd.DataFrame({"y": g.y, "l": g.y.shift(1), "x": g.x.shift(1)}).dropna()
        (_, _, u0), (_, _, u1) = (ols(d.y.to_numpy(), np.column_stack([np.ones(len(d)), d[c]])) for c in (["l"], ["l", "x"]))
        assert np.isclose(r.f_stat, (u0 @ u0 - u1 @ u1) / (u1 @ u1 / (len(d) - 3)))


def test_var_moments_and_decompositions(spark):
    """A three-variable system of our own with two lags, against least squares on stacked rows."""
    r = np.random.default_rng(11)
    a1, a2 = np.array([[0.4, -0.2, 0.0], [0.1, 0.3, 0.2], [0.0, 0.15, -0.3]]), np.diag([0.2, -0.1, 0.25])
    mix, y = np.array([[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [-0.4, 0.1, 0.5]]), np.zeros((260, 3))
    for t in range(2, 260):
        y[t] = 0.3 + a1 @ y[t - 1] + a2 @ y[t - 2] + mix @ r.standard_normal(3)
    df = spark.createDataFrame([(t, *map(float, v)) for t, v in enumerate(y)], "t int, a double, b double, c double")
    constant, est, sigma, n = series.var_ols(df, "t", ["a", "b", "c"], 2)
    X = np.column_stack([np.ones(258), y[1:-1], y[:-2]])
    beta = np.linalg.lstsq(X, y[2:], rcond=None)[0]
    u = y[2:] - X @ beta
    assert n == 258 and np.allclose(constant, beta[0]) and np.allclose(est[0], beta[1:4].T) and np.allclose(est[1], beta[4:].T) and np.allclose(sigma, u.T @ u / (258 - 7))
    psi = series.moving_average(est, 6)
    companion = np.block([[est[0], est[1]], [np.eye(3), np.zeros((3, 3))]])
    assert all(np.allclose(psi[h], np.linalg.matrix_power(companion, h)[:3, :3]) for h in range(7))
    assert np.allclose(series.fevd(psi @ np.linalg.cholesky(sigma)).sum(axis=2), 1)
    total, to, frm = series.spillover(series.gfevd(psi, sigma)[-1])
    assert 0 < total < 100 and np.isclose(to.sum(), frm.sum())


def test_effects_on_panels_with_holes(spark):
    """Within transformation, panel LP and imputation against dummy regressions where rows are missing."""
    r = np.random.default_rng(3)
    rows = [(int(h), f"e{i}", t, float(r.standard_normal() + i + t * t / 9), float(r.standard_normal() * (1 + i))) for h in (0, 1) for i in range(7) for t in range(12) if r.random() < 0.6 or t < 2]
    d = pd.DataFrame(rows, columns=["h", "e", "t", "y", "x"])
    got = regression.within(spark.createDataFrame(d), ["y", "x"], ["h"], "e", "t").toPandas().sort_values(["h", "e", "t"])
    for h, g in d.sort_values(["h", "e", "t"]).groupby("h"):
        dummies = np.column_stack([pd.get_dummies(g.e), pd.get_dummies(g.t)]).astype(float)
        for c in ("y", "x"):
            want = g[c] - dummies @ np.linalg.lstsq(dummies, g[c], rcond=None)[0]
            assert np.allclose(got[got.h == h][c], want, atol=1e-8)
    cells = [(i, t, float(i % 3 + t + r.standard_normal()), g) for i in range(24) for g in [None if i % 3 == 0 else 4 + i % 3] for t in range(9) if r.random() < 0.8]
    f = pd.DataFrame(cells, columns=["unit", "time", "y", "treat_time"])
    un = f[f.treat_time.isna() | (f.time < f.treat_time)]
    units, times = sorted(un.unit.unique()), sorted(un.time.unique())
    X = np.column_stack([(un.unit.to_numpy()[:, None] == units), (un.time.to_numpy()[:, None] == times)]).astype(float)
    beta = np.linalg.lstsq(X, un.y, rcond=None)[0]
    treated = f[f.time >= f.treat_time]
    treated = treated[treated.unit.isin(units) & treated.time.isin(times)]
    effect = treated.y - [beta[units.index(u)] + beta[len(units) + times.index(t)] for u, t in zip(treated.unit, treated.time)]
    want = effect.groupby(treated.time - treated.treat_time).mean()
    schema = "unit int, time int, y double, treat_time int"
    got = {r.e: r.att for r in did.imputation(spark.createDataFrame([(*map(int, c[:2]), c[2], c[3]) for c in cells], schema)).collect()}
    assert len(treated) > 30 and all(abs(got[e] - v) < 1e-8 for e, v in want.items() if len(f[(f.time - f.treat_time) == e]) == len(treated[(treated.time - treated.treat_time) == e]))


def test_garch_path_and_hp(spark):
    r = np.random.default_rng(1).standard_normal(50)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(r)], "code string, t int, r double")
    got = [x.sigma2 for x in series.garch_path(df, ["code"], "t", "r", 0.1, 0.2, 0.7).orderBy("t").collect()]
    s = [r.var()]
    for v in r[:-1]:
        s.append(0.1 + 0.2 * v * v + 0.7 * s[-1])
    assert np.allclose(got, s)
    s2 = np.eye(50) + 10.0 * np.diff(np.eye(50), 2, axis=0).T @ np.diff(np.eye(50), 2, axis=0)
    assert np.allclose(series.hp_trend(r, 10.0), np.linalg.solve(s2, r))
    hp = series.hp_filter(df, ["code"], "t", "r", 10.0).toPandas()
    assert np.allclose(hp.trend + hp.cycle, r[hp.t]) and abs(hp.cycle.sum()) < 1e-8


def test_garch_fit_finds_the_likeliest(spark):
    r = np.random.default_rng(4)
    v, s = [], 1.0
    for _ in range(1500):
        v.append(float(r.standard_normal() * np.sqrt(s)))
        s = 0.1 + 0.15 * v[-1] ** 2 + 0.75 * s
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate(v)] + [("b", t, 0.0) for t in range(99)], "code string, t int, r double")
    (got,) = series.garch_fit(df, ["code"], "t", "r").collect()
    x = np.array(v)
    loglik = lambda *p: -0.5 * (np.log(2 * np.pi * (h := series.garch_variance(x, *p))) + x * x / h).sum()
    assert abs(got.alpha - 0.15) < 0.06 and abs(got.beta - 0.75) < 0.12 and np.isclose(got.loglik, loglik(got.omega, got.alpha, got.beta))
    assert all(loglik(got.omega * a, got.alpha * b, min(0.99, got.beta * c)) <= got.loglik + 1e-6 for a, b, c in ((1.05, 1, 1), (0.95, 1, 1), (1, 1.05, 1), (1, 0.95, 1), (1, 1, 1.02), (1, 1, 0.98)))


def test_imputation_recovers_the_effect(spark):
    rows = [(i, t, float(i + 2 * t + (3 if g is not None and t >= g else 0)), g) for i in range(30) for g in [None if i % 3 == 0 else 4 + i % 3] for t in range(10)]
    df = spark.createDataFrame(rows, "unit int, time int, y double, treat_time int")
    assert all(abs(r.att - 3) < 1e-9 for r in did.imputation(df).collect())
    assert all(abs(r.att - (3 if r.t >= r.g else 0)) < 1e-9 for r in did.att_gt(df).collect())
    assert abs(did.switchers(df).first().did - 3) < 1e-9
    lp = {r.h: r.beta for r in regression.lp_did(df, "unit", "time", "y", "treat_time", [-2, -1, 0, 1]).collect()}
    assert abs(lp[0] - 3) < 1e-9 and abs(lp[1] - 3) < 1e-9 and lp[-1] == 0 and abs(lp[-2]) < 1e-9


def test_driscoll_kraay_has_no_cap_on_lags(spark):
    n, t = 4000, 45
    r = np.random.default_rng(2)
    common = np.cumsum(r.standard_normal(t)) / 3
    x = r.standard_normal((n, t)) + common * r.standard_normal((n, 1))
    y = np.cumsum(0.2 * x + r.standard_normal((n, t)) + common * r.standard_normal((n, 1)), axis=1)
    table = pa.table({"code": np.repeat(np.arange(n), t), "t": np.tile(np.arange(t), n), "y": y.ravel(), "x": x.ravel()})
    got = regression.panel_lp(spark.createDataFrame(table), "code", "t", "y", "x", [0], 1, se="dk").first()
    both = lambda a: a - a.mean(0) - a.mean(1, keepdims=True) + a.mean()
    dy, *X = (both(a) for a in (y[:, 1:] - y[:, :-1], x[:, 1:], x[:, :-1], y[:, :-1]))
    b, inv, u = ols(dy.ravel(), np.stack([a.ravel() for a in X], axis=1))
    q = sum(w * a for w, a in zip(inv[0], X)) * u.reshape(dy.shape)
    lags = round(4 * (got.n / 100) ** (2 / 9))
    assert lags > 20 and np.isclose(got.beta, b[0])
    assert np.isclose(got.se, np.sqrt(max(0, hac(q.sum(0)[:, None], lags)[0, 0])), rtol=1e-6)
