"""Instrumental-variable estimates and tests against dense linear algebra."""

import numpy as np
import pandas as pd
import pytest

from loomline.functions import stats
from loomline.operators import iv


def data(seed=1, n=240):
    r = np.random.default_rng(seed)
    z, w = r.standard_normal((n, 2)), r.standard_normal(n)
    e = r.standard_normal(n)
    x = z @ [0.7, -0.4] + 0.3 * w + e
    y = 1 + 0.5 * x - 0.2 * w + 0.6 * e + r.standard_normal(n) * (1 + 0.3 * np.abs(z[:, 0]))
    return pd.DataFrame({"g": np.arange(n) % 2, "c": np.arange(n) // 8, "y": y, "x": x, "z1": z[:, 0], "z2": z[:, 1], "w": w, "t": np.arange(n)})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(data())


def by_group(df):
    return {r.g: r for r in df.collect()}


def parts(g):
    one = np.ones(len(g))
    return g.y.to_numpy(), g.x.to_numpy(), g[["z1", "z2"]].to_numpy(), np.column_stack([one, g.w])


def project(a, b):
    return a @ np.linalg.lstsq(a, b, rcond=None)[0]


def test_two_stage(frame):
    got = {se: by_group(iv.two_stage(frame, ["g"], "y", "x", ["z1", "z2"], ["w"], se, "c")) for se in ("classical", "hc0", "cluster")}
    for k, g in data().groupby("g"):
        y, x, z, w = parts(g)
        full, X = np.column_stack([w, z]), np.column_stack([x, w])
        hat = np.column_stack([project(full, x), w])
        b = np.linalg.solve(hat.T @ hat, hat.T @ y)
        u, inv = y - X @ b, np.linalg.inv(hat.T @ hat)
        q = (hat @ inv[0]) * u
        want = {"classical": np.sqrt(u @ u / len(g) * inv[0, 0]), "hc0": np.sqrt(q @ q), "cluster": np.sqrt((pd.Series(q).groupby(g.c.to_numpy()).sum() ** 2).sum())}
        for se, v in want.items():
            assert np.isclose(got[se][k].beta, b[0]) and np.isclose(got[se][k].se, v)


def test_strength_of_instruments(frame):
    got, clustered = by_group(iv.first_stage(frame, ["g"], "x", ["z1", "z2"])), by_group(iv.first_stage(frame, ["g"], "x", ["z1", "z2"], "c"))
    for k, g in data().groupby("g"):
        _, x, z, _ = parts(g)
        fit = project(z, x)
        assert np.isclose(got[k].cragg_donald, fit @ fit / (((x - fit) ** 2).sum() / (len(g) - 2)))
        xd, zd = x - x.mean(), z - z.mean(axis=0)
        inv = np.linalg.inv(zd.T @ zd)
        pi = inv @ zd.T @ xd
        s = zd * (xd - zd @ pi)[:, None]
        for r, o in ((got[k], s.T @ s), (clustered[k], (lambda t: t.T @ t)(pd.DataFrame(s).groupby(g.c.to_numpy()).sum().to_numpy()))):
            assert np.isclose(r.effective_f, pi @ zd.T @ zd @ pi / np.trace(inv @ o)) and np.isclose(r.robust_f, pi @ np.linalg.inv(inv @ o @ inv) @ pi / 2)


def test_anderson_rubin_and_its_band(frame):
    grid = np.linspace(-1, 2, 31).tolist()
    tests = iv.anderson_rubin(frame, ["g"], "y", "x", ["z1", "z2"], grid, ["w"])
    got, band = {(r.g, r.beta0): r for r in tests.collect()}, by_group(iv.anderson_rubin_band(tests, ["g"]))
    for k, g in data().groupby("g"):
        y, x, z, w = parts(g)
        ps = []
        for b in grid:
            v = y - b * x
            r0, r1 = ((v - project(a, v)) @ (v - project(a, v)) for a in (w, np.column_stack([w, z])))
            f = (r0 - r1) / 2 / (r1 / (len(g) - 4))
            ps.append(stats.f_sf(f, 2, len(g) - 4))
            assert np.isclose(got[k, b].f_stat, f) and np.isclose(got[k, b].p_value, ps[-1])
        kept = [b for b, p in zip(grid, ps) if p >= 0.10] or [grid[int(np.argmax(ps))]]
        assert (band[k].lo, band[k].hi) == (min(kept), max(kept))
    none = iv.anderson_rubin_band(iv.anderson_rubin(frame, ["g"], "y", "x", ["z1", "z2"], [50.0, 60.0], ["w"]), ["g"])
    assert all(r.lo == r.hi for r in none.collect())


def test_over_identification_and_lewbel(frame):
    got, made = by_group(iv.hansen(frame, ["g"], "y", "x", ["z1", "z2"], ["w"])), by_group(iv.lewbel(frame, ["g"], "y", "x", ["z1", "w"]))
    for k, g in data().groupby("g"):
        y, x, z, w = parts(g)
        full, X = np.column_stack([w, z]), np.column_stack([x, w])
        hat = np.column_stack([project(full, x), w])
        u = y - X @ np.linalg.solve(hat.T @ X, hat.T @ y)
        j = len(g) * (1 - ((u - project(full, u)) ** 2).sum() / ((u - u.mean()) ** 2).sum())
        assert np.isclose(got[k].j_stat, j) and np.isclose(got[k].p_value, stats.chi2_sf(j, 1)) and got[k].df == 1
        zs = np.column_stack([np.ones(len(g)), g.z1, g.w])
        v = x - project(zs, x)
        every = np.column_stack([zs, (zs[:, 1:] - zs[:, 1:].mean(axis=0)) * v[:, None]])
        hat = np.column_stack([project(every, x), zs])
        b = np.linalg.solve(hat.T @ hat, hat.T @ y)
        u = y - np.column_stack([x, zs]) @ b
        assert np.isclose(made[k].beta, b[0]) and np.isclose(made[k].se, np.sqrt(u @ u / len(g) * np.linalg.inv(hat.T @ hat)[0, 0]))


def test_pooled_and_cleaned(frame):
    d = data()
    dm = d[["y", "x", "z1"]] - d.groupby("c")[["y", "x", "z1"]].transform("mean")
    for z in (None, "z1"):
        (got,) = iv.pooled(frame, "c", "y", "x", z).collect()
        zz = dm[z or "x"]
        b = (zz * dm.y).sum() / (zz * dm.x).sum()
        q = (zz * (dm.y - b * dm.x)).groupby(d.c).sum() / (zz * dm.x).sum()
        assert np.isclose(got.beta, b) and np.isclose(got.se, np.sqrt((q**2).sum()))
    got = iv.cleaned(frame, ["g"], "z1", ["w", "x"]).toPandas().sort_values("t")
    for k, g in d.groupby("g"):
        a = np.column_stack([np.ones(len(g)), g.w, g.x])
        assert np.allclose(got[got.g == k].cleaned, g.z1 - project(a, g.z1))


def test_dependence_and_homogeneity(spark):
    r = np.random.default_rng(8)
    u = r.standard_normal((30, 6)) + r.standard_normal((30, 1))
    d = pd.DataFrame([(f"e{i}", t, float(u[t, i]), float(r.standard_normal())) for t in range(30) for i in range(6)], columns=["e", "t", "u", "x"])
    got = iv.cross_dependence(spark.createDataFrame(d), "e", "t", "u").first()
    rho = np.corrcoef(u.T)
    stat = np.sqrt(2 * 30 / 30) * rho[np.triu_indices(6, 1)].sum()
    assert np.isclose(got.cd_stat, stat) and np.isclose(got.p_value, 2 * (1 - stats.norm_cdf(abs(stat))))
    got = iv.slope_homogeneity(spark.createDataFrame(d), "e", "u", ["x"], "x").first()
    betas = []
    for _, g in d.groupby("e"):
        a = np.column_stack([np.ones(30), g.x])
        b = np.linalg.lstsq(a, g.u, rcond=None)[0]
        s2 = ((g.u - a @ b) ** 2).sum() / 28
        betas.append((b[1], s2 * np.linalg.inv(a.T @ a)[1, 1]))
    b = np.array(betas)
    want = ((b[:, 0] - b[:, 0].mean()) ** 2 / b[:, 1]).sum()
    assert np.isclose(got.stat, want) and got.df == 5 and np.isclose(got.p_value, stats.chi2_sf(want, 5))


def test_panel_projections(spark):
    """Panel IV and regime responses against dummy regressions on the same design."""
    r = np.random.default_rng(9)
    rows = []
    for i in range(8):
        y = 0.0
        for t in range(40):
            z = r.standard_normal()
            x = 0.8 * z + r.standard_normal()
            y = 0.4 * y + x + 0.2 * i + r.standard_normal()
            rows.append((f"e{i}", t, float(y), float(x), float(z), int(r.random() < 0.4)))
    d = pd.DataFrame(rows, columns=["code", "t", "y", "x", "z", "r"])
    df = spark.createDataFrame(d)
    first = pd.get_dummies(d.code, dtype=float).join(pd.get_dummies(d.t, dtype=float)).to_numpy()
    resid = lambda v, a: v - project(a, v)
    pi = (lambda x, z: x @ z / (z @ z))(resid(d.x.to_numpy(), first), resid(d.z.to_numpy(), first))
    d["fit"] = pi * d.z
    got = {x.h: x for x in iv.panel_lp_iv(df, "code", "t", "y", "x", "z", [0, 2]).collect()}
    states = {(x.h, x.regime): x for x in iv.regime_interaction(df, "code", "t", "y", "x", "r", [0, 2]).collect()}
    for h in (0, 2):
        g = d.groupby("code")
        e = d.assign(up=g.y.shift(-h), base=g.y.shift(1), **{f"{c}{l}": g[c].shift(l) for c in ("x", "y", "fit") for l in (1, 2)}).dropna()
        fe, te = pd.get_dummies(e.code, dtype=float).to_numpy(), pd.get_dummies(e.t, dtype=float).to_numpy()
        a = np.column_stack([e.fit, e.fit1, e.y1, e.fit2, e.y2, fe, te])
        assert np.isclose(got[h].beta, np.linalg.lstsq(a, e.up - e.base, rcond=None)[0][0], atol=1e-7)
        a = np.column_stack([e.r * e.x, (1 - e.r) * e.x, e.r, e.x1, e.y1, e.x2, e.y2, fe])
        b = np.linalg.lstsq(a, e.up, rcond=None)[0]
        assert np.isclose(states[h, 1].beta, b[0], atol=1e-7) and np.isclose(states[h, 0].beta, b[1], atol=1e-7)
        assert 0 <= states[h, 1].wald_p <= 1 and states[h, 0].se > 0
