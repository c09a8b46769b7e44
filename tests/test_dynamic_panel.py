"""GMM of dynamic panels against stacked matrices of all rows."""

import numpy as np
import pandas as pd
import pytest

from loomline.functions import stats
from loomline.operators import dynamic_panel as D


def panel(seed=0, n=60, t=9, rho=0.5, holes=True):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, y, x = r.normal(), r.normal(), r.normal()
        for s in range(t):
            x = 0.6 * x + r.normal()
            e = r.normal()
            w, q = 0.3 * y + r.normal(), r.normal() + 0.4 * e
            y = rho * y + 0.7 * x + 0.2 * w + 0.3 * q + a + e
            rows.append((i, s, y, x, w, q))
    d = pd.DataFrame(rows, columns=["i", "s", "y", "x", "w", "q"])
    return d[r.random(len(d)) > 0.12].reset_index(drop=True) if holes else d


def dense(d, endog=(), pred=(), exog=(), n_lags=1, window=(2, None), collapse=True, two_step=True, corrected=True, system=False):
    """Row by row from a lookup of (unit, date)."""
    val = {(i, s): dict(y=y, x=x, w=w, q=q) for i, s, y, x, w, q in d.itertuples(index=False)}
    at = lambda i, s, c: val.get((i, s), {}).get(c, np.nan)
    xs = [*endog, *pred, *exog]
    usable = sorted(k for k in val if (k[0], k[1] - 1) in val)
    first = {i: min(s for j, s in val if j == i) for i in {k[0] for k in val}}
    back, start = max(s - first[i] for i, s in usable), min(s for _, s in val)
    gm = [(c, *window) for c in ("y", *endog)] + [(c, max(1, window[0] - 1), window[1] and window[1] - 1) for c in pred]
    if collapse:
        cells = [(c, lag, None) for c, lo, hi in gm for lag in range(lo, min(back, hi or back) + 1)]
    else:
        cells = [(c, lag, s) for c, lo, hi in gm for s in sorted({s for _, s in usable}) for lag in range(lo, min(s - start, hi or s - start) + 1)]
    k = n_lags + len(xs)
    m = len(cells) + len(exog) + (k if system else 0)
    Z, X, Y, rows = [], [], [], []
    for i, s in usable:
        x = [at(i, s - p, "y") - at(i, s - p - 1, "y") for p in range(1, n_lags + 1)] + [at(i, s, c) - at(i, s - 1, c) for c in xs]
        if np.isfinite(x).all():
            z = np.zeros(m)
            z[: len(cells)] = [np.nan_to_num(at(i, s - lag, c)) if date in (None, s) else 0 for c, lag, date in cells]
            z[len(cells) : len(cells) + len(exog)] = [at(i, s, c) - at(i, s - 1, c) for c in exog]
            Z.append(z), X.append(x), Y.append(at(i, s, "y") - at(i, s - 1, "y")), rows.append((i, s))
    n = len(rows)
    if system:
        for i, s in sorted(val):
            x = [at(i, s - p, "y") for p in range(1, n_lags + 1)] + [at(i, s, c) for c in xs]
            if np.isfinite(x).all() and (i, s - 2) in val:
                z = np.zeros(m)
                z[-k:] = np.nan_to_num([at(i, s - p, "y") - at(i, s - p - 1, "y") for p in range(1, n_lags + 1)] + [at(i, s, c) - at(i, s - 1, c) for c in (*endog, *pred)] + [at(i, s, c) for c in exog])
                Z.append(z), X.append(x), Y.append(at(i, s, "y")), rows.append((i, s))
    Z, X, Y = map(np.array, (Z, X, Y))
    H = np.eye(len(rows)) if system else np.array([[2.0 if a == b else -1.0 if a[0] == b[0] and abs(a[1] - b[1]) == 1 else 0.0 for b in rows] for a in rows])
    inv = np.linalg.pinv
    ids = sorted({i for i, _ in rows})
    own = {i: [j for j, r in enumerate(rows) if r[0] == i] for i in ids}
    spread = lambda u: sum(np.outer(g, g) for g in (Z[own[i]].T @ u[own[i]] for i in ids))
    a, b, w1 = Z.T @ X, Z.T @ Y, inv(Z.T @ H @ Z)
    bread = inv(a.T @ w1 @ a)
    beta = bread @ a.T @ w1 @ b
    s = spread(Y - X @ beta)
    w2, cov = inv(s), bread @ a.T @ w1 @ s @ w1 @ a @ bread
    if two_step:
        first_cov, cov = cov, inv(a.T @ w2 @ a)
        beta = cov @ a.T @ w2 @ b
        u = Y - X @ beta
        if corrected:
            v = w2 @ Z.T @ u
            D_ = np.zeros((k, k))
            for c in range(k):
                dS = -sum(np.outer(Z[own[i]].T @ X[own[i], c], Z[own[i]].T @ u[own[i]]) + np.outer(Z[own[i]].T @ u[own[i]], Z[own[i]].T @ X[own[i], c]) for i in ids)
                D_[:, c] = -cov @ a.T @ w2 @ dS @ v
            cov = cov + D_ @ cov + cov @ D_.T + D_ @ first_cov @ D_.T
    u = Y - X @ beta
    j = (Z.T @ u) @ w2 @ (Z.T @ u)
    res = dict(zip(rows[:n], u[:n]))
    ar = []
    for lag in (1, 2):
        per = [sum(res[i, t] * res[i, t - lag] for (h, t) in res if h == i and (i, t - lag) in res) for i in ids]
        ar.append(sum(per) / np.sqrt(np.sum(np.square(per))))
    return beta, np.sqrt(np.diag(cov)), j, m - k, ar, len(rows), len(ids), m


CASES = {
    "own lags only": {}, "one step": {"two_step": False, "exog": ("x",)}, "uncorrected": {"corrected": False, "exog": ("x",), "window": (2, 4)}, "all kinds": {"endog": ("q",), "pred": ("w",), "exog": ("x",), "window": (2, 3)},
    "by date": {"collapse": False, "window": (2, 3), "pred": ("w",)}, "two lags": {"n_lags": 2, "exog": ("x",)}, "system": {"system": True, "exog": ("x",)}, "system of all kinds": {"system": True, "endog": ("q",), "pred": ("w",), "exog": ("x",), "n_lags": 2, "window": (2, 4)},
    "one-step system": {"system": True, "two_step": False},
}


@pytest.mark.parametrize("case", CASES)
def test_equals_stacked_matrices(spark, case):
    d, options = panel(), CASES[case]
    beta, se, j, df, ar, n, units, m = dense(d, **options)
    got = {r.term: r for r in D.gmm(spark.createDataFrame(d).repartition(3), "i", "s", "y", **options).collect()}
    names = [f"L{p + 1}" for p in range(options.get("n_lags", 1))] + [c for kind in ("endog", "pred", "exog") for c in options.get(kind, ())]
    assert list(got) == [*names, "hansen_j", "ar1", "ar2"]
    assert np.allclose([got[c].estimate for c in names], beta, rtol=1e-6) and np.allclose([got[c].se for c in names], se, rtol=1e-6)
    h = got["hansen_j"]
    assert np.isclose(h.estimate, j, rtol=1e-6) and h.df == df and np.isclose(h.p_value, stats.chi2_sf(j, df))
    assert np.allclose([got["ar1"].z, got["ar2"].z], ar, rtol=1e-6)
    assert (h.n_obs, h.n_units, h.n_instruments) == (n, units, m)


def test_recovers_persistence_and_finds_serial_correlation_of_differences(spark):
    d = spark.createDataFrame(panel(3, 400, 8, 0.3, holes=False))
    for system in (False, True):
        got = {r.term: r for r in D.gmm(d, "i", "s", "y", exog=("x",), endog=("q",), pred=("w",), system=system).collect()}
        assert abs(got["L1"].estimate - 0.3) < 0.1 and abs(got["x"].estimate - 0.7) < 0.15 and got["ar1"].p_value < 0.01 and got["ar2"].p_value > 0.01


def test_rows_that_cant_be_used(spark):
    d = panel(1, 30, 7)
    base = D.gmm(spark.createDataFrame(d), "i", "s", "y", exog=("x",))
    more = pd.concat([d, pd.DataFrame({"i": [0, None, 99, 98, 98], "s": [50, 3, 3, 1, 2], "y": [None, 1.0, 1.0, 2.0, 1.0], "x": [1.0, 1.0, 1.0, None, float("nan")], "w": 0.0, "q": 0.0})])
    assert [tuple(r) for r in D.gmm(spark.createDataFrame(more.sample(frac=1, random_state=1)), "i", "s", "y", exog=("x",)).select("term", "n_obs", "n_units").collect()] == [tuple(r) for r in base.select("term", "n_obs", "n_units").collect()]
    for bad, message in ((pd.concat([d, d[:1]]), "two rows"), (d[d.s % 2 == 0], "two dates"), (d[:0], "two dates")):
        with pytest.raises(ValueError, match=message):
            D.gmm(spark.createDataFrame(bad, "i long, s long, y double, x double, w double, q double"), "i", "s", "y")
    with pytest.raises(ValueError, match="instruments"):
        D.gmm(spark.createDataFrame(d), "i", "s", "y", endog=("q", "w"), window=(9, None))
