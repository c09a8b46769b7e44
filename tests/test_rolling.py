"""Sliding estimates against each window by itself, and the confidence set against its definition."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from loomline.operators import confidence_set as C
from loomline.operators import rolling as R
from loomline.operators import series as T


def panel(seed=0, n=90, holes=False):
    r = np.random.default_rng(seed)
    x = np.zeros((n, 3))
    for t in range(1, n):
        x[t] = 0.5 * x[t - 1] + 0.2 * x[t - 1, ::-1] + r.normal(size=3)
    x += 100
    if holes:
        x[r.random(x.shape) < 0.1] = np.nan
    return pd.DataFrame(x, columns=list("abc")).assign(g="one", t=range(n))


@pytest.mark.parametrize("p,orthogonal", [(1, False), (2, True)])
def test_rolling_spillover(spark, p, orthogonal):
    d = pd.concat([panel(), panel(1, 50).assign(g="two")])
    got = {(r.g, r.t): r for r in R.rolling_spillover(spark.createDataFrame(d).repartition(3), ["g"], "t", ["a", "b", "c"], 40, p, 5, orthogonal).collect()}
    assert len(got) == 51 + 11
    for (g, t), r in got.items():
        y = d[d.g == g].sort_values("t")[["a", "b", "c"]].to_numpy()[t - 39 : t + 1]
        x = np.column_stack([np.ones(40 - p), *[y[p - k : 40 - k] for k in range(1, p + 1)]])
        beta = np.linalg.lstsq(x, y[p:], rcond=None)[0]
        u = y[p:] - x @ beta
        sigma = u.T @ u / (len(u) - x.shape[1])
        psi = T.moving_average(np.array([beta[1 + i * 3 : 4 + i * 3].T for i in range(p)]), 5)
        total, to, frm = T.spillover((T.fevd(psi @ np.linalg.cholesky(sigma)) if orthogonal else T.gfevd(psi, sigma))[-1])
        assert np.isclose(r.total, total) and np.allclose(r.net, to - frm, atol=1e-6) and np.allclose(r["from"], frm)
    with pytest.raises(ValueError):
        R.rolling_spillover(spark.createDataFrame(d), ["g"], "t", ["a", "b", "c"], 5)


@pytest.mark.parametrize("tightening", [None, ["b", "c"]])
def test_rolling_conditions(spark, tightening):
    d = panel(2, 70, holes=True)
    d.loc[d.t < 45, "c"] = np.nan
    got = {r.t: r for r in R.rolling_conditions(spark.createDataFrame(d), ["g"], "t", ["a", "b", "c"], 30, tightening).collect()}
    assert sorted(got) == list(range(29, 70))
    for t, r in got.items():
        x = d[["a", "b", "c"]].to_numpy()[t - 29 : t + 1]
        with np.errstate(all="ignore"):
            mu = np.array([np.mean(c[np.isfinite(c)]) if np.isfinite(c).any() else 0 for c in x.T])
            sd = np.array([np.std(c[np.isfinite(c)]) if np.isfinite(c).sum() else 0 for c in x.T])
        z = np.where(np.isfinite(x) & (sd > 1e-12), (x - mu) / np.where(sd > 1e-12, sd, 1), 0)
        _, s, v = np.linalg.svd(z, full_matrices=False)
        w = v[0]
        if (w[[1, 2]].sum() < 0) if tightening else w[np.argmax(np.abs(w) >= np.abs(w).max() - 1e-9)] < 0:
            w = -w
        index = z @ w
        assert np.isclose(r.fci, index[-1] / index.std(), atol=1e-6) and np.isclose(r.share, s[0] ** 2 / (s**2).sum())


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


@pytest.mark.parametrize("kind", ["max", "range", "squares"])
def test_confidence_set(spark, kind):
    r = np.random.default_rng(4)
    n, b, models = 60, 50, ["good", "same", "bad", "worst"]
    e = r.normal(size=(n, 1)) * 0.5
    losses = (e + r.normal(size=(n, 4)) * 0.4 + [0, 0.02, 0.35, 1.0]) ** 2
    d = pd.DataFrame(losses, columns=models).assign(g="one", t=range(n))
    extra = pd.DataFrame({"good": [None], "same": 1.0, "bad": 1.0, "worst": 1.0, "g": "one", "t": 99})
    got = {x.model: x for x in C.confidence_set(spark.createDataFrame(pd.concat([d, extra])).repartition(3), ["g"], "t", models, kind=kind, replicates=b).collect()}
    means = []
    for rep in range(1, b + 1):
        idx = []
        for place in range(1, n + 1):
            new = place == 1 or draw("new", 0, "one", rep, place) < 1 / 4
            idx.append(int(draw("at", 0, "one", rep, place) * n) if new else (idx[-1] + 1) % n)
        means.append(losses[idx].mean(0))
    bar, star = losses.mean(0), np.array(means)
    left, p, so_far, order = list(range(4)), {}, 0.0, []
    while len(left) > 1:
        k = len(left)
        dev = star[:, left] - star[:, left].mean(1)[:, None] - (bar[left] - bar[left].mean())
        t = (bar[left] - bar[left].mean()) / np.sqrt((dev**2).mean(0))
        if kind == "max":
            seen, res = max(t), (dev / np.sqrt((dev**2).mean(0))).max(1)
        else:
            pairs = [(i, j) for i in left for j in left if i < j]
            dv = np.array([star[:, i] - star[:, j] - bar[i] + bar[j] for i, j in pairs]).T
            sd = np.sqrt((dv**2).mean(0))
            a, z = np.abs(np.array([bar[i] - bar[j] for i, j in pairs]) / sd), np.abs(dv / sd)
            seen, res = (a.max(), z.max(1)) if kind == "range" else ((a**2).sum(), (z**2).sum(1))
        so_far = max(so_far, np.mean(res >= seen))
        worst = left[int(np.argmax(t))]
        p[worst] = so_far
        order.append(worst)
        left.remove(worst)
    p[left[0]] = 1.0
    for i, m in enumerate(models):
        assert np.isclose(got[m].p_value, p[i]) and np.isclose(got[m].mean_loss, bar[i]) and got[m].included == (p[i] >= 0.1) and got[m].turn == (order.index(i) + 1 if i in order else 4)
    assert got["good"].included and not got["worst"].included
    with pytest.raises(ValueError):
        C.confidence_set(spark.createDataFrame(d), ["g"], "t", ["good"])
