"""Inference and synthetic comparisons of differences in differences, against plain loops."""

import numpy as np
import pandas as pd
import pytest

from loomline.operators import did


def panel(seed=6, units=24, dates=9):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(units):
        g = None if i % 3 else 4 + (i % 2)
        for t in range(dates):
            rows.append((f"u{i:02d}", t, float(0.3 * i + np.sin(t + 0.2 * i) + r.standard_normal() * 0.3 + (2 if g is not None and t >= g else 0)), g))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(panel(), "unit string, time int, y double, treat_time int")


def test_replicates_are_weighted_cells(frame):
    got = {(r.g, r.t): r for r in did.att_gt_inference(frame, 60).collect()}
    w = did.bootstrap_weights(frame.select("unit").distinct(), 60).toPandas()
    assert abs(w.w.sum() / 60 / 24 - 1) < 0.08 and w.w.max() >= 3
    d = pd.DataFrame(panel(), columns=["unit", "time", "y", "g"])
    draws = {}
    for b, g in w.groupby("b"):
        e = d.merge(g[["unit", "w"]], on="unit")
        e["wy"] = e.w * e.y
        s = e.assign(g=e.g.fillna(-1)).groupby(["g", "time"])[["wy", "w"]].sum()
        m = s.wy / s.w
        for c in (4, 5):
            if c in m.index.get_level_values(0) and -1 in m.index.get_level_values(0):
                for t in range(c - 1, 9):
                    draws.setdefault((c, t), []).append((m[c, t] - m[c, c - 1]) - (m[-1, t] - m[-1, c - 1]))
    point = {(r.g, r.t): r.att for r in did.att_gt(frame).collect()}
    assert set(got) == set(point)
    for k, r in got.items():
        assert np.isclose(r.att, point[k]) and np.isclose(r.se, np.std(draws[k]), atol=1e-9) and np.allclose([r.lo, r.hi], np.percentile(draws[k], [5, 95]))


def test_placebo(frame):
    d = pd.DataFrame(panel(), columns=["unit", "time", "y", "g"]).set_index(["unit", "time"])
    y, g = d.y.unstack(), d.g.groupby("unit").first()
    num = den = 0
    for t in (4, 5):
        dy = y[t - 1] - y[t - 2]
        s, c = dy[g == t], dy[g.isna() | (g > t)]
        num, den = num + (s.mean() - c.mean()) * len(s), den + len(s)
    got = did.placebo_switchers(frame).first()
    assert np.isclose(got.did, num / den) and got.n_switchers == den


def test_simplex_is_the_least_of_many():
    r = np.random.default_rng(1)
    x, y = r.standard_normal((30, 6)), r.standard_normal(30)
    w = did.simplex(x.T @ x, x.T @ y, 0.5)
    f = lambda v: 0.5 * v @ (x.T @ x + 0.5 * np.eye(6)) @ v - (x.T @ y) @ v
    assert np.isclose(w.sum(), 1) and (w >= 0).all() and all(f(w) <= f(v) + 1e-9 for v in r.dirichlet(np.full(6, 0.3), 3000))
    # no feasible direction goes down: gradients of held weights are equal, others no smaller
    g = (x.T @ x + 0.5 * np.eye(6)) @ w - x.T @ y
    assert np.ptp(g[w > 1e-9]) < 1e-6 and (g >= g[w > 1e-9].min() - 1e-6).all()


def test_synthetic_control_and_did(spark):
    r = np.random.default_rng(4)
    common = r.standard_normal((5, 14)).cumsum(axis=1)
    rows = [(f"c{i}", t, float(common[i, t]), None) for i in range(5) for t in range(14)]
    rows += [("x", t, float(0.6 * common[0, t] + 0.4 * common[3, t] + (3 if t >= 9 else 0)), 9) for t in range(14)]
    df = spark.createDataFrame(rows, "unit string, time int, y double, treat_time int")
    weights, gap = did.synthetic_control(df, "x", 9)
    got = {x.unit: x.weight for x in weights.collect()}
    assert abs(got["c0"] - 0.6) < 1e-4 and abs(got["c3"] - 0.4) < 1e-4
    assert all(abs(x.gap - (3 if x.time >= 9 else 0)) < 1e-3 for x in gap.collect())
    effect, units, times = did.synthetic_did(df, 9)
    assert np.isclose(sum(x.weight for x in units.collect()), 1) and np.isclose(sum(x.weight for x in times.collect()), 1)
    # the estimate is the weighted double difference of its own weights
    u, k = {x.u: x.weight for x in units.collect()}, {int(x.k): x.weight for x in times.collect()}
    y = pd.DataFrame(rows, columns=["unit", "time", "y", "g"]).pivot(index="unit", columns="time", values="y")
    change = y[range(9, 14)].mean(axis=1) - sum(k[t] * y[t] for t in range(9))
    assert np.isclose(effect, change["x"] - sum(u[c] * change[c] for c in u)) and abs(effect - 3) < 1.0
