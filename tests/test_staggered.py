"""Weights on a simplex, several cohorts' synthetic differences and errors of staggered designs, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from test_did import panel

from loomline.operators import did, simplex_fit, staggered


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(panel(), "unit string, time int, y double, treat_time int")


def wide(rows):
    d = pd.DataFrame(rows, columns=["unit", "time", "y", "g"])
    return d.pivot(index="unit", columns="time", values="y"), d.groupby("unit").g.first()


@pytest.mark.parametrize(("n", "ridge", "noise"), [(40, 2.0, 1.0), (12, 0.0, 0.5), (5, 0.0, 0.0)])
def test_weights_are_the_closest_mix(spark, n, ridge, noise):
    r = np.random.default_rng(n)
    a = r.standard_normal((n, 14)).cumsum(axis=1)
    b = r.dirichlet(np.full(n, 0.3)) @ a + noise * r.standard_normal(14)
    df = spark.createDataFrame([(i, t, float(a[i, t])) for i in range(n) for t in range(14)] + [(n, 0, 1.0), (n + 1, 3, None)], "unit int, time int, y double")
    rows, dates = simplex_fit.paths(df, "unit", "time", "y")
    got = {x.unit: x.weight for x in simplex_fit.simplex_weights(rows, b, ridge).collect()}
    w = np.array([got[i] for i in range(n)])
    assert dates == list(range(14)) and len(got) == n and (w >= 0).all() and np.isclose(w.sum(), 1)
    # no direction goes down: w'g is as small as the smallest part of the gradient
    g = a @ (w @ a - b) + ridge * w
    assert w @ g - g.min() < 1e-6 * (b @ b)
    e = np.c_[np.ones(n), a]
    assert np.allclose(simplex_fit.cross(rows, 14), e.T @ e)
    assert simplex_fit.simplex_weights(rows.limit(0), b).count() == 0


def sdid(y, g, cohort, keep):
    """Effect, weights and changes of one cohort over the units of ``keep``."""
    own, donors = [u for u in keep if g[u] == cohort], [u for u in keep if g[u] != cohort]
    pre, post = y[[t for t in y if t < cohort]], y[[t for t in y if t >= cohort]].mean(axis=1)
    a, b = pre.loc[donors].to_numpy(), pre.loc[own].mean().to_numpy()
    noise = np.diff(a, axis=1).var(ddof=1)
    ridge = noise * np.sqrt(len(own) * (y.shape[1] - pre.shape[1])) * pre.shape[1]
    c, v = a - a.mean(axis=1, keepdims=True), b - b.mean()
    w = did.simplex(c @ c.T, c @ v, ridge)
    x, z = a - a.mean(axis=0), (post[donors] - post[donors].mean()).to_numpy()
    lam = did.simplex(x.T @ x, x.T @ z, 1e-12 * (np.trace(x.T @ x) + z @ z))
    change = post - pre.to_numpy() @ lam
    return change[own].mean() - w @ change[donors], own, dict(zip(donors, w, strict=True)), change


def test_cohorts(frame):
    y, g = wide(panel())
    fits = {c: sdid(y, g, c, [u for u in y.index if not g[u] <= c - 1]) for c in (4, 5)}
    cohorts, total = did.synthetic_did_cohorts(frame)
    got = {r.cohort: (r.att, r.n) for r in cohorts.collect()}
    assert set(got) == {4, 5} and all(np.isclose(got[c][0], fits[c][0], atol=1e-6) and got[c][1] == len(fits[c][1]) for c in got)

    def effect(without=None):
        num = n = 0
        for _, own, w, change in fits.values():
            left, rest = [u for u in own if u != without], {u: x for u, x in w.items() if u != without}
            num += len(left) * (change[left].mean() - sum(x * change[u] for u, x in rest.items()) / sum(rest.values()))
            n += len(left)
        return num / n

    one, m = total.first(), len(y)
    assert np.isclose(one.att, effect(), atol=1e-6) and one.n == 8 and one.cohorts == 2
    assert np.isclose(one.se, np.sqrt((m - 1) / m * sum((effect(u) - effect()) ** 2 for u in y.index)), rtol=1e-5)
    # a cohort without an earlier date counts for nothing
    assert [r.cohort for r in did.synthetic_did_cohorts(frame.where("time >= 3"), later=False)[0].collect()] == [5]


@pytest.mark.parametrize("weighted", [True, False])
def test_event_study_error(spark, weighted):
    rows = [r for i, r in enumerate(panel()) if i % 17]  # holes
    df = spark.createDataFrame(rows, "unit string, time int, y double, treat_time int")
    y, g = wide(rows)

    def effects(weight):
        """Event times' effects where units' rows weigh ``weight`` in their cells, shares as they are."""
        mean = lambda units, t: np.average(y.loc[units, t].dropna(), weights=[weight[u] for u in y.loc[units, t].dropna().index])
        cells = {}
        for c in (4, 5):
            own, never = [u for u in y.index if g[u] == c], [u for u in y.index if np.isnan(g[u])]
            for t in range(c - 1, 9):
                cells.setdefault(t - c, []).append(((mean(own, t) - mean(own, c - 1)) - (mean(never, t) - mean(never, c - 1)), y.loc[own, t].notna().sum() if weighted else 1))
        return {e: np.average([a for a, _ in v], weights=[n for _, n in v]) for e, v in cells.items()}

    at = effects(dict.fromkeys(y.index, 1.0))
    # a unit's part is the derivative by its weight
    parts = {e: [] for e in at}
    for u in y.index:
        up, down = effects({v: 1 + 1e-5 * (v == u) for v in y.index}), effects({v: 1 - 1e-5 * (v == u) for v in y.index})
        for e in at:
            parts[e].append((up[e] - down[e]) / 2e-5)
    got = {r.e: r for r in staggered.event_study_inference(df, weighted).collect()}
    assert set(got) == set(at)
    for e, r in got.items():
        assert np.isclose(r.att, at[e]) and np.isclose(r.se or 0, np.sqrt(np.sum(np.square(parts[e]))), rtol=1e-5, atol=1e-9)


def test_switchers_by_horizon(frame):
    y, g = wide(panel())

    def effect(h, weight):
        num = den = 0
        for t in range(1, 9):
            a, b = (t - 1, t - 2) if h < 0 else (t + h, t - 1)
            if a > 8 or b < 0:
                continue
            s = [u for u in y.index if g[u] == t]
            c = [u for u in y.index if not g[u] <= max(t, t + h)]
            if s and c:
                dy = y[a] - y[b]
                n = sum(weight[u] for u in s)
                num, den = num + n * (np.average(dy[s], weights=[weight[u] for u in s]) - np.average(dy[c], weights=[weight[u] for u in c])), den + n
        return num / den, den

    got = {r.h: r for r in staggered.switchers_by_horizon(frame, [0, 1, 3]).collect()}
    assert set(got) == {-1, 0, 1, 3}
    one = dict.fromkeys(y.index, 1.0)
    for h, r in got.items():
        slope = [(effect(h, one | {u: 1 + 1e-5})[0] - effect(h, one | {u: 1 - 1e-5})[0]) / 2e-5 for u in y.index]
        assert np.isclose(r.did, effect(h, one)[0]) and r.n_switchers == effect(h, one)[1] and np.isclose(r.se, np.sqrt(np.sum(np.square(slope))), rtol=1e-5)
    assert np.isclose(got[0].did, did.switchers(frame).first().did) and np.isclose(got[3].did, did.switchers(frame, 3).first().did)
    assert np.isclose(got[-1].did, did.placebo_switchers(frame).first().did)


def test_nearest_deflator(spark):
    from datetime import date, timedelta

    from loomline.operators.measures import harmonised

    r = np.random.default_rng(3)
    day = lambda n: date(2000, 1, 1) + timedelta(days=int(n))
    deflators = [(c, day(n), float(v)) for c in "ab" for n, v in zip(r.integers(0, 60, 12), r.uniform(0.5, 2, 12), strict=True)] + [("a", day(7), None)]
    events = [(i, "abc"[i % 3], day(r.integers(-5, 70)), [0.0, 1.5, -2.0][i % 7 % 3], ["pct_gdp", "z", "usd"][i // 3 % 5 % 3]) for i in range(90)]
    got = {x.event_id: (x.magnitude, x.unit) for x in harmonised(spark.createDataFrame(events, "event_id int, code string, date date, magnitude double, unit string"), spark.createDataFrame(deflators, "code string, date date, deflator double")).collect()}
    assert len(got) == 90
    for i, c, when, size, unit in events:
        own = sorted((abs((k - when).days), k, -1 if v is None else v) for d, k, v in deflators if d == c)
        if unit != "z" and size == 0:
            assert got[i] == (0.05, "stub_pct_gdp")
        elif unit == "pct_gdp" and own and own[0][2] > 0:
            assert np.isclose(got[i][0], size / own[0][2]) and got[i][1] == unit
        else:
            assert got[i] == (size, unit)


def test_event_study_errors_gather_no_cohort(spark):
    """The never treated are most rows: no window may have a cohort's date as its key."""
    rows = [(f"u{i}", t, None if (i, t) == (3, 4) else float((i * 7 + t * t * (1 + i % 3)) % 11), None if i % 3 else 2 + i % 2) for i in range(30) for t in range(6)]
    d = staggered.event_study_inference(spark.createDataFrame(rows, "unit string, time int, y double, treat_time int"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(treat_time" not in plan
    got = {r.e: r.se for r in d.collect()}
    p = pd.DataFrame(rows, columns=["unit", "time", "y", "g"]).fillna({"g": -9})
    cell = p.groupby(["g", "time"]).y.agg(["mean", "size"])
    v = ((p.y - p.groupby(["g", "time"]).y.transform("mean")) / p.groupby(["g", "time"]).y.transform("count")).fillna(0)
    for e in (0, 1, 2):
        gs = [g for g in (2, 3) if g + e < 6]
        n = {g: cell.loc[(g, g + e), "size"] for g in gs}
        psi = pd.Series(0.0, index=p.unit.unique())
        for g in gs:
            for cohort, sign in ((g, 1), (-9, -1)):
                for t, way in ((g + e, 1), (g - 1, -1)):
                    at = (p.g == cohort) & (p.time == t)
                    psi = psi.add((v[at] * sign * way * n[g] / sum(n.values())).set_axis(p.unit[at]), fill_value=0)
        assert abs(got[e] - np.sqrt((psi**2).sum())) < 1e-12
