"""X-11 against loops over one series."""

import numpy as np
import pandas as pd
import pytest

from loomline.operators import seasonal as X


def test_filters():
    w = X.henderson(13)
    assert np.allclose(w[:7], [-0.01935, -0.02786, 0.0, 0.06549, 0.14736, 0.21434, 0.24006], atol=1e-5) and np.allclose(X.henderson(5), [-0.07343, 0.29371, 0.55944, 0.29371, -0.07343], atol=1e-5)
    t = np.arange(13.0)
    assert np.allclose([w @ t**k for k in range(4)], [6.0**k for k in range(4)])
    # published weights of the last month
    assert np.allclose(X.end_weights(w, 0, 3.5), [-0.09186, -0.05812, 0.01202, 0.11977, 0.24390, 0.35315, 0.42113], atol=5e-4)
    assert all(np.isclose(X.end_weights(w, q, 3.5).sum(), 1) for q in range(6))
    assert all(sum(a) == sum(b) or sum(b) in (27, 60) for a, ends in X.SEASONAL.values() for b in ends)


def plain(y, p, mult, terms):
    n, neutral = len(y), 1.0 if mult else 0.0
    take = (lambda a, b: a / b) if mult else (lambda a, b: a - b)
    pos, year = np.arange(n) % p, np.arange(n) // p

    def year_average(x):
        out, h = np.full(n, np.nan), p // 2
        for t in range(h, n - h):
            out[t] = (x[t - h] / 2 + x[t - h + 1 : t + h].sum() + x[t + h] / 2) / p
        return out

    def henderson(x):
        w, h = X.henderson(terms), terms // 2
        out = np.empty(n)
        for t in range(n):
            if t >= h and t + h < n:
                out[t] = w @ x[t - h : t + h + 1]
            elif t + h >= n:
                out[t] = X.end_weights(w, n - 1 - t, X.RATIO[terms]) @ x[t - h :]
            else:
                out[t] = X.end_weights(w, t, X.RATIO[terms])[::-1] @ x[: t + h + 1]
        return out

    def fill(x, groups):
        for g in groups:
            ok = [t for t in g if np.isfinite(x[t])]
            for t in g:
                if not np.isfinite(x[t]) and ok:
                    before = [s for s in ok if s <= t]
                    x[t] = x[before[-1]] if before else x[ok[0]]
        return x

    def seasonal(r, name):
        sym, ends = X.SEASONAL[name]
        h, out = len(sym) // 2, np.full(n, np.nan)
        for k in range(p):
            at = [t for t in range(n) if pos[t] == k and np.isfinite(r[t])]
            v = r[at]
            for j, t in enumerate(at):
                if len(v) < len(sym):
                    out[t] = v.mean()
                elif h <= j < len(v) - h:
                    out[t] = np.dot(sym, v[j - h : j + h + 1]) / sum(sym)
                elif j >= len(v) - h:
                    e = ends[len(v) - 1 - j]
                    out[t] = np.dot(e, v[-len(e) :]) / sum(e)
                else:
                    e = ends[j][::-1]
                    out[t] = np.dot(e, v[: len(e)]) / sum(e)
        out = fill(out, [[t for t in range(n) if pos[t] == k] for k in range(p)])
        return take(out, fill(year_average(out), [range(n)]))

    def weights(i):
        off, dev = i - neutral, np.full(n, np.inf)
        for _ in range(2):
            used = np.where(np.abs(off) <= X.HIGH * dev, off, np.nan)
            new = np.empty(n)
            for t in range(n):
                c = min(max(year[t], 2), max(year[-1] - 2, 0))
                block = used[(year >= c - 2) & (year <= c + 2)]
                new[t] = np.sqrt(np.nanmean(block**2))
            dev = new
        z = np.nan_to_num(np.abs(off) / np.where(dev > 0, dev, np.inf))
        return np.clip((X.HIGH - z) / (X.HIGH - X.LOW), 0, 1)

    def replaced(r, w):
        out = r.copy()
        for t in range(n):
            if w[t] < 1:
                same = [s for s in range(n) if pos[s] == pos[t] and w[s] >= 1 and np.isfinite(r[s])]
                d = [r[s] for s in same if s < t][-2:] + [r[s] for s in same if s > t][:2]
                if w[t] + len(d) > 0:
                    out[t] = (r[t] * w[t] + sum(d)) / (w[t] + len(d))
        return out

    base = y.copy()
    for turn in (1, 2):
        r1 = take(base, year_average(base))
        r1 = replaced(r1, weights(take(r1, seasonal(r1, "3x3"))))
        a1 = take(base, seasonal(r1, "3x3"))
        t2 = henderson(a1)
        r2 = take(y, t2)
        r2 = replaced(r2, weights(take(r2, seasonal(r2, "3x5"))))
        s = seasonal(r2, "3x5")
        adj = take(y, s)
        if turn == 1:
            i3 = take(adj, t2)
            usual = neutral + weights(i3) * (i3 - neutral)
            base = take(y, take(i3, usual))
    trend = henderson(adj)
    return trend, s, take(adj, trend), adj


def data(seed, n, p, spikes=True):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    y = np.exp(4 + 0.004 * t + 0.2 * np.sin(2 * np.pi * t / p) + 0.1 * np.cos(4 * np.pi * t / p) * (1 + t / n) + 0.02 * r.normal(size=n))
    if spikes:
        y[[n // 3, n // 2 + 1]] *= [1.4, 0.7]
    return y


@pytest.mark.parametrize("p,mult", [(12, True), (12, False), (4, True)])
def test_against_loops(spark, p, mult):
    series = {"long": data(1, 11 * p + 5, p), "short": data(2, max(4 * p + 1, 26), p)}
    rows = [(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y)] + [("few", t, 1.0) for t in range(10)] + [("hole", t, None if t == 7 else 2.0 + t % 3) for t in range(6 * p)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "t", "y"]).astype({"y": object}).sample(frac=1, random_state=1), "k string, t long, y double")
    got = X.x11(df, ["k"], "t", "y", p, mult).toPandas().sort_values(["k", "t"])
    assert len(got) == len(rows)
    for k, y in series.items():
        g = got[got.k == k]
        for name, want in zip(("trend", "seasonal", "irregular", "adjusted"), plain(y, p, mult, 13 if p == 12 else 5), strict=True):
            assert np.allclose(g[name], want, rtol=1e-7), (k, name)
    assert got[got.k.isin(["few", "hole"])][["trend", "seasonal", "irregular", "adjusted"]].isna().all().all()
    long = got[got.k == "long"]
    t = np.arange(len(long))
    true = np.exp(0.2 * np.sin(2 * np.pi * t / p) + 0.1 * np.cos(4 * np.pi * t / p) * (1 + t / len(long)))
    if mult:
        assert np.abs(long.seasonal.to_numpy() / true - 1).max() < 0.09


def test_wrong_periods_and_empty_tables(spark):
    df = spark.createDataFrame([], "k string, t long, y double")
    assert X.x11(df, ["k"], "t", "y").count() == 0
    for options in ({"period": 7}, {"henderson_terms": 11}):
        with pytest.raises(ValueError):
            X.x11(df, ["k"], "t", "y", **options)
