"""Filter, smoother and factor model against the joint normal distribution of all states and values."""

import numpy as np
import pandas as pd
import pytest

from loomline.operators import state_space as S


def joint(y, m, big=1e8):
    """Mean and covariance of all states given all values, and the log likelihood, from one large normal distribution."""
    T, n, k = len(y), m.Z.shape[0], m.T.shape[0]
    start = m.start()
    mean, cov = [start.mean], np.zeros((T * k, T * k))
    p = start.cov + big * start.diffuse
    for t in range(T):
        if t:
            mean.append(m.T @ mean[-1] + m.c)
            p = m.T @ p @ m.T.T + m.shock
        cov[t * k : t * k + k, t * k : t * k + k] = p
        c = p
        for u in range(t + 1, T):
            c = m.T @ c
            cov[u * k : u * k + k, t * k : t * k + k] = c
            cov[t * k : t * k + k, u * k : u * k + k] = c.T
    a = np.concatenate(mean)
    Z, d = np.kron(np.eye(T), m.Z), np.tile(m.d, T)
    there = np.isfinite(y.ravel())
    Z, d, H = Z[there], d[there], np.kron(np.eye(T), m.H)[np.ix_(there, there)]
    F = Z @ cov @ Z.T + H
    v = y.ravel()[there] - Z @ a - d
    gain = np.linalg.solve(F, Z @ cov).T
    _, logdet = np.linalg.slogdet(F)
    loglik = -0.5 * (len(v) * np.log(2 * np.pi) + logdet + v @ np.linalg.solve(F, v))
    return (a + gain @ v).reshape(T, k), cov - gain @ Z @ cov, loglik


def models():
    r = np.random.default_rng(2)
    a = np.array([[0.6, 0.2, 0], [0.1, 0.5, 0.1], [0, 0.2, 0.7]])
    h = np.array([[0.5, 0.2], [0.2, 0.4]])
    return {
        "plain": S.Model(a, r.normal(size=(2, 3)), np.diag([0.5, 0.3, 0.2]), np.diag([0.4, 0.6]), c=[0.1, 0, -0.1], d=[1.0, -1.0], start_cov=np.eye(3)),
        "noise together": S.Model(a, r.normal(size=(2, 3)), 0.3 * np.eye(3), h, start_cov=2 * np.eye(3)),
        "companion": S.Model([[0.5, 0.3], [1, 0]], [[1.0, 0], [0.5, 0.2]], np.diag([0.4, 0.0]), np.diag([0.2, 0.3]), start_cov=np.eye(2)),
        "trend": S.Model([[1.0, 1.0], [0, 1]], [[1.0, 0], [2.0, 0]], np.diag([0.2, 0.1]), np.diag([0.5, 0.3]), diffuse=(0, 1)),
        "half diffuse": S.Model([[1.0, 0], [0, 0.7]], [[1.0, 1.0], [3.0, 0]], np.diag([0.2, 0.5]), np.diag([0.5, 0.3]), diffuse=(0,), start_cov=np.eye(2)),
    }


def values(model, seed=1, T=30):
    r = np.random.default_rng(seed)
    y = r.normal(size=(T, len(model.Z))).cumsum(0) * 0.3 + 1
    y[r.random(y.shape) < 0.2] = np.nan
    y[[5, 6, T - 1]] = np.nan
    y[T - 3 :, 0] = np.nan  # a ragged edge
    return y


def frame(spark, series):
    rows = [(k, t, *(None if i % 2 and not np.isfinite(x) else float(x) for i, x in enumerate(v))) for k, y in series.items() for t, v in enumerate(y)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "t", "a", "b"]).astype({"a": object, "b": object}).sample(frac=1, random_state=3), "k string, t long, a double, b double")


@pytest.mark.parametrize("name", list(models()))
def test_states_and_likelihood(spark, name):
    m = models()[name]
    series = {"one": values(m), "two": values(m, 2, 17)}
    if m.diffuse:
        series["late"] = np.vstack([np.full((3, 2), np.nan), values(m, 4, 12)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        f = S.kalman_filter(frame(spark, series), ["k"], "t", ["a", "b"], m).cache()
        got = {(r.k, r.t): r for r in S.kalman_smoother(f, ["k"], "t", m).collect()}
        filtered = {(r.k, r.t): r for r in f.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = len(m.T)
    assert len(got) == sum(map(len, series.values()))
    for k, y in series.items():
        mean, cov, loglik = joint(y, m)
        tol = 1e-3 if m.diffuse else 1e-8
        for t in range(len(y)):
            at = slice(t * n, t * n + n)
            assert np.allclose(got[k, t].smoothed_mean, mean[t], atol=tol) and np.allclose(np.reshape(got[k, t].smoothed_cov, (n, n)), cov[at, at], atol=tol)
        if not m.diffuse:
            assert np.isclose(sum(filtered[k, t].loglik for t in range(len(y))), loglik)
            assert np.allclose(filtered[k, 9].mean, joint(y[:10], m)[0][-1])
        else:
            assert np.allclose(filtered[k, len(y) - 1].diffuse, 0) and np.allclose(filtered[k, len(y) - 1].mean, mean[-1], atol=tol)
            # each diffuse direction costs log(big) / 2
            assert np.isclose(sum(filtered[k, t].loglik for t in range(len(y))), loglik + 0.5 * len(m.diffuse) * np.log(1e8), atol=1e-3)


def test_empty_table(spark):
    m = models()["plain"]
    f = S.kalman_filter(spark.createDataFrame([], "k string, t long, a double, b double"), ["k"], "t", ["a", "b"], m)
    assert S.kalman_smoother(f, ["k"], "t", m).count() == 0


def factor_data(T=150, n=6, seed=0):
    r = np.random.default_rng(seed)
    f = np.zeros(T)
    for t in range(1, T):
        f[t] = 0.8 * f[t - 1] + r.normal()
    x = np.outer(f, r.uniform(0.5, 1.5, n)) + r.normal(size=(T, n)) * 0.5 + 3
    full = x.copy()
    x[-2:, :3] = np.nan
    x[10, 4] = np.nan
    return x, full, f


@pytest.mark.parametrize("lags", [1, 2])
def test_factors(spark, lags):
    x, full, f = factor_data()
    cols = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(t=range(len(x))))
    fit = S.fit_factors(df, "t", cols, 1, lags)
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    c = z[np.isfinite(z).all(1)]
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    load = vt[:1].T * np.sign(vt[0, np.argmax(np.abs(vt[0]))])
    pc = c @ load
    y, lagged = pc[lags:], np.column_stack([pc[lags - p : len(pc) - p] for p in range(1, lags + 1)])
    beta = np.linalg.lstsq(lagged, y, rcond=None)[0]
    assert np.allclose(fit.loadings, load) and np.allclose(fit.model.T[0], beta.ravel()) and np.isclose(fit.model.Q[0, 0], ((y - lagged @ beta) ** 2).mean())
    assert np.allclose(np.diag(fit.model.H), (c - pc @ load.T).var(0)) and np.allclose(fit.means, np.nanmean(x, 0))
    rows = S.nowcast(df, "t", cols, fit).orderBy("t").collect()
    states, _, _ = joint(z, fit.model)
    assert np.allclose([r.factors[0] for r in rows], states[:, 0], atol=1e-5)
    filled = np.array([[r[c] for c in cols] for r in rows])
    assert np.allclose(filled[np.isfinite(x)], x[np.isfinite(x)])
    assert np.abs(filled[-2:, :3] - full[-2:, :3]).mean() < np.abs(np.nanmean(x, 0)[:3] - full[-2:, :3]).mean() * 0.7
    assert abs(np.corrcoef([r.factors[0] for r in rows], f)[0, 1]) > 0.95


def test_factors_need_dates_and_values(spark):
    df = spark.createDataFrame([(t, float(t), float(t) if t < 3 else None) for t in range(9)], "t long, a double, b double")
    with pytest.raises(ValueError, match="few"):
        S.fit_factors(df, "t", ["a", "b"], 1)
    with pytest.raises(ValueError, match="no values"):
        S.fit_factors(df.where("t > 5"), "t", ["a", "b"], 1)
