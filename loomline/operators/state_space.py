"""Linear Gaussian state-space models: the filter, the smoother and the dynamic factor model.

The recursions need a series in order, not all of it at once: rows are dealt by series, sorted, and read
batch by batch with the state carried over, forwards for the filter and backwards for the smoother. A task
holds one batch and one state, however long its series are. The same step serves the streams.

    state' = T state + c + R shock, shock ~ N(0, Q)        y = Z state + d + noise, noise ~ N(0, H)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is below this has no infinite variance.
NONE = 1e-10


@dataclass(frozen=True)
class State:
    """Mean, covariance, and the part of the covariance that a large number multiplies."""

    mean: np.ndarray
    cov: np.ndarray
    diffuse: np.ndarray


@dataclass(frozen=True)
class Model:
    """Matrices of the model above. States named in ``diffuse`` begin with infinite variance, the others with ``start_cov``.

    Left out: R is the identity, c, d and start_mean are zero, start_cov is ``wide`` times the identity.
    """

    T: np.ndarray
    Z: np.ndarray
    Q: np.ndarray
    H: np.ndarray
    R: np.ndarray | None = None
    c: np.ndarray | None = None
    d: np.ndarray | None = None
    start_mean: np.ndarray | None = None
    start_cov: np.ndarray | None = None
    diffuse: tuple[int, ...] = ()
    wide: float = 1e6
    shock: np.ndarray = field(init=False)

    def __post_init__(self):
        m, n = np.shape(self.T)[0], np.shape(self.Z)[0]
        given = {"R": np.eye(m), "c": np.zeros(m), "d": np.zeros(n), "start_mean": np.zeros(m), "start_cov": self.wide * np.eye(m)}
        for name in ("T", "Z", "Q", "H", *given):
            value = getattr(self, name)
            object.__setattr__(self, name, np.array(given[name] if value is None else value, float))
        object.__setattr__(self, "shock", self.R @ self.Q @ self.R.T)

    def start(self) -> State:
        cov, inf = self.start_cov.copy(), np.zeros_like(self.T)
        for i in self.diffuse:
            cov[i], cov[:, i], inf[i, i] = 0, 0, 1
        return State(self.start_mean.copy(), cov, inf)

    def update(self, s: State, y: np.ndarray) -> tuple[State, float]:
        """The state after the values that there are in ``y``, taken one by one, and their log likelihood."""
        there = np.isfinite(y)
        z, v, h = self.Z[there], (y - self.d)[there], self.H[np.ix_(there, there)]
        mean, cov, inf, loglik = s.mean.copy(), s.cov.copy(), s.diffuse.copy(), 0.0
        if np.any(h - np.diag(np.diag(h))):  # noise of several values at once: make it independent first
            root = np.linalg.cholesky(h)
            z, v, loglik = np.linalg.solve(root, z), np.linalg.solve(root, v), -float(np.log(np.diag(root)).sum())
            h = np.eye(len(v))
        for zk, vk, hk in zip(z, v, np.diag(h), strict=True):
            e, known, open_ = vk - zk @ mean, cov @ zk, inf @ zk
            var, infinite = float(zk @ known + hk), float(zk @ open_)
            if infinite > NONE:
                gain = open_ / infinite
                mean = mean + gain * e
                cov = cov + var * np.outer(gain, gain) - np.outer(gain, known) - np.outer(known, gain)
                inf = inf - np.outer(gain, open_)
                inf[np.abs(inf) < NONE] = 0
                loglik -= 0.5 * np.log(2 * np.pi * infinite)
            elif var > 0:
                mean = mean + known * (e / var)
                cov = cov - np.outer(known, known) / var
                loglik -= 0.5 * (np.log(2 * np.pi * var) + e * e / var)
        return State(mean, cov, inf), loglik

    def predict(self, s: State) -> State:
        return State(self.T @ s.mean + self.c, self.T @ s.cov @ self.T.T + self.shock, self.T @ s.diffuse @ self.T.T)

    def back(self, s: State, later: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed mean and covariance, from the filtered state and the next date's smoothed ones.

        The gain is the limit for a large multiple of the diffuse part, and the covariance is written as a sum in which a small
        error of the gain doesn't count, so that the infinite parts cancel.
        """
        p = self.predict(s)
        if np.abs(p.diffuse).max() > NONE:
            values, vectors = np.linalg.eigh(p.diffuse)
            free = vectors[:, values <= NONE * max(1.0, values.max())]
            finite = free @ np.linalg.pinv(free.T @ p.cov @ free, hermitian=True) @ free.T
            rest = np.eye(len(p.mean)) - finite @ p.cov
            gain = s.cov @ self.T.T @ finite + s.diffuse @ self.T.T @ (rest @ np.linalg.pinv(p.diffuse, rcond=NONE, hermitian=True) @ rest.T)
        else:
            gain = s.cov @ self.T.T @ np.linalg.pinv(p.cov, hermitian=True)
        keep = np.eye(len(p.mean)) - gain @ self.T
        return s.mean + gain @ (later[0] - p.mean), keep @ s.cov @ keep.T + gain @ (self.shock + later[1]) @ gain.T


def in_order(df: DataFrame, by: list[str], order: list, schema: str, begin: Callable, step: Callable) -> DataFrame:
    """``step`` over each series' rows in order: state, row -> state, output columns.

    Rows are dealt by series and sorted; a batch's last state goes on with the next batch. ``begin`` makes a series' first state;
    ``step`` gets (state, row as a tuple, its columns by name). The columns of ``df`` are handed on before those of ``schema``.
    """
    names, types = df.columns, dict(df.dtypes)
    added = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                r = dict(zip(names, row, strict=True))
                key = tuple(r[c] for c in by)
                if key != at:
                    at, state = key, begin()
                state, out = step(state, r)
                rows.append((*row, *out))
            yield pd.DataFrame(rows, columns=[*names, *added])

    kept = ", ".join(f"`{c}` {types[c]}" for c in names)
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, f"{kept}, {schema}")


def kalman_filter(df: DataFrame, by: list[str], order: str, ys: list[str], model: Model) -> DataFrame:
    """Each row of ``df`` (by, order, ys) with mean, cov and diffuse (row by row) of the state after it, and loglik.

    A series' rows are its periods, one step of the model each; null or NaN values are missing, and a period without any is only
    predicted. States that no value has reached yet keep their diffuse part. The likelihood of a value that ends a diffuse
    part counts its log variance only. Series keys aren't null. An empty table gives an empty result.
    """

    def step(state: State, r: dict) -> tuple[State, tuple]:
        s, loglik = model.update(state, np.array([np.nan if r[y] is None else r[y] for y in ys], float))
        return model.predict(s), (s.mean, s.cov.ravel(), s.diffuse.ravel(), loglik)

    d = df.select(*by, order, *[F.col(y).cast("double").alias(y) for y in ys])
    return in_order(d, by, [order], "mean array<double>, cov array<double>, diffuse array<double>, loglik double", model.start, step)


def kalman_smoother(filtered: DataFrame, by: list[str], order: str, model: Model) -> DataFrame:
    """by, order, and smoothed_mean, smoothed_cov of the states given the whole series, from ``kalman_filter``'s rows."""
    m = len(model.T)

    def step(later: tuple | None, r: dict) -> tuple[tuple, tuple]:
        s = State(np.asarray(r["mean"]), np.asarray(r["cov"]).reshape(m, m), np.asarray(r["diffuse"]).reshape(m, m))
        now = (s.mean, s.cov) if later is None else model.back(s, later)
        return now, (now[0], now[1].ravel())

    d = filtered.select(*by, order, "mean", "cov", "diffuse")
    return in_order(d, by, [F.desc(order)], "smoothed_mean array<double>, smoothed_cov array<double>", lambda: None, step).drop("mean", "cov", "diffuse")


@dataclass(frozen=True)
class Factors:
    """A dynamic factor model of standardised columns: state-space form, loadings (column by factor), means and deviations."""

    model: Model
    loadings: np.ndarray
    means: np.ndarray
    deviations: np.ndarray


def fit_factors(df: DataFrame, order: str, cols: list[str], n_factors: int, n_lags: int = 1) -> Factors:
    """Two steps: principal components of the dates that have all columns, a vector autoregression of theirs, and the columns' noise.

    Columns are standardised by what there is of each. A factor's sign makes its largest loading positive. The
    loadings have unit length, as eigenvectors of the dates' cross-products. Everything is sums over dates, of the columns' products
    and of those of the components and their lags; lags run over the complete dates as they follow each other.
    """
    values = [F.col(c).cast("double") for c in cols]
    d = df.select(order, *[F.when(~F.isnan(v), v).alias(c) for v, c in zip(values, cols, strict=True)])
    s = d.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if any(s[f"m{i}"] is None for i in range(len(cols))):
        raise ValueError("a column has no values")
    means, sd = np.array([s[f"m{i}"] for i in range(len(cols))]), np.array([s[f"s{i}"] for i in range(len(cols))])
    sd = np.where(sd < 1e-12, 1.0, sd)
    x = [(F.col(c) - m) / q for c, m, q in zip(cols, means.tolist(), sd.tolist(), strict=True)]
    full = d.dropna(subset=cols).select(order, F.array(*x).alias("x"))
    n = len(cols)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    g = full.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col("x")[i]).alias(f"t{i}") for i in range(n)]).first()
    if g.n <= max(n_factors, n_lags) + 2:
        raise ValueError(f"{g.n} complete dates are too few for {n_factors} factors and {n_lags} lags")
    gram = np.zeros((n, n))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = g[f"g{i}_{j}"]
    _, vectors = np.linalg.eigh(gram)
    loadings = vectors[:, ::-1][:, :n_factors]
    loadings = loadings * np.sign(loadings[np.argmax(np.abs(loadings), axis=0), np.arange(n_factors)])
    # what is left of column i is row i of I - LL' times x
    left = np.eye(n) - loadings @ loadings.T
    sums = np.array([g[f"t{i}"] for i in range(n)])
    noise = np.maximum(np.einsum("ij,jk,ik->i", left, gram, left) / g.n - (left @ sums / g.n) ** 2, 1e-6)
    a, q = _factor_var(full, order, loadings, n_lags)
    k = n_factors * n_lags
    z = np.zeros((n, k))
    z[:, :n_factors] = loadings
    return Factors(Model(a, z, q, np.diag(noise)), loadings, means, sd)


def _factor_var(full: DataFrame, order: str, loadings: np.ndarray, n_lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Companion matrix and shock covariance of the components, from the moments of them and their lags."""
    from pyspark.sql import Window

    k, n = loadings.shape[1], loadings.shape[0]
    f = full.select(order, *[sum((F.col("x")[i] * float(loadings[i, j]) for i in range(n)), F.lit(0.0)).alias(f"f{j}") for j in range(k)])
    w = Window.orderBy(order)  # one row a date
    lagged = f.select(*[F.col(f"f{j}").alias(f"c{j}") for j in range(k)], *[F.lag(f"f{j}", p).over(w).alias(f"c{p * k + j}") for p in range(1, n_lags + 1) for j in range(k)]).dropna()
    size = k * (n_lags + 1)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    r = lagged.agg(F.count("*").alias("n"), *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    g = np.zeros((size, size))
    for i, j in pairs:
        g[i, j] = g[j, i] = r[f"g{i}_{j}"]
    beta = np.linalg.solve(g[k:, k:], g[k:, :k])
    a, q = np.zeros((k * n_lags, k * n_lags)), np.zeros((k * n_lags, k * n_lags))
    a[:k] = beta.T
    a[k:, :-k] = np.eye(k * (n_lags - 1))
    q[:k, :k] = (g[:k, :k] - beta.T @ g[k:, :k]) / max(1, r.n)
    return a, q


def nowcast(df: DataFrame, order: str, cols: list[str], f: Factors) -> DataFrame:
    """order, factors (array), and each column as it is or, where it is missing, as the smoothed factors have it."""
    d = df.select(order, *[F.col(c).cast("double").alias(c) for c in cols]).withColumn("system", F.lit(1))
    x = d.select("system", order, *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(cols, f.means.tolist(), f.deviations.tolist(), strict=True)])
    smooth = kalman_smoother(kalman_filter(x, ["system"], order, cols, f.model), ["system"], order, f.model)
    k = f.loadings.shape[1]
    states = smooth.select(order, F.slice("smoothed_mean", 1, k).alias("factors"))
    implied = lambda i: sum((F.col("factors")[j] * float(f.loadings[i, j]) for j in range(k)), F.lit(0.0)) * float(f.deviations[i]) + float(f.means[i])
    return d.join(states, order).select(order, "factors", *[F.when(F.col(c).isNull() | F.isnan(c), implied(i)).otherwise(F.col(c)).alias(c) for i, c in enumerate(cols)])
