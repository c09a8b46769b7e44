"""Identification and inference for vector autoregressions.

Only moments reach the driver: a system of n columns and p lags is (n p + n + 1)^2 numbers whatever its length.
Draws of rotations and bootstrap replicates are rows of ``range``, spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import f_sf
from .confidence_set import stationary_blocks
from .regression import dot, moments, square
from .series import moving_average, var_ols
from .state_space import in_order


def lag_criteria(df: DataFrame, order: str, cols: list[str], most: int = 8) -> DataFrame:
    """p, aic, bic, hq: log determinant of the residual covariance with penalties, each p on its own T - p rows."""
    out = []
    for p in range(1, most + 1):
        _, _, sigma, t = var_ols(df, order, cols, p)
        n, logdet = len(cols), float(np.linalg.slogdet(sigma)[1])
        k = n * n * p
        out.append((p, logdet + 2 * k / t, logdet + k * float(np.log(t)) / t, logdet + 2 * k * float(np.log(np.log(t))) / t))
    return df.sparkSession.createDataFrame(out, "p int, aic double, bic double, hq double")


def lag_choice(criteria: DataFrame, by: str = "bic") -> int:
    """The p of the least criterion, the first of equal ones."""
    return criteria.agg(F.min_by("p", F.struct(by, "p"))).first()[0]


def residuals(df: DataFrame, order: str, cols: list[str], p: int, constant: np.ndarray, a: np.ndarray) -> DataFrame:
    """order, and u_<column> for each column."""
    w = Window.orderBy(order)  # one row a date
    names = [f"{c}_L{k}" for k in range(1, p + 1) for c in cols]
    d = df.select(order, *cols, *[F.lag(c, k).over(w).alias(f"{c}_L{k}") for k in range(1, p + 1) for c in cols]).dropna()
    own = lambda i: [F.lit(float(a[k, i, j])) for k in range(p) for j in range(len(cols))]
    return d.select(order, *[(F.col(c) - float(constant[i]) - dot([F.col(x) for x in names], own(i))).alias(f"u_{c}") for i, c in enumerate(cols)])


def block_exogeneity(df: DataFrame, order: str, cols: list[str], causes: list[str], p: int = 1) -> tuple[float, float, int, int]:
    """(F, p-value, df1, df2) that the lags of ``causes`` belong in no other column's equation."""
    w, others = Window.orderBy(order), [c for c in cols if c not in causes]
    lag = lambda cs: [f"{c}_L{k}" for k in range(1, p + 1) for c in cs]
    d = df.select(*cols, *[F.lag(c, k).over(w).alias(f"{c}_L{k}") for k in range(1, p + 1) for c in cols]).dropna()
    row = moments(d, [], [F.lit(1.0), *map(F.col, [*lag(others), *lag(causes), *others])]).first()
    q, r, n = 1 + p * len(others), p * len(causes), len(others)
    a, t = square(row["m"], q + r + n), row["n"]
    rss = [float(np.trace(a[-n:, -n:] - a[-n:, :k] @ np.linalg.solve(a[:k, :k], a[:k, -n:]))) for k in (q, q + r)]
    df1, df2 = r * n, n * (t - q - r)
    stat = (rss[0] - rss[1]) / df1 / (rss[1] / df2)
    return stat, f_sf(stat, df1, df2), df1, df2


def long_run(a: np.ndarray, sigma: np.ndarray, permanent: int = 0) -> np.ndarray:
    """Impact matrix under which only one shock moves a column for good."""
    n = len(sigma)
    order = [permanent, *[i for i in range(n) if i != permanent]]
    psi = np.linalg.inv(np.eye(n) - a.sum(axis=0))[np.ix_(order, order)]
    b = np.linalg.solve(psi, np.linalg.cholesky(psi @ sigma[np.ix_(order, order)] @ psi.T))
    back = np.argsort(order)
    return b[np.ix_(back, back)]


def rotations(spark: SparkSession, a: np.ndarray, sigma: np.ndarray, signs: dict[int, list[int]], draws: int = 2000, horizon: int = 12, seed: int = 0) -> DataFrame:
    """draw, h, response, value: responses to the first shock of each rotation of the Cholesky factor, drawn uniformly,
    whose responses at each horizon of ``signs`` have its signs (1, -1, or 0 for either)."""
    n, psi, chol = len(sigma), moving_average(a, max(horizon, *signs)), np.linalg.cholesky(sigma)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"]:
                q, r = np.linalg.qr(np.random.default_rng([seed, int(k)]).standard_normal((n, n)))
                path = psi @ (chol @ (q * np.sign(np.diag(r))))[:, 0]
                if all((np.array(s) * path[h] >= 0).all() for h, s in signs.items()):
                    out += [(int(k), h, i, float(path[h, i])) for h in range(horizon + 1) for i in range(n)]
            yield pd.DataFrame(out, columns=["draw", "h", "response", "value"])

    return spark.range(draws).mapInPandas(run, "draw long, h int, response int, value double")


def bands(draws: DataFrame, by: list[str], alpha: float = 0.32) -> DataFrame:
    """by, median, lo, hi, n over draws."""
    p = F.percentile("value", [0.5, alpha / 2, 1 - alpha / 2])
    return draws.groupBy(*by).agg(p.alias("p"), F.count("*").alias("n")).select(*by, F.col("p")[0].alias("median"), F.col("p")[1].alias("lo"), F.col("p")[2].alias("hi"), "n")


def joint_bands(draws: DataFrame, by: list[str], replicate: str = "draw", alpha: float = 0.10) -> DataFrame:
    """by, centre, lo, hi: bands that hold whole paths: the quantile over replicates of the largest studentised deviation."""
    each = draws.groupBy(*by).agg(F.avg("value").alias("centre"), F.stddev_samp("value").alias("sd"))
    far = draws.join(each, by).groupBy(replicate).agg(F.max(F.abs(F.col("value") - F.col("centre")) / F.when(F.col("sd") > 0, F.col("sd"))).alias("far"))
    critical = far.agg(F.percentile("far", 1 - alpha).alias("__c"))  # one row
    return each.join(F.broadcast(critical)).select(*by, "centre", (F.col("centre") - F.col("__c") * F.col("sd")).alias("lo"), (F.col("centre") + F.col("__c") * F.col("sd")).alias("hi"))


def proxy_impact(df: DataFrame, order: str, cols: list[str], z: str, p: int = 1) -> tuple[np.ndarray, float]:
    """(impact column, effective F) of the shock that an outside series stands for: Sigma pi over the root of pi'Sigma pi,
    with pi the slopes of the residuals on it."""
    constant, a, sigma, _ = var_ols(df, order, cols, p)
    d = residuals(df, order, cols, p, constant, a).join(df.select(order, F.col(z).alias("__z")), order).dropna()
    us = [f"u_{c}" for c in cols]
    row = d.agg(F.sum(F.col("__z") * F.col("__z")).alias("zz"), F.avg("__z").alias("mz"), *[F.sum(F.col("__z") * F.col(u)).alias(u) for u in us], F.avg(us[0]).alias("mu"), F.covar_pop("__z", us[0]).alias("c"), F.var_pop("__z").alias("v")).first()
    pi = np.array([row[u] for u in us]) / row["zz"]
    slope = row["c"] / row["v"]
    dev = F.col("__z") - row["mz"]
    err = F.col(us[0]) - row["mu"] - slope * dev
    f = d.agg((F.lit(slope**2) * F.pow(F.sum(dev * dev), 2) / F.sum(F.pow(dev * err, 2))).alias("f")).first()[0]
    return sigma @ pi / np.sqrt(pi @ sigma @ pi), float(f)


def max_share(a: np.ndarray, sigma: np.ndarray, target: int, horizon: int = 20) -> np.ndarray:
    """Impact column of the shock that explains most of a column's forecast error variance up to ``horizon``."""
    chol = np.linalg.cholesky(sigma)
    rows = (moving_average(a, horizon) @ chol)[:, target]
    vectors = np.linalg.eigh(rows.T @ rows)[1]
    best = chol @ vectors[:, -1]
    return best if best[target] >= 0 else -best


def by_variance(df: DataFrame, order: str, cols: list[str], regime: str, p: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(impact matrix, variances in regime 1) when shocks have variance 1 in regime 0 and another one in regime 1."""
    constant, a, _, _ = var_ols(df, order, cols, p)
    d = residuals(df, order, cols, p, constant, a).join(df.select(order, F.col(regime).cast("int").alias("__r")), order)
    s = {r["__r"]: square(r["m"], len(cols)) / (r["n"] - 1) for r in moments(d, ["__r"], [F.col(f"u_{c}") for c in cols]).collect()}  # two rows
    low = np.linalg.cholesky(s[0])
    inv = np.linalg.inv(low)
    values, vectors = np.linalg.eigh(inv @ s[1] @ inv.T)
    return low @ vectors, values


def history(df: DataFrame, order: str, cols: list[str], p: int, impact: np.ndarray) -> DataFrame:
    """order, column, shock, value: what each shock since the first residual adds to each column at each date.

    A date's part is the system's own step from the parts of the dates before, plus the date's shock: residuals are read in order, with
    p dates' parts carried along.
    """
    constant, a, _, _ = var_ols(df, order, cols, p)
    u = residuals(df, order, cols, p, constant, a)
    n, inv = len(cols), np.linalg.inv(impact)

    def step(past: np.ndarray, r: dict) -> tuple[np.ndarray, tuple]:
        shocks = inv @ np.array([r[f"u_{c}"] for c in cols])
        now = sum(a[k] @ past[k] for k in range(p)) + impact * shocks
        return np.concatenate([now[None], past[:-1]]), (now.ravel(),)

    d = u.select(F.lit(1).alias("system"), order, *[f"u_{c}" for c in cols])
    parts = in_order(d, ["system"], [order], "parts array<double>", lambda: np.zeros((p, n, n)), step)
    long = parts.select(order, F.posexplode("parts").alias("i", "value"))
    names = F.array(*map(F.lit, cols))
    return long.select(order, F.get(names, F.floor(F.col("i") / n).cast("int")).alias("column"), F.get(names, F.col("i") % n).alias("shock"), "value")


def replicates(df: DataFrame, order: str, cols: list[str], p: int, identify: Callable[[np.ndarray, np.ndarray], np.ndarray], draws: int = 200, horizon: int = 12, block: float | None = None, seed: int = 0) -> DataFrame:
    """draw, h, response, shock, value of systems estimated from resampled rows: blocks of dates, each with its lags.

    A draw takes rows of the design by blocks of about T^(1/3) dates (or ``block``), as often as ``stationary_blocks`` has them; its system comes from
    one aggregation of weighted products by draw. Nothing but those moments is gathered. Draws whose covariance can't be factored go.
    """
    n, xs = len(cols), [f"x{i}" for i in range(len(cols) * p)]
    w = Window.orderBy(order)  # one row a date
    d = df.select(order, *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(cols)]).dropna()
    d = d.select(order, *[f"y{i}" for i in range(n)], *[F.lag(f"y{i}", k + 1).over(w).alias(f"x{k * n + i}") for k in range(p) for i in range(n)]).dropna()
    d = d.withColumn("taken", F.row_number().over(w).cast("long"))
    sizes = d.agg(F.count("*").alias("n")).withColumn("system", F.lit(1))
    length = F.lit(float(block)) if block else F.greatest(F.lit(1.0), F.round(F.cbrt("n")))
    counts = stationary_blocks(sizes, ["system"], draws, length, seed).groupBy("replicate", "taken").agg(F.count("*").cast("double").alias("times"))
    z = [F.lit(1.0), *map(F.col, xs), *[F.col(f"y{i}") for i in range(n)]]
    size = len(z)
    sums = [F.sum(z[i] * z[j] * F.col("times")).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)]
    m = counts.join(d, "taken").groupBy("replicate").agg(F.sum("times").alias("t"), *sums).select("replicate", "t", F.array(*[f"m{i}_{j}" for i in range(size) for j in range(i, size)]).alias("m"))
    k = 1 + n * p

    @F.pandas_udf("array<double>")
    def paths(moments_: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for v, count in zip(moments_, t, strict=True):
            a = square(v, k + n)
            try:
                beta = np.linalg.solve(a[:k, :k], a[:k, k:])
                sigma = (a[k:, k:] - beta.T @ a[:k, k:]) / (count - k)
                coefficients = np.array([beta[1 + j * n : 1 + (j + 1) * n].T for j in range(p)])
                out.append((moving_average(coefficients, horizon) @ identify(coefficients, sigma)).ravel().tolist())
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out)

    names = F.array(*map(F.lit, cols))
    long = m.select((F.col("replicate").cast("long") - 1).alias("draw"), F.posexplode(paths("m", "t")).alias("i", "value"))
    return long.select("draw", F.floor(F.col("i") / (n * n)).cast("int").alias("h"), F.get(names, F.floor(F.col("i") / n).cast("int") % n).alias("response"), F.get(names, F.col("i") % n).alias("shock"), "value")


def bootstrap(df: DataFrame, order: str, cols: list[str], p: int, identify: Callable[[np.ndarray, np.ndarray], np.ndarray], draws: int = 200, horizon: int = 12, kind: str = "recursive", seed: int = 0) -> DataFrame:
    """draw, h, response, shock, value of re-estimated systems: residuals drawn again (recursive), with random signs
    (wild), or in blocks of about T^(1/3) dates (block).

    Each draw is a series made from the one before it in time, so this is the exception that reads the whole system in a task: its dates
    times columns, which a VAR has few of. ``replicates`` needs no such thing. Draws whose covariance can't be factored go.
    """
    rows = df.select(order, *cols).dropna().orderBy(order).toPandas()[cols].to_numpy(float)  # one row a date
    n, t = len(cols), len(rows) - p
    x = np.column_stack([np.ones(t), *[rows[p - k - 1 : len(rows) - k - 1] for k in range(p)]])
    beta = np.linalg.lstsq(x, rows[p:], rcond=None)[0]
    u = rows[p:] - x @ beta

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"]:
                r = np.random.default_rng([seed, int(k)])
                if kind == "wild":
                    e = u * r.choice([-1.0, 1.0], (t, 1))
                elif kind == "block":
                    size = max(1, round(t ** (1 / 3)))
                    e = np.concatenate([u[s : s + size] for s in r.integers(0, t - size + 1, -(-t // size))])[:t]
                else:
                    e = u[r.integers(0, t, t)]
                e, y = e - e.mean(axis=0), rows.copy()
                for s in range(p, len(y)):
                    y[s] = beta[0] + sum(beta[1 + j * n : 1 + (j + 1) * n].T @ y[s - 1 - j] for j in range(p)) + e[s - p]
                z = np.column_stack([np.ones(t), *[y[p - j - 1 : len(y) - j - 1] for j in range(p)]])
                b = np.linalg.lstsq(z, y[p:], rcond=None)[0]
                v = y[p:] - z @ b
                try:
                    path = moving_average(np.array([b[1 + j * n : 1 + (j + 1) * n].T for j in range(p)]), horizon) @ identify(np.array([b[1 + j * n : 1 + (j + 1) * n].T for j in range(p)]), v.T @ v / (t - 1 - n * p))
                except np.linalg.LinAlgError:
                    continue
                out += [(int(k), h, cols[i], cols[j], float(path[h, i, j])) for h in range(horizon + 1) for i in range(n) for j in range(n)]
            yield pd.DataFrame(out, columns=["draw", "h", "response", "shock", "value"])

    return df.sparkSession.range(draws).mapInPandas(run, "draw long, h int, response string, shock string, value double")


def threshold_var(df: DataFrame, order: str, cols: list[str], state: str, p: int = 1, delays: tuple[int, ...] = (1, 2), trim: float = 0.15, points: int = 25) -> DataFrame:
    """One row: delay, threshold, ssr of the split by the lagged state with the least squared residuals over both sides.

    Every delay and quantile is a cell; rows are copied to the cells and each cell's two sides are groups of one
    aggregation. Sides of less than ``trim`` of the rows don't count; of equal cells the first does.
    """
    w = Window.orderBy(order)
    names = [f"{c}_L{k}" for k in range(1, p + 1) for c in cols]
    d = df.select(order, *cols, *[F.lag(c, k).over(w).alias(f"{c}_L{k}") for k in range(1, p + 1) for c in cols], *[F.lag(state, k).over(w).alias(f"__s{k}") for k in delays if k <= p]).dropna()
    d = d.select(*cols, *names, F.explode(F.array(*[F.struct(F.lit(k).alias("delay"), F.col(f"__s{k}").alias("s")) for k in delays if k <= p])).alias("e")).select(*cols, *names, "e.*")
    shares = [trim + (1 - 2 * trim) * i / (points - 1) for i in range(points)]
    cuts = d.groupBy("delay").agg(F.posexplode(F.percentile("s", shares)).alias("cell", "threshold"))
    d = d.join(F.broadcast(cuts), "delay").withColumn("high", F.col("s") > F.col("threshold"))  # a few hundred cells
    m = moments(d, ["delay", "cell", "threshold", "high"], [F.lit(1.0), *map(F.col, names), *map(F.col, cols)])
    k, n = 1 + len(names), len(cols)

    @F.pandas_udf("double")
    def ssr(v: pd.Series) -> pd.Series:
        def one(x):
            a = square(x, k + n)
            return float(np.trace(a[k:, k:] - a[k:, :k] @ np.linalg.pinv(a[:k, :k]) @ a[:k, k:]))

        return v.map(one)

    g = m.withColumn("ssr", ssr("m")).groupBy("delay", "cell", "threshold").agg(F.sum("ssr").alias("ssr"), F.min("n").alias("least"), F.sum("n").alias("n"), F.count("*").alias("sides"))
    best = F.min_by(F.struct("delay", "threshold", "ssr"), F.struct("ssr", "delay", "cell"))
    return g.where((F.col("sides") == 2) & (F.col("least") >= trim * F.col("n"))).agg(best.alias("b")).select("b.*")
