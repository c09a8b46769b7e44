"""Time-series tests, filters and systems, by entity, on the regression aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .regression import _lagged, estimate, moments, scores, solver, square
from .windows import lags, over


def adf(df: DataFrame, by: list[str], order: str, y: str, n_lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller t statistic of y_{t-1} with a constant."""
    w = over(by, order)
    d = df.select(*by, order, y, F.lag(y, 1).over(w).alias("level"), (F.col(y) - F.lag(y, 1).over(w)).alias("dy"))
    d = d.select("*", *lags(["dy"], n_lags, by, order))
    return estimate(scores(d, by, "dy", ["level", *[f"dy_L{k}" for k in range(1, n_lags + 1)]], "level"), by, "classical").select(*by, F.col("beta").alias("rho"), F.col("t").alias("adf_t"), "n")


def kpss(df: DataFrame, by: list[str], order: str, y: str, bandwidth: int = 4) -> DataFrame:
    """Level stationarity: squared partial sums over the long-run variance with Bartlett weights."""
    d = df.dropna(subset=[y]).withColumn("q", F.col(y) - F.avg(y).over(Window.partitionBy(*by)))
    d = d.withColumn("s", F.sum("q").over(over(by, order, Window.unboundedPreceding, 0))).withColumn("beta", F.lit(0.0)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    long_run = _lagged(d, by, order, bandwidth, F.lit(bandwidth)).select(*by, "n", (F.col("variance") / F.col("n")).alias("lrv"))
    sums = d.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    return sums.join(long_run, by).select(*by, F.try_divide("ss", F.col("n") * F.col("n") * F.col("lrv")).alias("kpss"), "n")


def hamilton(df: DataFrame, by: list[str], order: str, y: str, h: int = 8, p: int = 4) -> DataFrame:
    """Cycle: the residual of y_t on y_{t-h} ... y_{t-h-p+1} and a constant."""
    w = over(by, order)
    xs = [f"x{k}" for k in range(p)]
    d = df.select(*by, order, y, *[F.lag(y, h + k).over(w).alias(x) for k, x in enumerate(xs)])
    return scores(d, by, y, xs, xs[0]).select(*by, order, (F.col(y) - F.col("u")).alias("trend"), F.col("u").alias("cycle"))


def granger(df: DataFrame, by: list[str], order: str, y: str, x: str, p: int = 2) -> DataFrame:
    """F statistic of x's lags in y's equation, restricted against unrestricted residual sums."""
    d = df.select(*by, order, y, x, *lags([y, x], p, by, order)).dropna()
    own, other = [f"{y}_L{k}" for k in range(1, p + 1)], [f"{x}_L{k}" for k in range(1, p + 1)]
    parts = []
    for name, xs in (("r", own), ("u", own + other)):
        m = moments(d, by, [F.lit(1.0), *map(F.col, xs), F.col(y)])
        parts.append(m.withColumn("s", solver(len(xs) + 1, 0)("m")).select(*by, "n", F.col("s.ssr").alias(f"ssr_{name}")))
    j = parts[0].join(parts[1].drop("n"), by)
    dof = F.col("n") - 2 * p - 1
    return j.select(*by, F.try_divide((F.col("ssr_r") - F.col("ssr_u")) / p, F.col("ssr_u") / dof).alias("f_stat"), F.lit(p).alias("df1"), dof.alias("df2"))


def har(df: DataFrame, by: list[str], order: str, rv: str) -> DataFrame:
    """HAR regression of rv_{t+1} on the overlapping day, week and month means; the day's coefficient."""
    from .windows import har_terms

    d = df.select(*by, order, F.lead(rv, 1).over(over(by, order)).alias("next"), *har_terms(rv, by, order, overlapping=True))
    return estimate(scores(d, by, "next", ["rv_d", "rv_w", "rv_m"], "rv_d"), by, "hac", order, most=5)


def var_ols(df: DataFrame, order: str, cols: list[str], p: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(constant, A of shape (p, n, n), Sigma, observations) of a VAR: one aggregation, a small solve here.

    Only cross-moments of n p + n + 1 columns leave the cluster. Sigma divides by T - p - 1 - n p.
    """
    d = df.select(order, *cols, *[F.lag(c, k).over(Window.orderBy(order)).alias(f"{c}_L{k}") for k in range(1, p + 1) for c in cols]).dropna()
    n, xs = len(cols), [f"{c}_L{k}" for k in range(1, p + 1) for c in cols]
    row = moments(d, [], [F.lit(1.0), *map(F.col, xs), *map(F.col, cols)]).first()
    k = 1 + n * p
    a, t = square(row["m"], k + n), row["n"]
    beta = np.linalg.solve(a[:k, :k], a[:k, k:])
    sigma = (a[k:, k:] - beta.T @ a[:k, k:]) / (t - k)
    return beta[0], np.array([beta[1 + i * n : 1 + (i + 1) * n].T for i in range(p)]), sigma, t


def moving_average(a: np.ndarray, h: int) -> np.ndarray:
    """Moving-average matrices 0 to h of a VAR."""
    p, n, _ = a.shape
    psi = np.zeros((h + 1, n, n))
    psi[0] = np.eye(n)
    for s in range(1, h + 1):
        psi[s] = sum(a[k] @ psi[s - 1 - k] for k in range(min(p, s)))
    return psi


def fevd(theta: np.ndarray) -> np.ndarray:
    """Shares of shocks in forecast error variances up to each horizon, from orthogonal responses."""
    total = np.cumsum(theta**2, axis=0)
    return total / total.sum(axis=2, keepdims=True)


def gfevd(psi: np.ndarray, sigma: np.ndarray, normalise: bool = True) -> np.ndarray:
    num = np.cumsum((psi @ sigma) ** 2, axis=0) / np.diag(sigma)
    out = num / np.cumsum(np.einsum("hij,jk,hik->hi", psi, sigma, psi), axis=0)[:, :, None]
    return out / out.sum(axis=2, keepdims=True) if normalise else out


def spillover(shares: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(total, to others, from others), in per cent, of one horizon's normalised shares."""
    off = shares - np.diag(np.diag(shares))
    return 100 * off.sum() / len(shares), 100 * off.sum(axis=0), 100 * off.sum(axis=1)


def tidy(spark, names: list[str], values: np.ndarray, column: str) -> DataFrame:
    """(h, response, shock) rows of a stack of matrices."""
    rows = [(h, names[i], names[j], float(values[h, i, j])) for h in range(len(values)) for i in range(len(names)) for j in range(len(names))]
    return spark.createDataFrame(rows, f"h int, response string, shock string, {column} double")


def principal_component(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, list[float], list[float]]:
    """(loadings, eigenvalues, means, deviations) of standardised columns, from one aggregation; the first
    loading of each component is positive."""
    d = df.dropna(subset=cols)
    row = moments(d, [], [F.lit(1.0), *map(F.col, cols)]).first()
    m, n = square(row["m"], len(cols) + 1), row["n"]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    vectors = vectors[:, ::-1] * np.where(vectors[0, ::-1] < 0, -1, 1)
    return vectors, values[::-1], mean.tolist(), sd.tolist()


def factor(cols: list[str], loadings: np.ndarray, means: list[float], sds: list[float]) -> Column:
    return sum((float(w) * (F.col(c) - m) / s for c, w, m, s in zip(cols, loadings, means, sds, strict=True)), F.lit(0.0))


def factor_criteria(df: DataFrame, cols: list[str], most: int = 10) -> pd.DataFrame:
    """k, unexplained, ic1, ic2, ic3 for 0 to ``most`` factors of standardised columns: log of the unexplained share, and
    three penalties of k by rows T and columns n. The best k is where a criterion is least.

    What k components leave is the sum of the later eigenvalues, so one aggregation of moments serves all k. Rows with
    a missing column and columns that don't move must be left out by the caller.
    """
    n, t = len(cols), df.dropna(subset=cols).count()
    _, values, _, _ = principal_component(df, cols)
    k = np.arange(min(most, n) + 1)
    left = np.array([max(float(values[i:].sum()) / n, 0.0) for i in k])
    with np.errstate(divide="ignore"):
        log = np.log(left)
    rate, small = (n + t) / (n * t), min(n, t)
    return pd.DataFrame({"k": k, "unexplained": left, "ic1": log + k * rate * np.log(1 / rate), "ic2": log + k * rate * np.log(small), "ic3": log + k * np.log(small) / small})


def hp_trend(v: np.ndarray, lam: float) -> np.ndarray:
    """(I + lam D'D) x = v by elimination in the five bands, in time and space of the series' length."""
    n = len(v)
    if n < 3:
        return v
    main, one, two = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, (p, q, r) in enumerate(((1, -2, 1),) * (n - 2)):
        main[k : k + 3] += (p * p, q * q, r * r)
        one[k : k + 2] += (p * q, q * r)
        two[k] += p * r
    main, one, two = 1 + lam * main, lam * one, lam * two
    x = v.astype(float).copy()
    for i in range(n - 1):
        m = one[i] / main[i]
        main[i + 1] -= m * one[i]
        x[i + 1] -= m * x[i]
        if i + 2 < n:
            one[i + 1] -= m * two[i]
            m = two[i] / main[i]
            main[i + 2] -= m * two[i]
            x[i + 2] -= m * x[i]
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (one[i] * x[i + 1] if i + 1 < n else 0) - (two[i] * x[i + 2] if i + 2 < n else 0)) / main[i]
    return x


def _per_series(df: DataFrame, by: list[str], order: str, y: str, out: str, run) -> DataFrame:
    """``run`` of each series' values in order, a dict of arrays of the same length."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({**{b: pdf[b] for b in by}, order: pdf[order], **run(pdf[y].to_numpy(float))})

    types = dict(df.dtypes)
    return df.select(*by, order, y).dropna().groupBy(*by).applyInPandas(apply, ", ".join(f"{c} {types[c]}" for c in [*by, order]) + ", " + out)


def hp_filter(df: DataFrame, by: list[str], order: str, y: str, lam: float = 1600.0) -> DataFrame:
    """Trend of the penalised second difference: a banded system per series."""

    def run(v: np.ndarray) -> dict:
        trend = hp_trend(v, lam)
        return {"trend": trend, "cycle": v - trend}

    return _per_series(df, by, order, y, "trend double, cycle double", run)


def garch_variance(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    out, s = np.empty(len(r)), float(np.var(r))
    for t in range(len(r)):
        out[t] = s = max(s, 1e-10)
        s = omega + alpha * r[t] * r[t] + beta * s
    return out


def garch_path(df: DataFrame, by: list[str], order: str, r: str, omega: float, alpha: float, beta: float) -> DataFrame:
    """Conditional variance of GARCH(1,1) at given parameters, from the sample variance on, at least 1e-10."""
    return _per_series(df, by, order, r, "sigma2 double", lambda v: {"sigma2": garch_variance(v, omega, alpha, beta)})


def simplex_search(f, start: np.ndarray, step: float = 0.5, rounds: int = 600, tolerance: float = 1e-10) -> np.ndarray:
    """Nelder and Mead's minimum of a function of a few variables."""
    points = [start] + [start + step * e for e in np.eye(len(start))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        tried = middle + (middle - points[-1])
        value = f(tried)
        if value < values[0]:
            far = middle + 2 * (middle - points[-1])
            tried, value = min(((tried, value), (far, f(far))), key=lambda x: x[1])
        elif value >= values[-2]:
            near = middle + 0.5 * ((tried if value < values[-1] else points[-1]) - middle)
            tried, value = near, f(near)
            if value >= values[-1]:
                points = [points[0] + 0.5 * (p - points[0]) for p in points]
                values = [f(p) for p in points]
                continue
        points[-1], values[-1] = tried, value
    return points[int(np.argmin(values))]


def garch_fit(df: DataFrame, by: list[str], order: str, r: str, least: int = 50) -> DataFrame:
    """omega, alpha, beta, loglik, n of GARCH(1,1) by Gaussian likelihood for each series of ``least`` values or more."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[r].to_numpy(float)
        if len(v) < least or not v.var():
            return pd.DataFrame(columns=[*by, "omega", "alpha", "beta", "loglik", "n"])

        def natural(p: np.ndarray) -> tuple[float, float, float]:
            a, b = np.exp(np.clip(p[1:], -30, 30))
            return float(np.exp(np.clip(p[0], -30, 30)) * v.var()), float(a / (1 + a + b)), float(b / (1 + a + b))

        def loss(p: np.ndarray) -> float:
            s = garch_variance(v, *natural(p))
            return float(0.5 * (np.log(2 * np.pi * s) + v * v / s).sum())

        starts = [simplex_search(loss, np.array(p)) for p in ([-3.0, 0.0, 2.2], [-0.7, -1.0, 0.0])]
        best = min(starts, key=loss)
        return pd.DataFrame([(*pdf[by].iloc[0], *natural(best), -loss(best), len(v))], columns=[*by, "omega", "alpha", "beta", "loglik", "n"])

    types = dict(df.dtypes)
    return df.select(*by, order, r).dropna().groupBy(*by).applyInPandas(fit, ", ".join(f"{c} {types[c]}" for c in by) + ", omega double, alpha double, beta double, loglik double, n long")


def ccc_garch(df: DataFrame, code: str, order: str, r: str, least: int = 50) -> tuple[DataFrame, DataFrame, float]:
    """(code, order, r, sigma2, z), (i, j, rho) and the log likelihood of GARCH(1,1) series with constant correlations.

    Every series is fitted alone and read once more with its own parameters; correlations and the likelihood are then
    moments of standardised residuals over the dates that all fitted series have, so only a square of the series'
    number reaches the driver. Series of fewer than ``least`` values or without variance take no part.
    """
    rows = df.select(code, order, r).dropna()
    fits = garch_fit(rows, [code], order, r, least).select(F.col(code).alias("__c"), "omega", "alpha", "beta")

    def path(pdf: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(fit):
            return pd.DataFrame(columns=[code, order, r, "sigma2", "z"])
        pdf, f = pdf.sort_values(order), fit.iloc[0]
        v = pdf[r].to_numpy(float)
        s = garch_variance(v, f["omega"], f["alpha"], f["beta"])
        return pd.DataFrame({code: pdf[code], order: pdf[order], r: v, "sigma2": s, "z": v / np.sqrt(s)})

    types = dict(df.dtypes)
    out = checkpointed(rows.groupBy(code).cogroup(fits.groupBy("__c")).applyInPandas(path, f"{code} {types[code]}, {order} {types[order]}, {r} double, sigma2 double, z double"))
    names = [x[0] for x in out.select(code).distinct().orderBy(code).collect()]
    n = len(names)
    wide = out.groupBy(order).agg(*[F.max(F.when(F.col(code) == name, F.col("z"))).alias(f"z{i}") for i, name in enumerate(names)], F.sum(F.log("sigma2")).alias("logs"))
    cols = [f"z{i}" for i in range(n)]
    m = moments(wide.dropna(subset=cols), [], [F.lit(1.0), *map(F.col, cols), F.col("logs")]).first() if n else None
    if m is None or m["n"] < 2:
        raise ValueError("no two dates that all fitted series have")
    a, t = square(m["m"], n + 2), m["n"]
    cov = a[1:-1, 1:-1] - np.outer(a[0, 1:-1], a[0, 1:-1]) / t
    sd = np.sqrt(np.diag(cov))
    rho = cov / np.outer(sd, sd)
    sign, det = np.linalg.slogdet(rho)
    loglik = float(-0.5 * (t * (n * np.log(2 * np.pi) + det) + a[0, -1] + np.trace(np.linalg.solve(rho, a[1:-1, 1:-1])))) if sign > 0 else float("nan")
    pairs = df.sparkSession.createDataFrame([(names[i], names[j], float(rho[i, j])) for i in range(n) for j in range(n)], f"i {types[code]}, j {types[code]}, rho double")
    return out, pairs, loglik


def ccc_covariance(paths: DataFrame, pairs: DataFrame, code: str, order: str) -> DataFrame:
    """order, i, j, cov: the conditional covariance of each pair of series at dates that both have, i not after j."""
    one = paths.select(F.col(order), F.col(code).alias("i"), F.col("sigma2").alias("a"))
    two = paths.select(F.col(order), F.col(code).alias("j"), F.col("sigma2").alias("b"))
    wanted = F.broadcast(pairs.where("i <= j"))  # made from the driver's square of series
    return one.join(wanted, "i").join(two, [order, "j"]).select(order, "i", "j", (F.col("rho") * F.sqrt(F.col("a") * F.col("b"))).alias("cov"))
