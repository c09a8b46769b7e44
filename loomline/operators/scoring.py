"""Forecast scores, comparison and combination over rows (t, model, forecast, realized)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_cdf(z: Column) -> Column:
    """Distribution function of the normal as an expression, by a rational approximation (error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def crps_gaussian(y: Column, mu: Column, sigma: Column) -> Column:
    s = F.greatest(sigma, F.lit(1e-12))
    z = (y - mu) / s
    pdf = F.exp(-z * z / 2) / 2.5066282746310002
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * pdf - 0.5641895835477563)


def log_score_gaussian(y: Column, mu: Column, sigma: Column) -> Column:
    s = F.greatest(sigma, F.lit(1e-12))
    return -F.log(s) - 0.9189385332046727 - (y - mu) * (y - mu) / (2 * s * s)


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def crps_ensemble(y: Column, draws: Column, fair: bool) -> Column:
    """Mean distance to y less half the mean distance of pairs: over M(M - 1) pairs if ``fair``, else M^2."""
    m = F.size(draws)
    near = F.aggregate(draws, F.lit(0.0), lambda s, x: s + F.abs(x - y)) / m
    # of sorted draws, the k-th is in k - 1 pairs as the larger and in m - k as the smaller
    ranked = F.transform(F.array_sort(draws), lambda x, i: x * (2 * i + 1 - m))
    spread = 2 * F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x)
    return near - F.coalesce(F.try_divide(spread, m * (m - 1) if fair else m * m), F.lit(0.0)) / 2


def pit(y: Column, draws: Column) -> Column:
    return F.size(F.filter(draws, lambda x: x <= y)) / F.size(draws)


def diebold_mariano(df: DataFrame, by: list[str], order: str, e1: str, e2: str, h: int = 1) -> DataFrame:
    """stat and n of equal squared errors, long-run variance with h - 1 lags, small-sample corrected."""
    all_ = Window.partitionBy(*by)
    d = df.withColumn("d", F.col(e1) * F.col(e1) - F.col(e2) * F.col(e2))
    d = d.withColumn("mean", F.avg("d").over(all_)).withColumn("c", F.col("d") - F.col("mean"))
    w = Window.partitionBy(*by).orderBy(order)
    d = d.withColumns({f"c{l}": F.lag("c", l).over(w) for l in range(1, h)})
    s2 = F.sum(F.col("c") * F.col("c"))
    for l in range(1, h):
        s2 = s2 + 2 * (1 - l / h) * F.coalesce(F.sum(F.col("c") * F.col(f"c{l}")), F.lit(0.0))
    n = F.count("*")
    g = d.groupBy(*by).agg(F.first("mean").alias("mean"), s2.alias("s2"), n.alias("n"))
    fix = F.sqrt((F.col("n") + 1 - 2 * h + h * (h - 1) / F.col("n")) / F.col("n"))
    stat = F.try_divide(F.col("mean"), F.sqrt(F.when(F.col("s2") > 0, F.col("s2") / F.col("n") / F.col("n"))))
    return g.select(*by, (stat * fix).alias("stat"), "n")


def weights(df: DataFrame, by: list[str], alpha: float = 0.10) -> DataFrame:
    """Per model: mse, and weights that are equal, by inverse mse, by inverse rank, and equal within (1 + alpha) of the best."""
    mse = df.groupBy(*by, "model").agg(F.avg((F.col("forecast") - F.col("realized")) * (F.col("forecast") - F.col("realized"))).alias("mse"))
    w, rank = Window.partitionBy(*by), F.row_number().over(Window.partitionBy(*by).orderBy("mse", "model"))
    d = mse.withColumn("rank", rank).withColumn("keep", F.when(F.col("mse") <= (1 + alpha) * F.min("mse").over(w), 1.0).otherwise(0.0)).withColumn("inv", F.try_divide(F.lit(1.0), "mse"))
    part = lambda c: c / F.sum(c).over(w)
    return d.select(*by, "model", "mse", part(F.lit(1.0)).alias("w_equal"), part(F.col("inv")).alias("w_inverse"), part(1 / F.col("rank")).alias("w_rank"), part(F.col("keep")).alias("w_set"))

