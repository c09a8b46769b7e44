"""Ordered operators: designs of lags, ranks, filters and rolling measures, by entity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(by: list[str], order: str, lo: int | None = None, hi: int | None = None):
    w = Window.partitionBy(*by).orderBy(order)
    return w if lo is None else w.rowsBetween(lo, hi)


def lags(cols: list[str], n: int, by: list[str], order: str) -> list[Column]:
    """Positional lags 1 to n: the row before counts, whatever its date."""
    return [F.lag(c, k).over(over(by, order)).alias(f"{c}_L{k}") for k in range(1, n + 1) for c in cols]


def long_difference(y: str, h: int, by: list[str], order: str) -> Column:
    """y at t + h less y at t - 1."""
    w = over(by, order)
    return F.lead(y, h).over(w) - F.lag(y, 1).over(w)


def horizons(df: DataFrame, y: str, hs: list[int], by: list[str], order: str, difference: bool = True) -> DataFrame:
    """A row per horizon h, with dy: y at t + h, less y at t - 1 if ``difference``. Nulls stay."""
    w = over(by, order)
    base = F.lag(y, 1).over(w) if difference else F.lit(0.0)
    leads = F.array(*[F.struct(F.lit(h).alias("h"), (F.lead(y, h).over(w) if h else F.col(y)).alias("lead")) for h in hs])
    d = df.withColumn("__base", base).withColumn("__x", leads).withColumn("__e", F.explode("__x"))
    return d.select("*", F.col("__e.h").alias("h"), (F.col("__e.lead") - F.col("__base")).alias("dy")).drop("__x", "__e", "__base")


def log_difference(c: str, by: list[str], order: str, periods: int = 1) -> Column:
    return F.log(c) - F.log(F.lag(c, periods).over(over(by, order)))


def zscore(c: str, by: list[str], mean: float = 0.0, sd: float = 1.0) -> Column:
    """Standardised by the population deviation, then put on the given mean and deviation."""
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)) * sd + mean


def pct_rank(c: str, by: list[str]) -> Column:
    """Average rank of ties over the number of rows."""
    n = F.count(c).over(Window.partitionBy(*by))
    ties = F.count(c).over(Window.partitionBy(*by, c))
    return F.when(F.col(c).isNotNull(), (F.rank().over(Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())) + (ties - 1) / 2) / n)


def smooth_transition(state: Column, gamma: float) -> Column:
    return 1 / (1 + F.exp(-gamma * state))


def band_pass_weights(low: int = 6, high: int = 32, k: int = 12) -> list[float]:
    """Weights of the symmetric band-pass filter for lags 0 to k; the two-sided weights sum to zero."""
    a, b = 2 * math.pi / high, 2 * math.pi / low
    ideal = [(b - a) / math.pi] + [(math.sin(b * j) - math.sin(a * j)) / (math.pi * j) for j in range(1, k + 1)]
    shift = (ideal[0] + 2 * sum(ideal[1:])) / (2 * k + 1)
    return [w - shift for w in ideal]


def band_pass(c: str, by: list[str], order: str, low: int = 6, high: int = 32, k: int = 12) -> Column:
    w, weights = over(by, order), band_pass_weights(low, high, k)
    out = F.col(c) * weights[0]
    for j, x in enumerate(weights[1:], 1):
        out = out + x * (F.lag(c, j).over(w) + F.lead(c, j).over(w))
    return out


def har_terms(rv: str, by: list[str], order: str, overlapping: bool = False) -> list[Column]:
    """Day, week and month terms. Separate windows: day t-1, mean of t-5..t-2, mean of t-22..t-6; ``overlapping``:
    means of the 1, 5 and 22 rows up to t. A term is null until its window is full."""
    spans = {"d": (0, 0), "w": (-4, 0), "m": (-21, 0)} if overlapping else {"d": (-1, -1), "w": (-5, -2), "m": (-22, -6)}
    full = lambda lo, hi: F.count(rv).over(over(by, order, lo, hi)) == hi - lo + 1
    return [F.when(full(*s), F.avg(rv).over(over(by, order, *s))).alias(f"rv_{n}") for n, s in spans.items()]


def haar(df: DataFrame, c: str, by: list[str], order: str, levels: int = 3) -> DataFrame:
    """Maximal-overlap Haar details d1, d2, ... and the last smooth; each series wraps around its end.

    Level j's detail is half the difference of the means of the newer and the older 2^(j-1) rows.
    """
    span = 2**levels - 1
    every, at = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("__i")
    d = df.select(*by, order, F.col(c).alias("__v"), F.row_number().over(over(by, order)).alias("__i"), F.count("*").over(every).alias("__n"))
    # the last rows once more before the first, as often as the span asks for
    wrapped = d.withColumn("__k", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(span) / F.col("__n")).cast("int")))).withColumn("__i", F.col("__i") - F.col("__k") * F.col("__n")).where(F.col("__i") > -span)
    out = []
    for j in range(1, levels + 1):
        half = 2 ** (j - 1)
        newer, older = F.avg("__v").over(at.rowsBetween(-half + 1, 0)), F.avg("__v").over(at.rowsBetween(-2 * half + 1, -half))
        out.append(((newer - older) / 2).alias(f"d{j}"))
        if j == levels:
            out.append(((newer + older) / 2).alias("smooth"))
    return wrapped.select(*by, order, "__k", *out).where("__k = 0").drop("__k")


def between_within(panel: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    """Variance of date means, mean variance around them, and the first's share, over balanced rows."""
    by_date = panel.groupBy(date).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return by_date.agg(F.var_pop("m").alias("between"), F.avg("v").alias("within")).withColumn("share", F.try_divide("between", F.col("between") + F.col("within")))


def rolling_between_within(panel: DataFrame, date: str, value: str, index: str, half: int = 60) -> DataFrame:
    """The same in a centred window of ``half`` dates either way; dates without a full window are left out."""
    by_date = panel.groupBy(date).agg(F.first(index).alias("i"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.orderBy("i").rowsBetween(-half, half)  # one row per date
    d = by_date.select(date, F.count("*").over(w).alias("n"), F.var_pop("m").over(w).alias("between"), F.avg("v").over(w).alias("within"))
    return d.where(F.col("n") == 2 * half + 1).withColumn("share", F.try_divide("between", F.col("between") + F.col("within"))).drop("n")


def kruskal_wallis(panel: DataFrame, by: list[str], group: Column, value: str, least: int = 36) -> DataFrame:
    """H statistic of equal levels across groups, with the correction for ties, per key."""
    d = panel.where(F.col(value).isNotNull()).withColumn("__g", group)
    n = F.count("*").over(Window.partitionBy(*by))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    d = d.withColumn("n", n).withColumn("t", ties).withColumn("r", F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.col("t") - 1) / 2)
    g = d.groupBy(*by, "__g").agg(F.sum("r").alias("s"), F.count("*").alias("k"), F.first("n").alias("n"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("tie"))
    h = 12 / (F.first("n") * (F.first("n") + 1)) * F.sum(F.col("s") * F.col("s") / F.col("k")) - 3 * (F.first("n") + 1)
    correction = 1 - F.sum("tie") / (F.pow(F.first("n"), F.lit(3)) - F.first("n"))
    return g.groupBy(*by).agg(F.try_divide(h, correction).alias("h_stat"), (F.count("*") - 1).alias("df"), F.first("n").alias("n")).where(F.col("n") >= least)
