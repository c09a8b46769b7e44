"""Diagnostics of simulated chains, and further comparison and combination of forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf


def equal_length(draws: DataFrame, by: list[str], chain: str, order: str) -> DataFrame:
    """The chains of each group cut to the length of its shortest, as their first draws by ``order``."""
    own = Window.partitionBy(*by, chain)
    d = draws.withColumn("__place", F.row_number().over(own.orderBy(order))).withColumn("__own", F.count("*").over(own))
    return d.withColumn("__most", F.min("__own").over(Window.partitionBy(*by))).where("__place <= __most").drop("__place", "__own", "__most")


def gelman_rubin(draws: DataFrame, by: list[str], chain: str, value: str) -> DataFrame:
    """by, r_hat, within, between over chains of equal length."""
    c = draws.groupBy(*by, chain).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    g = c.groupBy(*by).agg((F.max("n") * F.var_samp("m")).alias("between"), F.avg("v").alias("within"), F.max("n").alias("n"))
    pooled = (F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between") / F.col("n")
    return g.select(*by, F.sqrt(F.try_divide(pooled, F.col("within"))).alias("r_hat"), "within", "between")


def _lagged_means(d: DataFrame, by: list[str], order: str, most: int) -> list[Column]:
    w = Window.partitionBy(*by).orderBy(order)
    return [(F.col("__c") * F.lag("__c", l).over(w)).alias(f"__p{l}") for l in range(1, most + 1)]


def long_run_variance(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, mean, lrv, n: Bartlett-weighted autocovariances, each a mean of its own products, up to int(4 (n / 100)^0.2)."""
    every = Window.partitionBy(*by)
    d = df.select(*by, order, value).withColumns({"__m": F.avg(value).over(every), "__n": F.count("*").over(every)}).withColumn("__c", F.col(value) - F.col("__m"))
    width = F.floor(4 * F.pow(F.col("__n") / 100, F.lit(0.2)))
    most = int(d.agg(F.max(width)).first()[0] or 0)
    d = d.select("*", width.alias("__w"), *_lagged_means(d, by, order, most))
    s = F.avg(F.col("__c") * F.col("__c"))
    for l in range(1, most + 1):
        s = s + F.coalesce(F.avg(F.when(F.lit(l) <= F.col("__w"), 2 * (1 - l / (F.col("__w") + 1)) * F.col(f"__p{l}"))), F.lit(0.0))
    return d.groupBy(*by).agg(F.first("__m").alias("mean"), F.greatest(s, F.lit(1e-12)).alias("lrv"), F.first("__n").alias("n"))


def geweke(draws: DataFrame, by: list[str], order: str, value: str, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """by, z: the first part's mean less the last part's, over the root of their variances."""
    w, every = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    d = draws.select(*by, order, value, F.row_number().over(w).alias("__i"), F.count("*").over(every).alias("__n"))
    size = lambda share: F.greatest(F.lit(2), F.floor(share * F.col("__n")))
    ends = [d.where(F.col("__i") <= size(first)).withColumn("end", F.lit(0)), d.where(F.col("__i") > F.col("__n") - size(last)).withColumn("end", F.lit(1))]
    v = long_run_variance(ends[0].unionByName(ends[1]), [*by, "end"], order, value)
    pick = lambda e, x: F.sum(F.when(F.col("end") == e, x))
    part = F.col("lrv") / F.col("n")
    return v.groupBy(*by).agg(((pick(0, F.col("mean")) - pick(1, F.col("mean"))) / F.sqrt(pick(0, part) + pick(1, part))).alias("z"))


def effective_size(draws: DataFrame, by: list[str], order: str, value: str, max_lag: int = 100) -> DataFrame:
    """by, ess, n: draws over 1 + 2 times the autocorrelations' sums by pairs of lags, up to the first negative pair.

    Autocorrelations come from one join of draws with those up to ``max_lag`` later.
    """
    w, every = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    d = draws.select(*by, F.row_number().over(w).alias("i"), (F.col(value) - F.avg(value).over(every)).alias("c"))
    total = d.groupBy(*by).agg(F.avg(F.col("c") * F.col("c")).alias("v"), F.count("*").alias("n"))
    ahead = d.select(*by, F.col("c").alias("c0"), F.posexplode(F.sequence(F.col("i") + 1, F.col("i") + max_lag)).alias("k", "i"))
    rho = ahead.join(d, [*by, "i"]).groupBy(*by, "k").agg(F.avg(F.col("c0") * F.col("c")).alias("g")).join(total, by)
    rho = rho.select(*by, F.floor(F.col("k") / 2).alias("pair"), F.try_divide("g", "v").alias("r"))
    pairs = rho.groupBy(*by, "pair").agg(F.sum("r").alias("s"), F.count("*").alias("both")).where("both = 2")
    ended = F.max(F.when(F.col("s") < 0, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("pair"))
    tau = pairs.withColumn("ended", ended).where("ended = 0").groupBy(*by).agg(F.sum("s").alias("s"))
    return total.join(tau, by, "left").select(*by, (F.col("n") / (1 + 2 * F.coalesce("s", F.lit(0.0)))).alias("ess"), "n")


def giacomini_white(df: DataFrame, by: list[str], order: str, loss: str, conditions: list[str] = (), h: int = 1) -> DataFrame:
    """by, stat, p_value, df, n: the Wald statistic that a loss difference can't be foreseen from 1 and the conditions."""
    m = len(conditions) + 1
    hs = [F.lit(1.0), *[F.col(c).cast("double") for c in conditions]]
    w = Window.partitionBy(*by).orderBy(order)
    d = df.dropna(subset=[loss, *conditions]).select(*by, order, *[(x * F.col(loss)).alias(f"z{i}") for i, x in enumerate(hs)])
    d = d.select("*", *[F.lag(f"z{i}", l).over(w).alias(f"z{i}_{l}") for l in range(1, h) for i in range(m)])
    cells = []
    for i in range(m):
        for j in range(m):
            s = F.sum(F.col(f"z{i}") * F.col(f"z{j}"))
            for l in range(1, h):
                s = s + (1 - l / h) * F.coalesce(F.sum(F.col(f"z{i}") * F.col(f"z{j}_{l}")) + F.sum(F.col(f"z{i}_{l}") * F.col(f"z{j}")), F.lit(0.0))
            cells.append(s / F.count("*"))
    g = d.groupBy(*by).agg(F.array(*[F.avg(f"z{i}") for i in range(m)]).alias("mean"), F.array(*cells).alias("s"), F.count("*").alias("n"))

    @F.pandas_udf("struct<stat:double,p_value:double>")
    def wald(mean: pd.Series, s: pd.Series, n: pd.Series) -> pd.DataFrame:
        stats = [float(k * np.asarray(v) @ np.linalg.pinv(np.reshape(a, (m, m))) @ np.asarray(v)) for v, a, k in zip(mean, s, n, strict=True)]
        return pd.DataFrame({"stat": stats, "p_value": [float(chi2_sf(x, m)) for x in stats]})

    return g.withColumn("w", wald("mean", "s", "n")).select(*by, "w.stat", "w.p_value", F.lit(m).alias("df"), "n")


def rolling_weights(df: DataFrame, by: list[str], order: str, errors: list[str], rows: int) -> DataFrame:
    """by, order, w_inverse, w_optimal (arrays): weights by inverse squared error, and those of least variance, over the last
    ``rows`` dates up to each; equal weights at a group's first date."""
    w, k = Window.partitionBy(*by).orderBy(order), len(errors)
    recent = w.rowsBetween(-rows + 1, 0)
    inverse = F.array(*[1 / F.greatest(F.avg(F.col(e) * F.col(e)).over(recent), F.lit(1e-12)) for e in errors])
    cross = F.array(*[F.avg(F.col(a) * F.col(b)).over(recent) for a in errors for b in errors])
    d = df.dropna(subset=errors).select(*by, order, F.row_number().over(w).alias("__i"), inverse.alias("v"), cross.alias("s"))

    @F.pandas_udf("array<double>")
    def least(s: pd.Series) -> pd.Series:
        def one(x):
            u = np.linalg.solve(np.reshape(x, (k, k)) + 1e-10 * np.eye(k), np.ones(k))
            return (u / u.sum()).tolist()

        return s.map(one)

    equal = F.array(*[F.lit(1.0 / k)] * k)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return d.select(*by, order, F.when(F.col("__i") == 1, equal).otherwise(F.transform("v", lambda x: x / total)).alias("w_inverse"), F.when(F.col("__i") == 1, equal).otherwise(least("s")).alias("w_optimal"))


def mixed_frequency(low: DataFrame, high: DataFrame, by: list[str], period: str, order: str, y: str, x: str, per: int) -> DataFrame:
    """by, period, y, and x1 ... the high-frequency values of the period, the latest first; periods that have them all."""
    at = Window.partitionBy(*by, period).orderBy(F.desc(order))
    h = high.withColumn("__k", F.row_number().over(at)).groupBy(*by, period).agg(*[F.max(F.when(F.col("__k") == k, F.col(x))).alias(f"x{k}") for k in range(1, per + 1)], F.count(x).alias("__n"))
    return low.select(*by, period, y).join(h.where(F.col("__n") == per).drop("__n"), [*by, period])
