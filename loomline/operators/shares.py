"""Shift-share: base-year and rolling shares, exposure, and its weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _normalise(mean: DataFrame, keys: list[str]) -> DataFrame:
    total = F.sum("emp").over(Window.partitionBy(*keys))
    return mean.withColumn("total", total).where("total > 0").withColumn("share", F.col("emp") / F.col("total")).drop("emp", "total")


def base_year_shares(panel: DataFrame, year: int) -> DataFrame:
    """geo, industry, share: of a geo's mean employment in the year's quarters, without suppressed cells."""
    d = panel.where(~F.col("suppressed") & (F.col("year") == year))
    return _normalise(d.groupBy("geo", "industry").agg(F.avg("emp").alias("emp")), ["geo"])


def rolling_shares(panel: DataFrame, window: int, lag: int, least: int = 1) -> DataFrame:
    """Shares by quarter t over quarters [t - lag - window + 1, t - lag], where the sample has them all.

    A quarter's row counts in the windows that it falls in, so geos without a row at t have shares too.
    """
    d = panel.withColumn("q", F.col("year") * 4 + F.col("qtr") - 1)
    bounds = d.agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    ends = F.explode(F.sequence(F.col("q") + lag, F.col("q") + lag + window - 1)).alias("t")
    d = d.where(~F.col("suppressed")).select("geo", "industry", "q", "emp", ends).join(F.broadcast(bounds))  # one row
    inside = d.where((F.col("t") <= F.col("hi")) & (F.col("t") - lag - window + 1 >= F.col("lo")))
    mean = inside.groupBy("geo", "industry", "t").agg(F.avg("emp").alias("emp"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return _normalise(mean, ["geo", "t"]).select("geo", "industry", F.floor(F.col("t") / 4).cast("int").alias("year"), (F.col("t") % 4 + 1).cast("int").alias("qtr"), "share")


def exposure(shares: DataFrame, betas: DataFrame, most_unmatched: float | None = 0.05) -> DataFrame:
    """geo, exposure: sum of share times its industry's beta, 0 where it has none; raises where more than
    ``most_unmatched`` of the share rows have none."""
    if most_unmatched is not None and (unmatched_share(shares, betas).first()[0] or 0) > most_unmatched:
        raise ValueError(f"more than {most_unmatched:.0%} of share rows have no coefficient")
    return shares.join(betas, "industry", "left").groupBy("geo").agg(F.sum(F.col("share") * F.coalesce("beta", F.lit(0.0))).alias("exposure"))


def unmatched_share(shares: DataFrame, betas: DataFrame) -> DataFrame:
    """One row: the fraction of share rows without a beta, which shouldn't exceed 0.05."""
    d = shares.join(betas.select("industry", "beta"), "industry", "left")
    return d.agg(F.avg(F.when(F.col("beta").isNull(), 1.0).otherwise(0.0)).alias("unmatched"))


def rotemberg_weights(shares: DataFrame, betas: DataFrame, variances: DataFrame) -> DataFrame:
    """industry, weight: beta times the sum of squared shares times the shock's variance, as a part of the total."""
    d = shares.groupBy("industry").agg(F.sum(F.col("share") * F.col("share")).alias("ss")).join(betas, "industry").join(variances, "industry")
    raw = F.col("beta") * F.col("ss") * F.col("variance")
    # one row per industry
    return d.select("industry", raw.alias("raw")).withColumn("weight", F.try_divide("raw", F.sum("raw").over(Window.partitionBy()))).select("industry", "weight")
