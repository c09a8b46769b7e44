"""Changes of frequency, calendars and filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import period

#: Variables whose quarter is its last month's value.
LAST = ("urate", "short_rate")


def monthly_to_quarterly(panel: DataFrame, last: tuple[str, ...] = LAST, whole: bool = False) -> DataFrame:
    """Quarterly means of monthly values, or the last value of rates; with ``whole`` null in a series' quarters without any."""
    known = panel.where("value is not null").withColumn("q", period(F.col("date"), "quarter"))
    value = F.when(F.first("variable").isin(*last), F.max_by("value", "date")).otherwise(F.avg("value"))
    q = known.groupBy("code", "variable", "q").agg(value.alias("value")).select("code", F.col("q").alias("date"), "variable", "value")
    return calendar(q, ["code", "variable"], "date", 3).join(q, ["code", "variable", "date"], "left").select("code", "date", "variable", "value") if whole else q


def complete_quarter_mean(panel: DataFrame) -> DataFrame:
    """Quarterly means of the quarters that have all three months."""
    q = period(F.col("date"), "quarter")
    return panel.where("value is not null").groupBy("code", "variable", q.alias("date")).agg(F.avg("value").alias("value"), F.count("*").alias("n")).where("n = 3").drop("n")


def calendar(df: DataFrame, by: list[str], date: str, months: int = 1) -> DataFrame:
    """Every period from a key's first to its last date."""
    step = F.expr(f"interval {months} month")
    return df.groupBy(*by).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).select(*by, F.explode(F.sequence("lo", "hi", step)).alias(date))


def period_sum(df: DataFrame, by: list[str], date: str, value: str, unit: str = "quarter") -> DataFrame:
    """Sums by period, zero in periods of the key's range that have no rows."""
    p = df.groupBy(*by, period(F.col(date), unit).alias("date")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return calendar(p, by, "date", months).join(p, [*by, "date"], "left").na.fill(0, ["total", "n"])


def forward_fill(c: str, by: list[str], order: str, limit: int = 12) -> Column:
    return F.last(c, True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-limit, 0))


def interpolate(df: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """Linear between a gap's known neighbours; gaps at the ends stay."""
    back = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    d = df.withColumn("__b", F.last(known, True).over(back)).withColumn("__a", F.first(known, True).over(ahead))
    slope = (F.col("__a.v") - F.col("__b.v")) / F.nullif(F.col("__a.p") - F.col("__b.p"), F.lit(0))
    return d.withColumn(value, F.coalesce(value, F.col("__b.v") + slope * (F.col(position) - F.col("__b.p")))).drop("__a", "__b")


#: Shares of a year's amount in its quarters.
SPREADS = {"uniform": (0.25, 0.25, 0.25, 0.25), "front_loaded": (0.4, 0.3, 0.2, 0.1)}


def annual_to_quarters(df: DataFrame, by: list[str], year: str, value: str, how: str = "uniform", first_month: int = 1) -> DataFrame:
    """A year's amount spread over its quarters; ``first_month``: of the (fiscal) year."""
    weights = F.posexplode(F.array(*[F.lit(w) for w in SPREADS[how]])).alias("q", "w")
    start = F.make_date(F.col(year), F.lit(first_month), F.lit(1))
    return df.select(*by, year, value, weights).select(*by, F.add_months(start, F.col("q") * 3).alias("date"), (F.col(value) * F.col("w")).alias("value"))


def gaps(df: DataFrame, by: list[str], date: str, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` quarters without a row, between a key's rows."""
    q = (F.year("date") * 4 + F.quarter("date")).alias("q")
    d = df.select(*by, F.col(date).alias("date")).select(*by, q).distinct()
    nxt = F.lead("q").over(Window.partitionBy(*by).orderBy("q"))
    d = d.withColumn("gap", nxt - F.col("q") - 1).where(F.col("gap") >= least)
    first = F.col("q") + 1
    as_date = lambda x: F.make_date(F.floor((x - 1) / 4).cast("int"), (((x - 1) % 4) * 3 + 1).cast("int"), F.lit(1))
    return d.select(*by, as_date(first).alias("gap_start"), as_date(F.col("q") + F.col("gap")).alias("gap_end"), "gap")
