"""Merging, filling, splicing, reshaping and checking of panels, and bitemporal slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["code", "date", "variable"]
#: Codes of country groups.
AGGREGATES = ("EA", "EA12", "EA17", "EA19", "EA20", "EU", "EU27", "EU27_2020", "EU28", "OECD", "OECDE", "OECDA", "G7", "G20", "BRICS", "WLD", "WORLD", "ADV", "EME", "LATAM", "ASIA", "AFRICA", "MENA")


#: Regimes of dates, as (label, first day, last day).
REGIMES = {
    "global": [("PreGR", "1995-01-01", "2006-12-31"), ("GR", "2007-01-01", "2009-12-31"), ("EuroDebt", "2010-01-01", "2013-12-31"), ("Inter", "2014-01-01", "2019-12-31"), ("COVID", "2020-01-01", "2021-12-31"), ("PostCOVID", "2022-01-01", "2099-12-31")],
    "us": [("PreGR", "1995-01-01", "2006-12-31"), ("GR", "2007-01-01", "2009-12-31"), ("PreCOVID", "2010-01-01", "2019-12-31"), ("COVID", "2020-01-01", "2021-12-31"), ("PostCOVID", "2022-01-01", "2099-12-31")],
    "us_political": [("Bush43", "2001-01-01", "2008-12-31"), ("Obama", "2009-01-01", "2016-12-31"), ("Trump1", "2017-01-01", "2020-12-31"), ("Biden", "2021-01-01", "2024-12-31"), ("Trump2", "2025-01-01", "2099-12-31")],
}


def is_country(code: Column) -> Column:
    """Three letters that aren't a group of countries."""
    return code.rlike("^[A-Za-z]{3}$") & ~F.upper(code).isin(*AGGREGATES)


def drop_aggregates(panel: DataFrame) -> DataFrame:
    return panel.where(is_country(F.col("code")))


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_frames(*frames: DataFrame) -> DataFrame:
    """Union of panels; of rows with equal keys that of the earliest frame stays. Null values go."""
    tagged = [f.withColumn("__rank", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    return first_by(out.where("value is not null"), KEY, "__rank").drop("__rank")


def gap_fill(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary rows, and fallback rows for keys that the primary lacks."""
    return primary.unionByName(fallback.join(primary.select(*KEY), KEY, "left_anti"))


def priority_coalesce(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join; each cell from the first frame, or from the second where that is null."""
    cols = [c for c in first.columns if c not in keys]
    a, b = first.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols]), second.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in cols])


def splice_audit(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Where two sources overlap: n, mean ratio, mean and largest gap of their values, by variable."""
    both = a.select(*keys, F.col("value").alias("va")).join(b.select(*keys, F.col("value").alias("vb")), keys)
    gap = F.abs(F.col("va") - F.col("vb"))
    return both.groupBy("variable").agg(F.count("*").alias("n"), F.avg(F.try_divide("va", "vb")).alias("mean_ratio"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def coverage_report(panel: DataFrame) -> DataFrame:
    """First and last date, rows, and share of missing periods per code and variable.

    A variable is monthly only if its name ends in ``_m``, else quarterly; the share isn't below 0.
    """
    months = F.months_between("last", "first").cast("int")
    expected = F.when(F.col("variable").endswith("_m"), months + 1).otherwise(F.floor(months / 3) + 1)
    d = panel.where("value is not null").groupBy("code", "variable").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.min_by("sa_source", "date").alias("sa_source"))
    return d.withColumn("pct_missing", F.greatest(F.lit(0.0), 1 - F.col("n") / expected))


def variable_coverage(panel: DataFrame) -> DataFrame:
    return panel.where("value is not null").groupBy("variable").agg(F.count_distinct("code").alias("n_countries"))


def sample_recipe(panel: DataFrame, variables: list[str]) -> DataFrame:
    """Rows of the codes that have all the variables."""
    has = panel.where(F.col("variable").isin(*variables) & F.col("value").isNotNull()).groupBy("code").agg(F.count_distinct("variable").alias("k")).where(F.col("k") == len(set(variables)))
    return panel.where(F.col("variable").isin(*variables)).join(has, "code", "left_semi")


def check_panel(panel: DataFrame) -> dict[str, int]:
    """Raises on duplicate keys or on country groups; returns the counts that were looked at."""
    counts = {"duplicates": panel.groupBy(*KEY).count().where("count > 1").count(), "aggregates": panel.where(F.upper("code").isin(*AGGREGATES)).count()}
    if any(counts.values()):
        raise ValueError(f"the panel isn't clean: {counts}")
    return counts


def long_to_wide(panel: DataFrame, variables: list[str]) -> DataFrame:
    """One column per variable, the mean where a key repeats."""
    return panel.groupBy("code", "date").pivot("variable", variables).agg(F.avg("value"))


def wide_to_long(wide: DataFrame, variables: list[str]) -> DataFrame:
    return wide.unpivot(["code", "date"], variables, "variable", "value").where("value is not null")


def as_of(vintages: DataFrame, when: Column | str) -> DataFrame:
    """Each observation's latest value among vintages not after ``when``."""
    seen = vintages.where((F.col("vintage_date") <= when) & F.col("value").isNotNull())
    return seen.groupBy("series_id", "observation_date").agg(F.max_by("value", "vintage_date").alias("value"), F.max("vintage_date").alias("vintage_date"))


def align_vintages(vintages: DataFrame, dates: list[str]) -> DataFrame:
    """as_of for each of a few dates, which the rows are dealt out to in one pass."""
    asked = F.explode(F.filter(F.array(*[F.lit(d).cast("date") for d in dates]), lambda d: d >= F.col("vintage_date"))).alias("as_of")
    return vintages.where("value is not null").select("*", asked).groupBy("series_id", "observation_date", "as_of").agg(F.max_by("value", "vintage_date").alias("value"))


def vintage_coverage(vintages: DataFrame) -> DataFrame:
    return vintages.groupBy("series_id").agg(F.count("*").alias("n"), F.min("vintage_date").alias("first_vintage"), F.max("vintage_date").alias("last_vintage"), F.count_distinct("observation_date").alias("n_observations"), F.count_distinct("vintage_date").alias("n_vintages"))


def revisions(vintages: DataFrame) -> DataFrame:
    """First and latest value of each observation, and their difference."""
    d = vintages.where("value is not null").groupBy("series_id", "observation_date").agg(F.min_by("value", "vintage_date").alias("first_value"), F.max_by("value", "vintage_date").alias("last_value"), F.count("*").alias("n"))
    return d.withColumn("revision", F.col("last_value") - F.col("first_value"))


def regime(date: Column, spans: list[tuple[str, str, str]], default: str = "OTHER") -> Column:
    """Label of the first span [start, end] that holds the date, as an expression; a join isn't needed."""
    out = F.lit(default)
    for label, start, end in reversed(spans):
        out = F.when(date.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(label)).otherwise(out)
    return out


def break_regime(t: Column, breaks: list[int]) -> Column:
    """Number of breaks at or before t."""
    return sum((F.when(t >= b, 1).otherwise(0) for b in breaks), F.lit(0))


def dummies(c: Column, levels: list, drop_first: bool = False, prefix: str = "regime") -> list[Column]:
    return [F.when(c == v, 1).otherwise(0).alias(f"{prefix}_{v}") for v in levels[int(drop_first) :]]


def nearest_on(left: DataFrame, right: DataFrame, by: str, date: str, value: str) -> DataFrame:
    """Each left row's value of the right row nearest in time within ``by``; of two as near, the earlier.

    Both sides are put on one time line per key, and the last and next known values are carried.
    """
    both = left.withColumn("__left", F.lit(True)).unionByName(right.select(by, date, value).withColumn("__left", F.lit(False)), allowMissingColumns=True)
    known = F.when(~F.col("__left"), F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    back = Window.partitionBy(by).orderBy(date, "__left").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.col(date).desc(), F.col("__left").asc()).rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("__b", F.last(known, True).over(back)).withColumn("__a", F.last(known, True).over(ahead)).where("__left")
    later = F.col("__b").isNull() | (F.datediff("__a.d", date) < F.datediff(date, "__b.d"))
    return d.withColumn(value, F.when(later & F.col("__a").isNotNull(), F.col("__a.v")).otherwise(F.col("__b.v"))).drop("__left", "__a", "__b")
