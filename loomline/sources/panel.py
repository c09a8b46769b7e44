"""Sources and sinks of panels.

The engine's table is the long panel: code, date (period start), variable, value, sa_source, source, unique
by (code, date, variable). NaN becomes NULL where data enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PANEL = T.StructType([T.StructField(n, t) for n, t in (("code", T.StringType()), ("date", T.DateType()), ("variable", T.StringType()), ("value", T.DoubleType()), ("sa_source", T.StringType()), ("source", T.StringType()))])
VINTAGE = "series_id string, observation_date date, vintage_date date, value double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def period(date: Column, unit: str) -> Column:
    return F.to_date(F.date_trunc(unit, date))


def exact_sum(c: str | Column) -> Column:
    """Sum of amounts in hundredths, independent of the order of rows."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def trade_wide(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """code, date, revenue, orders, per nation and period."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer, nation = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("code"), period(F.col("o_orderdate"), unit).alias("date")).agg(exact_sum("o_totalprice").alias("revenue"), F.count("*").cast("double").alias("orders"))


def trade_panel(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The long panel of revenue and orders."""
    long = trade_wide(spark, sf_dir, unit).unpivot(["code", "date"], ["revenue", "orders"], "variable", "value")
    return long.select("code", "date", "variable", "value", F.lit("none").alias("sa_source"), F.lit("testdata").alias("source"))


def region_wide(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("code"), "r_name")
    return trade_wide(spark, sf_dir, unit).join(of, "code").groupBy(F.col("r_name").alias("code"), "date").agg(exact_sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VINTAGE rows: revenue per order month as known at the end of each later month of shipping."""
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    known = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(period(F.col("o_orderdate"), "month").alias("observation_date"), period(F.greatest("l_shipdate", "o_orderdate"), "month").alias("vintage_date"), "l_extendedprice")
    per = known.groupBy("observation_date", "vintage_date").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("new"))
    from pyspark.sql import Window

    so_far = Window.partitionBy("observation_date").orderBy("vintage_date").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(F.lit("revenue").alias("series_id"), "observation_date", "vintage_date", F.sum("new").over(so_far).cast("double").alias("value"))


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, text, url, metadata, magnitude of each document; the date stands in for the one it lacks."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 4000).cast("int")).alias("date"), "text", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"), F.lit(None).cast("double").alias("magnitude"))


def read_series_csv(spark: SparkSession, path: str, code: str, variable: str, date_col: str = "date", value_col: str = "value", source: str = "csv", log: bool = False) -> DataFrame:
    """A two-column CSV of one series as panel rows; '.' and blanks are missing."""
    raw = spark.read.csv(path, header=True, nullValue=".")
    value = F.nanvl(F.col(value_col).try_cast("double"), F.lit(None))
    return raw.select(F.lit(code).alias("code"), F.to_date(date_col).alias("date"), F.lit(variable).alias("variable"), (F.log(value) if log else value).alias("value"), F.lit("none").alias("sa_source"), F.lit(source).alias("source")).where("value is not null")


def read_sdmx_csv(spark: SparkSession, path: str, variable: str, source: str, area: str = "REF_AREA", period_col: str = "TIME_PERIOD", value_col: str = "OBS_VALUE") -> DataFrame:
    """An SDMX-CSV file as panel rows; periods as YYYY, YYYY-MM, YYYY-Qn or YYYY-MM-DD."""
    p = F.col(period_col)
    quarter = F.make_date(F.substring(p, 1, 4).cast("int"), F.regexp_extract(p, "Q([1-4])", 1).try_cast("int") * 3 - 2, F.lit(1))
    date = F.when(p.rlike("Q[1-4]$"), quarter).otherwise(F.try_to_date(F.rpad(p, 10, "-01-01")) if hasattr(F, "try_to_date") else F.to_date(F.rpad(p, 10, "-01-01")))
    return spark.read.csv(path, header=True).select(F.upper(area).alias("code"), date.alias("date"), F.lit(variable).alias("variable"), F.col(value_col).try_cast("double").alias("value"), F.lit("none").alias("sa_source"), F.lit(source).alias("source")).where("value is not null and date is not null")


def unpivot_vintages(wide: DataFrame, series_id: str, date_col: str = "date") -> DataFrame:
    """A table of one column per vintage (named by its date) as VINTAGE rows."""
    cols = [c for c in wide.columns if c != date_col]
    long = wide.unpivot([date_col], cols, "vintage", "value")
    return long.select(F.lit(series_id).alias("series_id"), F.to_date(date_col).alias("observation_date"), F.to_date(F.regexp_extract("vintage", r"(\d{8})$", 1), "yyyyMMdd").alias("vintage_date"), F.col("value").cast("double").alias("value")).where("value is not null")


def write_panel(panel: DataFrame, path: str, by: str = "variable") -> None:
    panel.write.mode("overwrite").partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` replacing those of equal keys: to be written over the old table."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
