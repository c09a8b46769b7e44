"""Readers of staged files into panels and text records: wide tables, fixed layouts, dialects, corpora."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import read_sdmx_csv, read_series_csv

#: What dialects of one exchange format call its columns.
DIALECTS = {
    "plain": {"area": "REF_AREA", "period_col": "TIME_PERIOD", "value_col": "OBS_VALUE"}, "location": {"area": "LOCATION", "period_col": "TIME", "value_col": "Value"},
    "geo": {"area": "geo", "period_col": "TIME_PERIOD", "value_col": "OBS_VALUE"}, "labour": {"area": "ref_area", "period_col": "time", "value_col": "obs_value"},
}


def as_panel(df: DataFrame, code: Column, date: Column, variable: Column, value: Column, source: str) -> DataFrame:
    """Panel rows; NaN and what isn't a number are missing and go."""
    v = value.try_cast("double")
    out = df.select(code.cast("string").alias("code"), date.alias("date"), variable.cast("string").alias("variable"), F.when(~F.isnan(v), v).alias("value"), F.lit("none").alias("sa_source"), F.lit(source).alias("source"))
    return out.where("value is not null and date is not null")


def read_sdmx(spark: SparkSession, path: str, variable: str, source: str, dialect: str = "plain", **filters: str) -> DataFrame:
    """An SDMX file of a known dialect as panel rows; ``filters`` keep rows by other columns' values."""
    names = DIALECTS[dialect]
    if not filters:
        return read_sdmx_csv(spark, path, variable, source, **names)
    raw = spark.read.csv(path, header=True)
    kept = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), filters.items(), raw)
    p = F.col(names["period_col"])
    quarter = F.make_date(F.substring(p, 1, 4).cast("int"), F.regexp_extract(p, "Q([1-4])", 1).try_cast("int") * 3 - 2, F.lit(1))
    date = F.when(p.rlike("Q[1-4]$"), quarter).otherwise(F.try_to_date(F.rpad(p, 10, "-01-01")))
    return as_panel(kept, F.upper(names["area"]), date, F.lit(variable), F.col(names["value_col"]), source)


def read_labour(spark: SparkSession, paths: dict[str, str], variables: dict[str, dict[str, str]]) -> DataFrame:
    """Labour series of several providers ({dialect: path}), each variable by its filters, the first provider that has a cell."""
    parts = [read_sdmx(spark, p, v, d, d, **f).withColumn("__rank", F.lit(k)) for k, (d, p) in enumerate(paths.items()) for v, f in variables.items()]
    every = reduce(DataFrame.unionByName, parts)
    best = F.min_by(F.struct("value", "sa_source", "source"), F.col("__rank")).alias("b")
    return every.groupBy("code", "date", "variable").agg(best).select("code", "date", "variable", "b.*")


def read_melted(spark: SparkSession, path: str, code_col: str, source: str, variable: str | None = None, variable_col: str | None = None, pattern: str = r"^[A-Za-z_]*(\d{4})$", **options) -> DataFrame:
    """A sheet with one column per year, staged as CSV, as panel rows; columns whose names don't match are keys or notes."""
    import re

    raw = spark.read.csv(path, header=True, **options)
    years = {c: m[1] for c in raw.columns if (m := re.search(pattern, c))}
    long = raw.unpivot([code_col, *([variable_col] if variable_col else [])], list(years), "__c", "__v")
    year = F.create_map(*[F.lit(x) for kv in years.items() for x in kv])[F.col("__c")]
    return as_panel(long, F.upper(code_col), F.make_date(year.cast("int"), F.lit(1), F.lit(1)), F.col(variable_col) if variable_col else F.lit(variable), F.regexp_replace("__v", ",", ""), source)


def read_industries(spark: SparkSession, path: str, source: str, code_col: str = "country", industry_col: str = "code", variable_col: str = "var", years: str = r"^_?(\d{4})$") -> DataFrame:
    """Industry accounts (a row per country, industry and variable, a column per year): code, industry, date, variable, value."""
    import re

    raw = spark.read.csv(path, header=True)
    cols = {c: m[1] for c in raw.columns if (m := re.search(years, c))}
    year = F.create_map(*[F.lit(x) for kv in cols.items() for x in kv])[F.col("__c")].cast("int")
    long = raw.unpivot([code_col, industry_col, variable_col], list(cols), "__c", "__v")
    v = F.col("__v").try_cast("double")
    return long.select(F.upper(code_col).alias("code"), F.col(industry_col).alias("industry"), F.make_date(year, F.lit(1), F.lit(1)).alias("date"), F.col(variable_col).alias("variable"), v.alias("value"), F.lit(source).alias("source")).where("value is not null")


def read_fixed(spark: SparkSession, path: str, layout: dict[str, tuple[int, int]], keep: str | None = None) -> DataFrame:
    """Lines of fixed places ({column: (first, last)}, from 1, both included) as trimmed strings, blank ones null; ``keep`` is
    what a line must match."""
    lines = spark.read.text(path)
    lines = lines.where(F.col("value").rlike(keep)) if keep else lines
    cell = lambda a, b: F.trim(F.substring("value", a, b - a + 1))
    return lines.select(*[F.when(cell(*p) != "", cell(*p)).alias(c) for c, p in layout.items()])


def guard(df: DataFrame, landmarks: dict[str, str], least: int = 1) -> DataFrame:
    """``df``, if each column has a value that matches its landmark in ``least`` rows or more; raises with what is missing."""
    missing = [c for c in landmarks if c not in df.columns]
    if not missing:
        seen = df.agg(*[F.count_if(F.col(c).cast("string").rlike(p)).alias(c) for c, p in landmarks.items()]).first()
        missing = [c for c in landmarks if (seen[c] or 0) < least]
    if missing:
        raise ValueError(f"the layout has changed: nothing matches in {', '.join(missing)}")
    return df


def read_corpus(spark: SparkSession, path: str, date_col: str = "date", text_col: str = "text", url_col: str | None = None, metadata: tuple[str, ...] = (), date_format: str | None = None) -> DataFrame:
    """A CSV of texts as records (date, text, url, metadata, magnitude); rows without a date or text go."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    meta = F.create_map(*[x for c in metadata for x in (F.lit(c), F.col(c))]) if metadata else F.create_map().cast("map<string,string>")
    url = F.col(url_col) if url_col else F.concat(F.lit("file://"), F.sha2(F.concat_ws("\0", F.col(date_col), F.col(text_col)), 256))
    d = raw.select(F.to_date(date_col, date_format).alias("date"), F.col(text_col).alias("text"), url.alias("url"), meta.alias("metadata"), F.lit(None).cast("double").alias("magnitude"))
    return d.where("date is not null and text is not null")


def read_series_map(spark: SparkSession, path_of: Callable[[str], str], series: dict[str, tuple[str, str]], code: str, source: str) -> DataFrame:
    """Several series files as one panel: {id: (variable, log or level)}."""
    parts = [read_series_csv(spark, path_of(i), code, v, source=source, log=form == "log") for i, (v, form) in series.items()]
    return reduce(DataFrame.unionByName, parts)


def load_country(panel: DataFrame, code: str, variables: list[str]) -> DataFrame:
    """date and a column per variable of one country; the filter reaches the files, as does the choice of variables."""
    d = panel.where((F.col("code") == code) & F.col("variable").isin(variables))
    return d.groupBy("date").pivot("variable", variables).agg(F.avg("value"))
