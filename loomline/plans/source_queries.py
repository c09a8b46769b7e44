"""Queries that write the driver's tables as the files that sources read, and read them back; catalogs and callers' functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import plugins
from ..checkpoints import shared_dir
from ..operators import events as E
from ..operators import regression as G
from ..operators import resample as R
from ..operators import text as X
from ..sources import files
from ..sources import panel as src
from ..streaming import measures
from .estimator_queries import EVENTS, LOGS, RECORDS, logs, narrative, records
from .panel_queries import EMPLOYMENT, LONG, TRADE, VINTAGES, employment

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def r(c: str, n: int = 4):
    return F.round(c, n).alias(c)


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/loomline-files/{uuid.uuid4().hex}"


def _csv(df, path: str, **options) -> str:
    df.write.options(**{"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} | options).csv(path)
    return path


def _monthly(spark, d, column: str):
    """A series of all nations; Junes are marked as missing."""
    m = src.trade_wide(spark, d).groupBy("date").agg(src.exact_sum(column).alias("value"))
    return m.select("date", F.when(F.month("date") == 6, ".").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("value"))


_ALL = f"{TRADE}, m AS (SELECT date, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(sum(CAST(orders AS DECIMAL(18,2))) AS DOUBLE) AS orders FROM trade GROUP BY 1)"
_KEPT = "'none' AS sa_source, 'csv' AS source FROM m WHERE month(date) <> 6"


@query(f"WITH {_ALL} SELECT 'ALL' AS code, date, 'revenue' AS variable, round(ln(revenue), 8) AS value, {_KEPT}")
def csv_series(spark, d):
    path = _csv(_monthly(spark, d, "revenue"), f"{_folder(spark)}/s")
    return src.read_series_csv(spark, path, "ALL", "revenue", log=True).withColumn("value", F.round("value", 8))


@query(f"WITH {_ALL} SELECT 'ALL' AS code, date, 'sales' AS variable, round(ln(revenue), 8) AS value, {_KEPT} UNION ALL SELECT 'ALL', date, 'count', orders, {_KEPT}")
def csv_series_map(spark, d):
    folder = _folder(spark)
    for name in ("revenue", "orders"):
        _csv(_monthly(spark, d, name), f"{folder}/{name}")
    p = files.read_series_map(spark, lambda i: f"{folder}/{i}", {"revenue": ("sales", "log"), "orders": ("count", "level")}, "ALL", "csv")
    return p.withColumn("value", F.round("value", 8))


_QUARTERS = f"{TRADE}, q AS (SELECT code, CAST(date_trunc('quarter', date) AS DATE) AS date, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS value FROM trade GROUP BY 1, 2)"


def _quarters(spark, d):
    q = src.trade_wide(spark, d, "quarter").select("code", "date", F.col("revenue").cast("decimal(18,2)").alias("value"))
    return q.withColumn("period", F.concat(F.year("date").cast("string"), F.lit("-Q"), F.quarter("date").cast("string")))


@query(f"WITH {_QUARTERS} SELECT code, date, 'revenue' AS variable, value, 'none' AS sa_source, 'exchange' AS source FROM q")
def sdmx_series(spark, d):
    q = _quarters(spark, d).select(F.lower("code").alias("REF_AREA"), F.col("period").alias("TIME_PERIOD"), F.col("value").alias("OBS_VALUE"))
    return files.read_sdmx(spark, _csv(q, f"{_folder(spark)}/s"), "revenue", "exchange")


@query(f"WITH {_QUARTERS}, p AS (SELECT *, code < 'NATION_2' AS first_ FROM q) SELECT code, date, 'revenue' AS variable, CASE WHEN first_ THEN value ELSE value + 1 END AS value, 'none' AS sa_source, CASE WHEN first_ THEN 'geo' ELSE 'labour' END AS source FROM p")
def labour_series(spark, d):
    """Two providers of a series: cells of the first one stand, the second one has all, of a measure among others."""
    q, folder = _quarters(spark, d), _folder(spark)
    _csv(q.where("code < 'NATION_2'").select(F.col("code").alias("geo"), F.col("period").alias("TIME_PERIOD"), F.col("value").alias("OBS_VALUE"), F.lit("A").alias("measure")), f"{folder}/geo")
    second = q.select(F.col("code").alias("ref_area"), F.col("period").alias("time"), (F.col("value") + 1).alias("obs_value"), F.lit("A").alias("measure"))
    _csv(second.union(second.withColumn("measure", F.lit("B"))), f"{folder}/labour")
    return files.read_labour(spark, {"geo": f"{folder}/geo", "labour": f"{folder}/labour"}, {"revenue": {"measure": "A"}})


@query(f"WITH {VINTAGES} SELECT 'GDP' AS series_id, observation_date, vintage_date, value FROM vintages WHERE value IS NOT NULL")
def wide_vintages(spark, d):
    """One column per vintage, named by its date, as rows again."""
    v = src.vintages(spark, d)
    named = v.select(F.col("observation_date").alias("date"), F.concat(F.lit("GDP_"), F.date_format("vintage_date", "yyyyMMdd")).alias("name"), "value")
    return src.unpivot_vintages(named.groupBy("date").pivot("name").agg(F.first("value")), "GDP")


@query(f"WITH {LONG} SELECT code, date, variable, value, sa_source, source FROM panel")
def panel_files(spark, d):
    path = f"{_folder(spark)}/panel"
    src.write_panel(src.trade_panel(spark, d), path)
    return spark.read.parquet(path).select("code", "date", "variable", "value", "sa_source", "source")


@query(f"WITH {_QUARTERS} SELECT code, CAST(count(*) AS BIGINT) AS quarters, round(sum(value), 2) AS revenue FROM q GROUP BY 1")
def report_file(spark, d):
    path = f"{_folder(spark)}/report"
    src.write_report(_quarters(spark, d).groupBy("code").agg(F.count("*").alias("quarters"), F.sum("value").alias("revenue")), path)
    return spark.read.csv(path, header=True, schema="code string, quarters long, revenue double").withColumn("revenue", F.round("revenue", 2))


def _years(df, keys):
    """A column per year, named by a letter and the year."""
    return df.groupBy(*keys).pivot("name").agg(F.first("value"))


@query(f"WITH {TRADE} SELECT code, make_date(year(date), 1, 1) AS date, 'revenue' AS variable, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS value, 'none' AS sa_source, 'book' AS source FROM trade GROUP BY 1, 2")
def melted_sheet(spark, d):
    y = src.trade_wide(spark, d).groupBy("code", F.year("date").alias("y")).agg(F.sum(F.col("revenue").cast("decimal(18,2)")).alias("v"))
    named = y.select(F.lower("code").alias("country"), F.concat(F.lit("Y"), F.col("y").cast("string")).alias("name"), F.format_number("v", 2).alias("value"))
    return files.read_melted(spark, _csv(_years(named, ["country"]), f"{_folder(spark)}/sheet"), "country", "book", "revenue")


@query(f"WITH {EMPLOYMENT} SELECT upper(geo) AS code, industry, make_date(year, 1, 1) AS date, 'EMP' AS variable, CAST(sum(CAST(emp AS DECIMAL(18,2))) AS DOUBLE) AS value, 'accounts' AS source FROM industry GROUP BY ALL")
def industry_accounts(spark, d):
    y = employment(spark, d).groupBy("geo", "industry", "year").agg(F.sum(F.col("emp").cast("decimal(18,2)")).alias("value"))
    named = y.select(F.col("geo").alias("country"), F.col("industry").alias("code"), F.lit("EMP").alias("var"), F.concat(F.lit("_"), F.col("year").cast("string")).alias("name"), "value")
    return files.read_industries(spark, _csv(_years(named, ["country", "code", "var"]), f"{_folder(spark)}/sheet"), "accounts")


@query(f"WITH {_QUARTERS} SELECT code, strftime(date, '%Y-%m-%d') AS day, printf('%.2f', value) AS value FROM q")
def fixed_layout(spark, d):
    """Lines of fixed places under a heading, as public offices have them, whose layout is checked first."""
    q, folder = _quarters(spark, d), f"{_folder(spark)}/lines"
    line = F.concat(F.rpad("code", 14, " "), F.date_format("date", "yyyy-MM-dd"), F.lpad(F.col("value").cast("string"), 20, " "))
    q.select(line.alias("line")).union(spark.range(1).select(F.lit("CODE          DAY"))).write.text(folder)
    rows = files.read_fixed(spark, folder, {"code": (1, 14), "day": (15, 24), "value": (25, 44)}, keep="^NATION_")
    return files.guard(rows, {"code": "^NATION_", "day": r"^\d{4}-\d\d-\d\d$", "value": r"^\d+\.\d\d$"})


@query(rf"""WITH {RECORDS.replace("AS url, lang", "AS url, lang, source")} SELECT date, regexp_replace(text, '\s+', ' ', 'g') AS text, url, lang, source FROM records WHERE text IS NOT NULL AND regexp_replace(text, '\s+', ' ', 'g') <> ''""")
def corpus_files(spark, d):
    """Texts with quotes and commas through files of them, their runs of white space as one space."""
    t = records(spark, d).select("date", F.regexp_replace("text", r"[\t\n\f\r ]+", " ").alias("text"), "url", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source")).where("text <> ''")
    path = _csv(t, f"{_folder(spark)}/corpus", escape='"', quoteAll=True, nullValue="\\N", emptyValue="")
    c = files.read_corpus(spark, path, url_col="url", metadata=("lang", "source"))
    known = lambda k: F.when(F.col("metadata")[k] != "\\N", F.col("metadata")[k]).alias(k)
    return c.select("date", "text", "url", known("lang"), known("source"))


@query(f"WITH {VINTAGES} SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CAST(vintage_date AS VARCHAR) AS vintage_date, CASE WHEN month(vintage_date) <= 6 THEN value + 1 ELSE value END AS value FROM vintages")
def vintage_stream(spark, d):
    """Vintages that arrive, and those of half the months again with other values, which replace the first ones."""
    v = src.vintages(spark, d).select("series_id", F.col("observation_date").cast("string").alias("observation_date"), F.col("vintage_date").cast("string").alias("vintage_date"), "value")
    folder = _folder(spark)
    for rows in (v, v.where(F.month(F.to_date("vintage_date")) <= 6).withColumn("value", F.col("value") + 1)):
        rows.write.mode("append").parquet(f"{folder}/in")
        arrivals = spark.readStream.schema(v.schema).parquet(f"{folder}/in")
        measures.upsert_vintages(arrivals, f"{folder}/out", f"{folder}/state").awaitTermination()
    return measures.latest(spark, f"{folder}/out").select("series_id", "observation_date", "vintage_date", "value")


@query(f"WITH {_ALL} SELECT date, 'large_orders' AS name, CAST(count(*) AS DOUBLE) AS value FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders WHERE o_totalprice > 200000) GROUP BY 1 UNION ALL SELECT date, 'revenue', revenue FROM m")
def catalog_series(spark, d):
    c = plugins.Catalog()
    large = lambda s: src.table(s, d, "orders").where("o_totalprice > 200000").groupBy(src.period(F.col("o_orderdate"), "month").alias("date")).agg(F.count("*").alias("value"))
    c.register("large_orders", large, kind="instrument")
    c.register("revenue", lambda s: src.trade_wide(s, d).groupBy("date").agg(src.exact_sum("revenue").alias("value")), kind="outcome")
    return c.load(spark, *c.names(kind="instrument"), "revenue")


_SLOPES = "SELECT CAST({k} AS INT) AS spec, '{choice}' AS choices, round(regr_slope(y, x), 6) AS beta, round(sqrt(sum(pow(y, 2)) / count(*) - pow(avg(y), 2) - pow(regr_slope(y, x), 2) * var_pop(x)) / sqrt(var_pop(x) * (count(*) - 2)), 6) AS se FROM s WHERE {where}"


@query(f"WITH {LOGS} " + " UNION ALL ".join(_SLOPES.format(k=k, choice=f"sample={w}", where=w) for k, w in enumerate(["year(date) < 1998", "year(date) >= 1998", "month(date) <> 12"])))
def specification_curve(spark, d):
    data = logs(src.trade_wide(spark, d))
    fit = lambda df, spec: G.ols(df.where(spec["sample"]), [], "y", ["x"], "x", "classical")
    curve = plugins.specification_curve(data, [{"sample": w} for w in ("year(date) < 1998", "year(date) >= 1998", "month(date) <> 12")], fit)
    return curve.select("spec", "choices", r("beta", 6), r("se", 6))


@query(f"""WITH {VINTAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY vintage_date ORDER BY observation_date DESC) AS i FROM vintages), f AS (SELECT series_id, vintage_date, avg(value) AS forecast FROM k WHERE i <= 3 GROUP BY 1, 2)
SELECT series_id, vintage_date, round(forecast, 4) AS forecast, round(forecast - lag(forecast) OVER (ORDER BY vintage_date), 4) AS revision FROM f""")
def forecast_revisions(spark, d):
    return plugins.forecast_revisions(src.vintages(spark, d), lambda s: s.iloc[-3:].mean()).select("series_id", "vintage_date", r("forecast"), r("revision"))


#: Every fourth event, by its subtarget, is spread over three quarters.
_ENTRIES = f"{EVENTS}, en AS (SELECT *, unnest(CASE WHEN subtarget = 'Wages' THEN [{{'d': date, 'w': CAST(0.5 AS DOUBLE)}}, {{'d': CAST(date + INTERVAL 3 MONTH AS DATE), 'w': 0.3}}, {{'d': CAST(date + INTERVAL 6 MONTH AS DATE), 'w': 0.2}}] ELSE [{{'d': date, 'w': CAST(1 AS DOUBLE)}}] END) AS e FROM ev)"


def _spread(spark, d):
    entry = lambda months, w: F.struct(F.add_months("date", months).alias("date"), F.lit(w).alias("weight"))
    profile = F.when(F.col("subtarget") == "Wages", F.array(entry(0, 0.5), entry(3, 0.3), entry(6, 0.2)))
    return narrative(spark, d).withColumn("profile", profile)


@query(f"WITH {_ENTRIES} SELECT event_id, e.d AS date, e.w AS weight FROM en")
def event_profiles(spark, d):
    return E.schedule(_spread(spark, d)).select("event_id", F.col("when").alias("date"), "weight")


@query(f"""WITH {_ENTRIES}, {TRADE}, g AS (SELECT code, CAST(date_trunc('quarter', date) AS DATE) AS date, CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS output FROM trade GROUP BY 1, 2),
q AS (SELECT code, kind, CAST(date_trunc('quarter', e.d) AS DATE) AS date, sum(CASE WHEN kind IN ('macropru', 'structural') THEN sign ELSE sign * magnitude * e.w END) AS v, arg_min(sign, (e.d, sign)) AS first_ FROM en WHERE target IN ('tax', 'both') AND confidence >= CAST(0.3 AS DOUBLE) GROUP BY 1, 2, 3),
cal AS (SELECT code, kind, CAST(unnest(generate_series(min(date), max(date), INTERVAL 3 MONTH)) AS DATE) AS date FROM q GROUP BY 1, 2)
SELECT code, kind, date, round(CASE kind WHEN 'macropru' THEN coalesce(v, 0) WHEN 'structural' THEN coalesce(first_, 0) ELSE coalesce(v, 0) / output END, 8) AS value FROM cal LEFT JOIN q USING (code, kind, date) LEFT JOIN g USING (code, date)""")
def events_over_output(spark, d):
    output = src.trade_wide(spark, d, "quarter").select("code", "date", F.col("revenue").alias("output"))
    q = E.quarterly(_spread(spark, d), "sum", 0.3, "tax")
    return E.relative_to_output(q, output).withColumn("value", F.round("value", 8) + 0.0)


@query(f"""WITH {RECORDS}, q AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, count(*) AS n_docs, avg(len(regexp_extract_all(text, '\\S+'))) AS mean_words FROM records WHERE month(date) > 3 GROUP BY 1)
SELECT date, coalesce(n_docs, 0) AS n_docs, round(mean_words, 6) AS mean_words FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 3 MONTH)) AS DATE) AS date FROM q) LEFT JOIN q USING (date)""")
def sparsity_calendar(spark, d):
    """Quarters without a record are reported too: here records of the first one are left out."""
    return X.sparsity(records(spark, d).where("month(date) > 3"), whole=True).withColumn("mean_words", F.round("mean_words", 6))


@query(f"""WITH {RECORDS}, s AS (SELECT date, len(regexp_extract_all(text, '\\S+')) AS score, CASE WHEN lang = 'en' THEN 2.5 WHEN lang IS NOT NULL THEN 0.5 END AS magnitude FROM records), q AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, sum(score * coalesce(magnitude, 1)) AS value FROM s WHERE score IS NOT NULL GROUP BY 1)
SELECT date, round(CAST(value AS DOUBLE), 4) AS value FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 3 MONTH)) AS DATE) AS date FROM q) LEFT JOIN q USING (date)""")
def index_weighted(spark, d):
    """Scores times the records' magnitudes, 1 where there is none."""
    magnitude = F.when(F.col("lang") == "en", 2.5).when(F.col("lang").isNotNull(), 0.5)
    s = records(spark, d).where("text IS NOT NULL").select("date", X.n_words(F.col("text")).alias("score"), magnitude.alias("magnitude"))
    return X.index_quarterly(s, "sum_weighted", weight="magnitude").withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"""WITH {LONG}, k AS (SELECT * FROM panel WHERE month(date) NOT IN (4, 5, 6)), q AS (SELECT code, variable, CAST(date_trunc('quarter', date) AS DATE) AS date, avg(value) AS value FROM k GROUP BY 1, 2, 3),
cal AS (SELECT code, variable, CAST(unnest(generate_series(min(date), max(date), INTERVAL 3 MONTH)) AS DATE) AS date FROM q GROUP BY 1, 2) SELECT code, date, variable, round(value, 4) AS value FROM cal LEFT JOIN q USING (code, variable, date)""")
def quarterly_calendar(spark, d):
    """Quarters without a month stay as null ones: here second quarters have none."""
    p = src.trade_panel(spark, d).where("month(date) NOT IN (4, 5, 6)")
    return R.monthly_to_quarterly(p, whole=True).withColumn("value", F.round("value", 4))
