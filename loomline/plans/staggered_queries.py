"""Queries over the driver's tables that apply staggered designs' errors, several cohorts, and responses by state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import did as D
from ..operators import regression as G
from ..operators import series as T
from ..operators import staggered as S
from ..sources import panel as src
from .estimator_queries import ATT, REGION, REGIONS, UNITS, logs, system, units
from .partial_sql import Z, partialled, projections, result

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
    return (F.round(c, n) + 0.0).alias(c)


def _bands(estimate: str, n: int = 3) -> str:
    return f"round({estimate}, {n}) AS {estimate}, round(se, {n}) AS se, round({estimate} - {Z} * se, {n}) AS lo, round({estimate} + {Z} * se, {n}) AS hi"


@query(f"""WITH {ATT}, a AS (SELECT t - g AS e, g, t, att, n / sum(n) OVER (PARTITION BY t - g) AS share FROM att),
p AS (SELECT e, g, t, sum(c) AS c FROM (SELECT e, g, t, share AS c FROM a UNION ALL SELECT e, g, g - 1, -share FROM a UNION ALL SELECT e, NULL, t, -share FROM a UNION ALL SELECT e, NULL, g - 1, share FROM a) GROUP BY 1, 2, 3),
v AS (SELECT unit, treat_time, time, (y - avg(y) OVER w) / count(*) OVER w AS v FROM panel WINDOW w AS (PARTITION BY treat_time, time)),
pu AS (SELECT e, unit, sum(c * v) AS psi FROM v JOIN p ON treat_time IS NOT DISTINCT FROM g AND time = t WHERE c <> 0 GROUP BY 1, 2), s AS (SELECT e, sqrt(sum(psi * psi)) AS se FROM pu GROUP BY 1),
m AS (SELECT e, sum(share * att) AS att, count(*) AS cells FROM a GROUP BY 1) SELECT e, {_bands('att')}, cells FROM m LEFT JOIN s USING (e)""")
def event_study_errors(spark, d):
    return S.event_study_inference(units(spark, d)).select("e", *[r(c, 3) for c in ("att", "se", "lo", "hi")], "cells")


def _switch_sql(hs: list[int]) -> str:
    at = lambda c, h: f"lead({c}, {h}) OVER w" if h > 0 else c if h == 0 else f"lag({c}, {-h}) OVER w"
    each = " UNION ALL ".join(f"SELECT CAST({h} AS INT) AS h, unit, time, d, lag(d) OVER w AS was, {at('y', h) if h >= 0 else 'lag(y, 1) OVER w'} - lag(y, {1 if h >= 0 else 2}) OVER w AS dy, {at('d', max(h, 0))} AS later FROM d WINDOW w AS (PARTITION BY unit ORDER BY time)" for h in [*hs, -1])
    return f"""WITH {UNITS}, d AS (SELECT unit, time, y, CAST(treat_time IS NOT NULL AND treat_time <= time AS INT) AS d FROM panel), l AS (SELECT * FROM ({each}) WHERE dy IS NOT NULL AND was = 0 AND (d = 1 OR later = 0)),
c AS (SELECT h, time, avg(dy) FILTER (d = 1) AS s, count(*) FILTER (d = 1) AS n, avg(dy) FILTER (d = 0) AS c, count(*) FILTER (d = 0) AS k FROM l GROUP BY 1, 2), m AS (SELECT h, sum((s - c) * n) / sum(n) AS did, CAST(sum(n) AS BIGINT) AS n_switchers FROM c WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY 1),
pu AS (SELECT h, unit, sum(CASE WHEN d = 1 THEN dy - c - did ELSE -(dy - c) * n / k END / n_switchers) AS psi FROM l JOIN c USING (h, time) JOIN m USING (h) WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2), e AS (SELECT h, sqrt(sum(psi * psi)) AS se FROM pu GROUP BY 1)
SELECT h, {_bands('did')}, n_switchers FROM m JOIN e USING (h)"""


@query(_switch_sql([0, 1, 2, 4]))
def switchers_by_horizon(spark, d):
    return S.switchers_by_horizon(units(spark, d), [0, 1, 2, 4]).select("h", *[r(c, 3) for c in ("did", "se", "lo", "hi")], "n_switchers")


def nations(spark, d):
    """Nations' log revenue by half-year, zero-filled; two groups of them are treated, from different dates on."""
    t = src.trade_wide(spark, d, "quarter").select(F.col("code").alias("unit"), ((F.year("date") - 1995) * 2 + F.floor((F.quarter("date") - 1) / 2)).cast("int").alias("time"), "revenue")
    t = t.groupBy("unit", "time").agg(F.sum("revenue").alias("revenue"))
    span = t.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))  # one row
    grid = t.select("unit").distinct().join(F.broadcast(span)).select("unit", F.explode(F.sequence("lo", "hi")).alias("time"))
    key = F.regexp_extract("unit", "([0-9]+)$", 1).try_cast("int") % 8
    treat = F.when(key == 1, F.lit(5)).when(key == 2, F.lit(8))
    return grid.join(t, ["unit", "time"], "left").select("unit", "time", F.log1p(F.coalesce("revenue", F.lit(0.0))).alias("y"), treat.alias("treat_time"))


@query()
def synthetic_cohorts(spark, d):
    return D.synthetic_did_cohorts(nations(spark, d))[1]


@query()
def factor_number(spark, d):
    return spark.createDataFrame(T.factor_criteria(system(spark, d), REGIONS, 4))


@query()
def constant_correlations(spark, d):
    w = Window.partitionBy("code").orderBy("date")
    g = logs(src.region_wide(spark, d)).select("code", "date", (F.col("y") - F.lag("y", 1).over(w)).alias("r"))
    paths, pairs, _ = T.ccc_garch(g.withColumn("r", F.col("r") - F.avg("r").over(Window.partitionBy("code"))), "code", "date", "r")
    return T.ccc_covariance(paths, pairs, "code", "date")


def _by_state(transition: str) -> str:
    level = transition == "smooth"
    design, xs = projections("c", [0, 1, 2, 4], 1, ("z",))
    if level:
        design = design.replace(" - lag(y) OVER w AS dy", " AS dy")
    f = "1 / (1 + exp(-5 * ({z} - CAST(0.25 AS DOUBLE))))" if level else "CASE WHEN {z} > CAST(0.25 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END"
    z = "((z - avg(z) OVER w) / stddev_pop(z) OVER w)"
    width, most = ("greatest(1, CAST(ceil(pow((h + 1) * any_value(n), CAST(2 AS DOUBLE) / 9)) AS INT))", 6) if level else ("h + 1", 5)
    parts = [partialled(f"q_{s}", "e", ["code", "h"], "dy", ["high", "low", *xs[1:]], s, keep=("date",)) for s in ("high", "low")]
    body = lambda s: result(f"q_{s}", ["code", "h"], "hac", width, most)
    if level:
        body = lambda s: result(f"q_{s}", ["code", "h"], "hac", width, most).replace("sqrt(greatest(v, 0))", f"sqrt(greatest(v, 0) * n / (n - {len(xs) + 2}))")
    out = " UNION ALL ".join(f"SELECT *, '{s}' AS state FROM ({body(s)})" for s in ("high", "low"))
    rows = " AND ".join(f"{c} IS NOT NULL" for c in ("dy", "z", *xs))
    return f"""WITH {REGION}, c AS (SELECT *, lag(y) OVER (PARTITION BY code ORDER BY date) AS z FROM s), d AS ({design}), f AS (SELECT *, {f.format(z=z)} AS f FROM d WHERE {rows} WINDOW w AS (PARTITION BY code, h)),
e AS (SELECT *, f * x AS high, (1 - f) * x AS low FROM f), {', '.join(parts)} {out}"""


def _lagged_state(spark, d):
    return logs(src.region_wide(spark, d)).withColumn("z", F.lag("y", 1).over(Window.partitionBy("code").orderBy("date")))


def _rounded(df):
    return df.select("code", "h", *[r(c, 5) for c in ("beta", "se", "lo", "hi")], r("t", 3), "n", "state")


@query(_by_state("threshold"))
def lp_threshold(spark, d):
    return _rounded(G.lp_state(_lagged_state(spark, d), ["code"], "date", "y", "x", "z", [0, 1, 2, 4], 1, transition="threshold", threshold=0.25))


@query(_by_state("smooth"))
def lp_smooth_transition(spark, d):
    return _rounded(G.lp_smooth_transition(_lagged_state(spark, d), ["code"], "date", "y", "x", "z", [0, 1, 2, 4], 1, 5.0, 0.25))
