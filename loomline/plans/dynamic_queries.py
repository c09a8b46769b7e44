"""Queries over the driver's tables that apply dynamic panels, state-space models and streams with state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import shared_dir
from ..operators import dynamic_panel as P
from ..operators import state_space as S
from ..sources import panel as src
from ..streaming import measures as M
from ..streaming import ordered as O
from .estimator_queries import REGION, REGIONS, logs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def r(c: str, n: int = 5):
    return F.round(c, n).alias(c)


def buyers(spark, d):
    """Customers by year: log revenue y and log orders x, in the years that have orders."""
    o = src.table(spark, d, "orders")
    g = o.groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("t")).agg(src.exact_sum("o_totalprice").alias("revenue"), F.count("*").alias("n"))
    return g.select("unit", "t", F.log("revenue").alias("y"), F.log("n").alias("x"))


BUYERS = "p AS (SELECT o_custkey AS unit, year(o_orderdate) AS t, ln(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)) AS y FROM orders GROUP BY 1, 2)"


def _three(m: str, v: list[str]) -> list[str]:
    """The solution of a symmetric system of three, with columns m11, m12, m13, m22, m23, m33, for the right side v."""
    a, b, c, d, e, f = (f"{m}{k}" for k in ("11", "12", "13", "22", "23", "33"))
    adj = [[f"({d}*{f}-{e}*{e})", f"({c}*{e}-{b}*{f})", f"({b}*{e}-{c}*{d})"], [f"({c}*{e}-{b}*{f})", f"({a}*{f}-{c}*{c})", f"({b}*{c}-{a}*{e})"], [f"({b}*{e}-{c}*{d})", f"({b}*{c}-{a}*{e})", f"({a}*{d}-{b}*{b})"]]
    det = f"({a}*{adj[0][0]}+{b}*{adj[0][1]}+{c}*{adj[0][2]})"
    return [f"(({' + '.join(f'{adj[i][j]}*({v[j]})' for j in range(3))})/{det})" for i in range(3)]


def _dot(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"({a})*({b})" for a, b in zip(u, v, strict=True)) + ")"


def _gmm_sql(rows: str, weight: str) -> str:
    """Two-step GMM of one coefficient and three instruments: ``rows`` (unit, t, dif, y, x, z1, z2, z3), ``weight`` the first step's moments m11 ... m33."""
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    a, b, g, A, B = ([f"{n}{i}" for i in (1, 2, 3)] for n in ("a", "b", "g", "ua", "ub"))
    w1 = lambda v: _three("m", v)
    w2 = lambda v: _three("s", v)
    unit_sums = ", ".join(f"sum(z{i} * x) AS ua{i}, sum(z{i} * y) AS ub{i}" for i in (1, 2, 3))
    gbar = [f"b{i} - beta * a{i}" for i in (1, 2, 3)]
    return f"""WITH {BUYERS}, {rows},
u AS (SELECT unit, {unit_sums} FROM r GROUP BY 1),
t AS (SELECT {', '.join(f'sum(ua{i}) AS a{i}, sum(ub{i}) AS b{i}' for i in (1, 2, 3))}, count(*) AS n_units FROM u),
w AS ({weight}),
one AS (SELECT t.*, w.*, {_dot(a, w1(b))} / {_dot(a, w1(a))} AS beta1 FROM t, w),
g1 AS (SELECT {', '.join(f'ub{i} - beta1 * ua{i} AS g{i}' for i in (1, 2, 3))} FROM u, one),
s AS (SELECT {', '.join(f'sum(g{i} * g{j}) AS s{i}{j}' for i, j in pairs)} FROM g1),
two AS (SELECT one.*, s.*, {_dot(a, w2(b))} / {_dot(a, w2(a))} AS beta, 1 / {_dot(a, w2(a))} AS v2, {', '.join(f'{x} AS wa{i}' for i, x in enumerate(w1(a), 1))} FROM one, s),
three AS (SELECT *, ({' + '.join(f'wa{i} * wa{j} * s{min(i, j)}{max(i, j)}' for i in (1, 2, 3) for j in (1, 2, 3))}) / pow({_dot(a, w1(a))}, 2) AS v1, {', '.join(f'{x} AS v_{i}' for i, x in enumerate(w2(gbar), 1))}, {_dot(gbar, w2(gbar))} AS j FROM two),
g2 AS (SELECT ua1, ua2, ua3, {', '.join(f'ub{i} - beta * ua{i} AS g{i}' for i in (1, 2, 3))} FROM u, two),
o AS (SELECT {', '.join(f'sum(ua{i} * {_dot(g, ["v_1", "v_2", "v_3"])} + g{i} * {_dot(A, ["v_1", "v_2", "v_3"])}) AS o{i}' for i in (1, 2, 3))} FROM g2, three),
four AS (SELECT three.*, v2 * {_dot(a, w2(["o1", "o2", "o3"]))} AS turn FROM three, o),
e AS (SELECT unit, t, y - beta * x AS e FROM r, two WHERE dif),
ar AS (SELECT lag, sum(s) / sqrt(sum(s * s)) AS z FROM (SELECT c.lag, a.unit, sum(a.e * b.e) AS s FROM e a JOIN (SELECT unnest([1, 2]) AS lag) c ON true JOIN e b ON b.unit = a.unit AND b.t = a.t - c.lag GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT count(*) AS n_obs FROM r)
SELECT x.*, n_obs, n_units FROM (
SELECT 'L1' AS term, round(beta, 5) AS estimate, round(sqrt(v2 + 2 * turn * v2 + turn * turn * v1), 5) AS se, round(beta / sqrt(v2 + 2 * turn * v2 + turn * turn * v1), 3) AS z, CAST(NULL AS INT) AS df FROM four
UNION ALL SELECT 'hansen_j', round(j, 4), NULL, NULL, 2 FROM four UNION ALL SELECT 'ar' || lag, NULL, NULL, round(z, 3), NULL FROM ar) x, n, t"""


_LAGGED = ", ".join(f"max(y) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) AS y{k}" for k in (1, 2, 3, 4))
_DIFFERENCES = f"l AS (SELECT unit, t, y, {_LAGGED} FROM p), r AS (SELECT unit, t, true AS dif, y - y1 AS y, y1 - y2 AS x, coalesce(y2, 0) AS z1, coalesce(y3, 0) AS z2, coalesce(y4, 0) AS z3 FROM l WHERE y1 IS NOT NULL AND y2 IS NOT NULL)"
_BANDED = "SELECT " + ", ".join(f"sum(2 * z{i} * z{j} - CASE WHEN t - pt = 1 THEN z{i} * p{j} + p{i} * z{j} ELSE 0 END) AS m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j) + " FROM (SELECT *, lag(t) OVER o AS pt, lag(z1) OVER o AS p1, lag(z2) OVER o AS p2, lag(z3) OVER o AS p3 FROM r WINDOW o AS (PARTITION BY unit ORDER BY t))"
_SYSTEM = f"""l AS (SELECT unit, t, y, {_LAGGED} FROM p), r AS (SELECT unit, t, true AS dif, y - y1 AS y, y1 - y2 AS x, coalesce(y2, 0) AS z1, coalesce(y3, 0) AS z2, 0 AS z3 FROM l WHERE y1 IS NOT NULL AND y2 IS NOT NULL
UNION ALL SELECT unit, t, false, y, y1, 0, 0, y1 - y2 FROM l WHERE y1 IS NOT NULL AND y2 IS NOT NULL)"""
_PLAIN = "SELECT " + ", ".join(f"sum(z{i} * z{j}) AS m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j) + " FROM r"


def _terms(df):
    estimate = F.when(F.col("term") == "hansen_j", F.round("estimate", 4)).otherwise(F.round("estimate", 5))
    return df.select("term", estimate.alias("estimate"), r("se"), r("z", 3), "df", "n_obs", "n_units")


@query(_gmm_sql(_DIFFERENCES, _BANDED))
def panel_gmm(spark, d):
    return _terms(P.gmm(buyers(spark, d), "unit", "t", "y", window=(2, 4)))


@query(_gmm_sql(_SYSTEM, _PLAIN))
def system_gmm(spark, d):
    return _terms(P.gmm(buyers(spark, d), "unit", "t", "y", window=(2, 3), system=True))


@query()
def panel_gmm_by_date(spark, d):
    return P.gmm(buyers(spark, d), "unit", "t", "y", pred=("x",), window=(2, 3), collapse=False)


#: Regions' log revenue by month, without the Junes: a random walk with noise, its start unknown.
LEVEL = S.Model([[1.0]], [[1.0]], [[0.02]], [[0.1]], diffuse=(0,))
_MISSING = f"{REGION}, m AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS i, CASE WHEN month(date) = 6 THEN NULL ELSE y END AS y FROM s)"
_FILTER = f"""RECURSIVE {_MISSING}, f AS (
  SELECT code, date, i, y, coalesce(y, 0) AS a, CAST(CASE WHEN y IS NULL THEN 0 ELSE 0.1 END AS DOUBLE) AS p, y IS NULL AS open_, CAST(CASE WHEN y IS NULL THEN 0 ELSE -0.5 * ln(2 * pi()) END AS DOUBLE) AS ll FROM m WHERE i = 1
  UNION ALL
  SELECT m.code, m.date, m.i, m.y, CASE WHEN m.y IS NULL THEN f.a WHEN open_ THEN m.y ELSE f.a + (p + 0.02) / (p + CAST(0.12 AS DOUBLE)) * (m.y - f.a) END,
         CAST(CASE WHEN m.y IS NULL THEN p + 0.02 WHEN open_ THEN 0.1 ELSE (p + 0.02) * 0.1 / (p + 0.12) END AS DOUBLE), open_ AND m.y IS NULL,
         CAST(CASE WHEN m.y IS NULL THEN 0 WHEN open_ THEN -0.5 * ln(2 * pi()) ELSE -0.5 * (ln(2 * pi() * (p + 0.12)) + pow(m.y - f.a, 2) / (p + 0.12)) END AS DOUBLE)
  FROM f JOIN m ON m.code = f.code AND m.i = f.i + 1)"""


def _level(spark, d):
    m = logs(src.region_wide(spark, d)).select("code", "date", F.when(F.month("date") != 6, F.col("y")).alias("y"))
    return S.kalman_filter(m, ["code"], "date", ["y"], LEVEL)


@query(f"WITH {_FILTER} SELECT code, date, round(a, 5) AS level, round(p, 6) AS variance, round(ll, 5) AS loglik FROM f")
def kalman_level(spark, d):
    return _level(spark, d).select("code", "date", F.round(F.col("mean")[0], 5).alias("level"), F.round(F.col("cov")[0], 6).alias("variance"), r("loglik"))


@query(f"""WITH {_FILTER}, last AS (SELECT code, max(i) AS i FROM f GROUP BY 1), b AS (
  SELECT f.code, date, f.i, a, p FROM f JOIN last ON last.code = f.code AND last.i = f.i
  UNION ALL
  SELECT f.code, f.date, f.i, f.a + f.p / (f.p + 0.02) * (b.a - f.a), CAST(f.p + pow(f.p / (f.p + 0.02), 2) * (b.p - f.p - 0.02) AS DOUBLE) FROM b JOIN f ON f.code = b.code AND f.i = b.i - 1)
SELECT code, date, round(a, 5) AS level, round(p, 6) AS variance FROM b""")
def kalman_smooth(spark, d):
    s = S.kalman_smoother(_level(spark, d), ["code"], "date", LEVEL)
    return s.select("code", "date", F.round(F.col("smoothed_mean")[0], 5).alias("level"), F.round(F.col("smoothed_cov")[0], 6).alias("variance"))


def _ragged(spark, d):
    """Regions' log revenue side by side; the later regions by name lack the last months."""
    m = logs(src.region_wide(spark, d)).groupBy("date").pivot("code", REGIONS).agg(F.first("y"))
    end = m.agg(F.max("date").alias("end"))  # one row
    return m.join(F.broadcast(end)).select("date", *[F.when(F.col("date") <= F.add_months("end", -i), F.col(c)).alias(c) for i, c in enumerate(REGIONS)])


@query()
def dynamic_factor(spark, d):
    m = _ragged(spark, d)
    fit = S.fit_factors(m, "date", REGIONS, 1, 2)
    return S.nowcast(m, "date", REGIONS, fit).select("date", F.col("factors")[0].alias("factor"), *REGIONS)


def _stream(spark, d, name: str):
    """A table read as a stream; a watermark needs times with a zone, the session's here."""
    t = src.table(spark, d, name)
    s = spark.readStream.schema(t.schema).parquet(f"{d}/{name}.parque[t]")  # a pattern may match one file, a plain path must be a folder
    return s.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in t.dtypes])


def _plain_time(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _run(spark, stream, mode: str = "append"):
    """What a stream gives when it has read all there is and stopped."""
    folder = f"{shared_dir(spark)}/loomline-streams/{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", O.PROVIDER)
    try:
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


#: Events that the watermark has passed when a stream that is two days behind ends.
_PASSED = "passed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events WHERE ts < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events))"


@query(f"""WITH RECURSIVE {_PASSED}, g AS (SELECT user_id, ts, i, value, CAST(2.371 AS DOUBLE) / (1 - CAST(0.1013 AS DOUBLE) - CAST(0.7931 AS DOUBLE)) AS s FROM passed WHERE i = 1
UNION ALL SELECT p.user_id, p.ts, p.i, p.value, CAST(2.371 AS DOUBLE) + CAST(0.1013 AS DOUBLE) * pow(g.value - 20, 2) + CAST(0.7931 AS DOUBLE) * g.s FROM g JOIN passed p ON p.user_id = g.user_id AND p.i = g.i + 1)
SELECT user_id, ts, round(value - 20, 4) AS r, round(s, 4) AS sigma2 FROM g""")
def garch_stream(spark, d):
    e = _stream(spark, d, "events").withColumn("r", F.col("value") - 20)
    return _run(spark, O.garch(e, ["user_id"], "ts", "r", 2.371, 0.1013, 0.7931, "2 days")).select("user_id", _plain_time("ts"), r("r", 4), r("sigma2", 4))


@query(f"""WITH RECURSIVE {_PASSED}, f AS (SELECT user_id, ts, i, value AS a, CAST(100 AS DOUBLE) AS p FROM passed WHERE i = 1
UNION ALL SELECT m.user_id, m.ts, m.i, f.a + (p + 4) / (p + 104) * (m.value - f.a), (p + 4) * 100 / (p + 104) FROM f JOIN passed m ON m.user_id = f.user_id AND m.i = f.i + 1)
SELECT user_id, ts, round(a, 4) AS level, round(p, 4) AS variance FROM f""")
def kalman_stream(spark, d):
    model = S.Model([[1.0]], [[1.0]], [[4.0]], [[100.0]], diffuse=(0,))
    s = _run(spark, O.kalman(_stream(spark, d, "events"), ["user_id"], "ts", ["value"], model, "2 days"))
    return s.select("user_id", _plain_time("ts"), F.round(F.col("mean")[0], 4).alias("level"), F.round(F.col("cov")[0], 4).alias("variance"))


_WATERMARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL {late} FROM events)"


@query(f"SELECT CAST(date_trunc('day', ts) AS DATE) AS day, user_id, round(sum(value * value), 4) AS rv, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_WATERMARK.format(late='1 HOUR')} GROUP BY 1, 2")
def variance_stream(spark, d):
    e = _stream(spark, d, "events").select("ts", "user_id", F.col("value").alias("r"))
    return _run(spark, M.daily_variance(e, "user_id")).select("day", "user_id", r("rv", 4), "n")


@query(f"""SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type AS source, count(*) AS n_total, count(*) FILTER (user_id % 3 > 0) AS n_success, count(*) FILTER (user_id % 5 = 0) AS n_fallback
FROM events WHERE time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY <= {_WATERMARK.format(late='1 DAY')} GROUP BY 1, 2""")
def health_stream(spark, d):
    e = _stream(spark, d, "events").select("ts", F.col("event_type").alias("source"), F.when(F.col("user_id") % 3 > 0, "success").otherwise("error").alias("outcome"), F.when(F.col("user_id") % 5 == 0, "cache").otherwise("live").alias("fallback_used"))
    return _run(spark, M.health(e)).withColumn("start", _plain_time("start"))
