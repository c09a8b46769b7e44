"""Queries over the driver's tables that apply systems, draws, replicates and diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains as H
from ..operators import did as D
from ..operators import regression as G
from ..operators import series as T
from ..operators import svar as V
from ..sources import panel as src
from .estimator_queries import FORECASTS, REGION, REGIONS, UNITS, forecasts, logs, rounded, system, units
from .partial_sql import partialled, result

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PAIR = REGIONS[:2]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def r(c: str, n: int = 5):
    return F.round(c, n).alias(c)


@query()
def lag_criteria(spark, d):
    return V.lag_criteria(system(spark, d), "date", PAIR, 4)


@query()
def block_exogeneity(spark, d):
    stat, p, df1, df2 = V.block_exogeneity(system(spark, d), "date", REGIONS, REGIONS[:2], 1)
    return spark.createDataFrame([(stat, p, df1, df2)], "f_stat double, p_value double, df1 int, df2 int")


@query()
def long_run_responses(spark, d):
    _, a, sigma, _ = T.var_ols(system(spark, d), "date", PAIR, 1)
    return T.tidy(spark, PAIR, np.cumsum(T.moving_average(a, 8) @ V.long_run(a, sigma), axis=0), "irf")


@query()
def sign_restricted(spark, d):
    _, a, sigma, _ = T.var_ols(system(spark, d), "date", PAIR, 1)
    return V.bands(V.rotations(spark, a, sigma, {0: [1, 1]}, 400, 8), ["h", "response"])


@query()
def news_shock(spark, d):
    _, a, sigma, _ = T.var_ols(system(spark, d), "date", PAIR, 1)
    impact = V.max_share(a, sigma, 0)
    return spark.createDataFrame([(c, float(v)) for c, v in zip(PAIR, impact, strict=True)], "column string, impact double")


@query()
def proxy_impact(spark, d):
    s = system(spark, d).withColumn("z", F.col(PAIR[0]) - F.avg(PAIR[0]).over(Window.orderBy("date").rowsBetween(-3, 0)))  # one row a date
    impact, f = V.proxy_impact(s, "date", PAIR, "z", 1)
    return spark.createDataFrame([(c, float(v), f) for c, v in zip(PAIR, impact, strict=True)], "column string, impact double, effective_f double")


@query()
def variance_identified(spark, d):
    s = system(spark, d).withColumn("late", (F.year("date") > 1998).cast("int"))
    impact, ratio = V.by_variance(s, "date", PAIR, "late", 1)
    return spark.createDataFrame([(c, j, float(impact[i, j]), float(ratio[j])) for i, c in enumerate(PAIR) for j in range(2)], "column string, shock int, impact double, variance double")


@query()
def historical_parts(spark, d):
    _, _, sigma, _ = T.var_ols(system(spark, d), "date", PAIR, 1)
    return V.history(system(spark, d), "date", PAIR, 1, np.linalg.cholesky(sigma))


@query()
def bootstrap_bands(spark, d):
    draws = V.replicates(system(spark, d), "date", PAIR, 1, lambda a, s: np.linalg.cholesky(s), 60, 6)
    return V.bands(draws, ["h", "response", "shock"], 0.10)


@query()
def joint_bands(spark, d):
    draws = V.replicates(system(spark, d), "date", PAIR, 1, lambda a, s: np.linalg.cholesky(s), 60, 6, seed=1)
    return V.joint_bands(draws.where("shock = 'AFRICA'"), ["h", "response"])


@query()
def threshold_system(spark, d):
    return V.threshold_var(system(spark, d), "date", PAIR, PAIR[0], 1, (1,))


@query()
def did_replicates(spark, d):
    return D.att_gt_inference(units(spark, d), 50)


@query(f"""WITH {UNITS}, d AS (SELECT unit, time, CAST(treat_time IS NOT NULL AND treat_time <= time AS INT) AS d, y, treat_time FROM panel), l AS (SELECT time, lag(y, 1) OVER w - lag(y, 2) OVER w AS dy, lag(d) OVER w AS was, d FROM d WINDOW w AS (PARTITION BY unit ORDER BY time)),
p AS (SELECT time, avg(dy) FILTER (d = 1) AS s, count(*) FILTER (d = 1) AS n, avg(dy) FILTER (d = 0) AS c FROM l WHERE dy IS NOT NULL AND was = 0 GROUP BY 1)
SELECT round(sum((s - c) * n) / sum(n), 3) AS did, CAST(sum(n) AS BIGINT) AS n_switchers FROM p WHERE s IS NOT NULL AND c IS NOT NULL""")
def did_placebo(spark, d):
    return D.placebo_switchers(units(spark, d)).select(r("did", 3), "n_switchers")


def _regions(spark, d):
    """Log revenue of regions by month, of months that all have; ASIA is treated from month 40 on."""
    w = src.region_wide(spark, d).select(F.col("code").alias("unit"), ((F.year("date") - 1995) * 12 + F.month("date")).cast("int").alias("time"), F.log("revenue").alias("y"))
    full = w.groupBy("time").count().where("count = 5").select("time")
    return w.join(full, "time").withColumn("treat_time", F.when(F.col("unit") == "ASIA", 40).cast("int"))


@query()
def synthetic_control(spark, d):
    return D.synthetic_control(_regions(spark, d), "ASIA", 40)[1]


@query()
def synthetic_did(spark, d):
    effect, _, _ = D.synthetic_did(_regions(spark, d), 40)
    return spark.createDataFrame([(effect,)], "effect double")


CHAINS = """c AS (SELECT event_type AS par, user_id % 4 AS chain, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS i, value FROM events)"""


def _chains(spark, d):
    w = Window.partitionBy("par", "chain").orderBy("event_id")
    e = src.table(spark, d, "events").select(F.col("event_type").alias("par"), (F.col("user_id") % 4).alias("chain"), "event_id", "value")
    return e.select("par", "chain", F.row_number().over(w).alias("i"), "value")


@query(f"""WITH {CHAINS}, k AS (SELECT *, count(*) OVER (PARTITION BY par, chain) AS own FROM c), l AS (SELECT *, min(own) OVER (PARTITION BY par) AS most FROM k), g AS (SELECT par, chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM l WHERE i <= most GROUP BY 1, 2), s AS (SELECT par, max(n) * var_samp(m) AS b, avg(v) AS w, max(n) AS n FROM g GROUP BY 1)
SELECT par, round(sqrt(((n - 1) / CAST(n AS DOUBLE) * w + b / n) / w), 6) AS r_hat, round(w, 4) AS within, round(b, 4) AS between FROM s""")
def gelman_rubin(spark, d):
    return H.gelman_rubin(H.equal_length(_chains(spark, d), ["par"], "chain", "i"), ["par"], "chain", "value").select("par", r("r_hat", 6), r("within", 4), r("between", 4))


@query(f"""WITH {CHAINS}, n AS (SELECT par, chain, i, value, count(*) OVER (PARTITION BY par, chain) AS n FROM c), e AS (SELECT *, 0 AS e FROM n WHERE i <= greatest(2, floor(CAST(0.1 AS DOUBLE) * n)) UNION ALL SELECT *, 1 FROM n WHERE i > n - greatest(2, floor(CAST(0.5 AS DOUBLE) * n))),
m AS (SELECT par, chain, e, i, value - avg(value) OVER p AS c, avg(value) OVER p AS mean, count(*) OVER p AS k FROM e WINDOW p AS (PARTITION BY par, chain, e)), l AS (SELECT *, floor(4 * power(k / CAST(100 AS DOUBLE), CAST(0.2 AS DOUBLE))) AS w, {', '.join(f'c * lag(c, {l}) OVER o AS p{l}' for l in range(1, 9))} FROM m WINDOW o AS (PARTITION BY par, chain, e ORDER BY i)),
s AS (SELECT par, chain, e, any_value(mean) AS mean, greatest(1e-12, avg(c * c) {' '.join(f'+ coalesce(avg(CASE WHEN {l} <= w THEN 2 * (1 - {l} / (w + 1)) * p{l} END), 0)' for l in range(1, 9))}) / any_value(k) AS v FROM l GROUP BY 1, 2, 3)
SELECT a.par, a.chain, round((a.mean - b.mean) / sqrt(a.v + b.v), 5) AS z FROM s a JOIN s b ON a.par = b.par AND a.chain = b.chain AND a.e = 0 AND b.e = 1""")
def geweke(spark, d):
    return H.geweke(_chains(spark, d), ["par", "chain"], "i", "value").select("par", "chain", r("z"))


@query(f"""WITH {CHAINS}, m AS (SELECT par, chain, i, value - avg(value) OVER (PARTITION BY par, chain) AS c FROM c), v AS (SELECT par, chain, avg(c * c) AS v, count(*) AS n FROM m GROUP BY 1, 2),
g AS (SELECT a.par, a.chain, b.i - a.i AS k, avg(a.c * b.c) AS g FROM m a JOIN m b ON a.par = b.par AND a.chain = b.chain AND b.i BETWEEN a.i + 1 AND a.i + 20 GROUP BY 1, 2, 3),
p AS (SELECT par, chain, (k - 1) // 2 AS p, sum(g / v) AS s, count(*) AS pair_n FROM g JOIN v USING (par, chain) GROUP BY 1, 2, 3), e AS (SELECT *, max(CAST(s < 0 AS INT)) OVER (PARTITION BY par, chain ORDER BY p) AS ended FROM p WHERE pair_n = 2), t AS (SELECT par, chain, sum(s) AS s FROM e WHERE ended = 0 GROUP BY 1, 2)
SELECT par, chain, round(n / (1 + 2 * coalesce(s, 0)), 4) AS ess, n FROM v LEFT JOIN t USING (par, chain)""")
def effective_size(spark, d):
    return H.effective_size(_chains(spark, d), ["par", "chain"], "i", "value", 20).select("par", "chain", r("ess", 4), "n")


@query(f"""WITH {FORECASTS}, e AS (SELECT code, date, power(realized - m1, 2) - power(realized - m2, 2) AS z FROM g), l AS (SELECT *, lag(z) OVER (PARTITION BY code ORDER BY date) AS z1 FROM e)
SELECT code, round(count(*) * power(avg(z), 2) / ((sum(z * z) + sum(z * z1)) / count(*)), 4) AS stat, CAST(1 AS INT) AS df, count(*) AS n FROM l GROUP BY 1""")
def giacomini_white(spark, d):
    f = forecasts(spark, d).withColumn("loss", F.pow(F.col("realized") - F.col("m1"), 2) - F.pow(F.col("realized") - F.col("m2"), 2))
    return H.giacomini_white(f, ["code"], "date", "loss", h=2).select("code", r("stat", 4), "df", "n")


@query(f"""WITH {FORECASTS}, e AS (SELECT code, date, realized - m1 AS a, realized - m2 AS b FROM g), v AS (SELECT code, date, row_number() OVER o AS i, avg(a * a) OVER w AS aa, avg(b * b) OVER w AS bb, avg(a * b) OVER w AS ab FROM e WINDOW o AS (PARTITION BY code ORDER BY date), w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT code, date, CASE WHEN i = 1 THEN 0.5 ELSE round((1 / greatest(aa, 1e-12)) / (1 / greatest(aa, 1e-12) + 1 / greatest(bb, 1e-12)), 5) END AS inverse, CASE WHEN i = 1 THEN 0.5 ELSE round((bb + 1e-10 - ab) / (aa + bb + 2e-10 - 2 * ab), 5) END AS optimal FROM v""")
def rolling_weights(spark, d):
    f = forecasts(spark, d).select("code", "date", (F.col("realized") - F.col("m1")).alias("a"), (F.col("realized") - F.col("m2")).alias("b"))
    return H.rolling_weights(f, ["code"], "date", ["a", "b"], 12).select("code", "date", F.round(F.col("w_inverse")[0], 5).alias("inverse"), F.round(F.col("w_optimal")[0], 5).alias("optimal"))


@query(f"""WITH {REGION}, h AS (SELECT code, CAST(date_trunc('quarter', date) AS DATE) AS quarter, date, x, row_number() OVER (PARTITION BY code, date_trunc('quarter', date) ORDER BY date DESC) AS k FROM s),
p AS (SELECT code, quarter, max(x) FILTER (k = 1) AS x1, max(x) FILTER (k = 2) AS x2, max(x) FILTER (k = 3) AS x3 FROM h GROUP BY 1, 2 HAVING count(x) = 3), l AS (SELECT code, CAST(date_trunc('quarter', date) AS DATE) AS quarter, avg(y) AS y FROM s GROUP BY 1, 2), j AS (SELECT * FROM l JOIN p USING (code, quarter)),
{partialled("q", "j", ["code"], "y", ["x1", "x2", "x3"], "x1", ("quarter",))} {result("q", ["code"], "hc0")}""")
def mixed_frequency(spark, d):
    m = logs(src.region_wide(spark, d)).withColumn("quarter", src.period(F.col("date"), "quarter"))
    rows = H.mixed_frequency(m.groupBy("code", "quarter").agg(F.avg("y").alias("y")), m, ["code"], "quarter", "date", "y", "x", 3)
    return rounded(G.ols(rows, ["code"], "y", ["x1", "x2", "x3"], "x1"))
