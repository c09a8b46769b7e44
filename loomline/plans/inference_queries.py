"""Queries over the driver's tables that apply instruments, dependence tests, unit roots and cointegration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cointegration as K
from ..operators import iv as I
from ..operators import series as T
from ..sources import panel as src
from .estimator_queries import LOGS, REGION, REGIONS, logs, rounded, system
from .panel_queries import daily
from .partial_sql import Z, partialled, result

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


IV = f"{LOGS}, v AS (SELECT code, date, y, x, ln(exp(x) + 10 * (month(date) % 3)) AS z FROM s)"


def _iv(spark, d):
    return logs(src.trade_wide(spark, d)).withColumn("z", F.log(F.exp("x") + 10 * (F.month("date") % 3)))


@query(f"""WITH {IV}, m AS (SELECT code, covar_pop(z, y) / covar_pop(z, x) AS beta, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, covar_pop(z, x) / var_pop(z) AS pi, var_pop(z) AS vz, count(*) AS n FROM v GROUP BY 1),
u AS (SELECT code, beta, n, sum(power(y - my - beta * (x - mx), 2)) / any_value(n) / (any_value(n) * any_value(pi * pi * vz)) AS var FROM v JOIN m USING (code) GROUP BY code, beta, n)
SELECT code, round(beta, 5) AS beta, round(sqrt(var), 5) AS se, round(beta - {Z} * sqrt(var), 5) AS lo, round(beta + {Z} * sqrt(var), 5) AS hi, n FROM u""")
def two_stage(spark, d):
    return rounded(I.two_stage(_iv(spark, d), ["code"], "y", "x", ["z"]))


@query(f"""WITH {IV}, m AS (SELECT code, avg(x) AS mx, avg(z) AS mz, covar_pop(z, x) / var_pop(z) AS pi, count(*) AS n, sum(z * x) AS zx, sum(z * z) AS zz, sum(x * x) AS xx FROM v GROUP BY 1),
e AS (SELECT code, n, any_value(pi) AS pi, sum(power(z - mz, 2)) AS szz, sum(power((z - mz) * (x - mx - pi * (z - mz)), 2)) AS om, any_value(zx * zx / zz) AS fit, any_value(xx) AS xx FROM v JOIN m USING (code) GROUP BY code, n)
SELECT code, round(fit / ((xx - fit) / (n - 1)), 2) AS cragg_donald, round(pi * pi * szz * szz / om, 3) AS robust_f, round(pi * pi * szz * szz / om, 3) AS effective_f, n FROM e""")
def instrument_strength(spark, d):
    return I.first_stage(_iv(spark, d), ["code"], "x", ["z"]).select("code", r("cragg_donald", 2), r("robust_f", 3), r("effective_f", 3), "n")


@query(f"""WITH {IV}, g AS (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1.5 AS DOUBLE)]) AS beta0), w AS (SELECT code, beta0, z, y - beta0 * x AS w FROM v, g)
SELECT code, beta0, round((regr_syy(w, z) - (regr_syy(w, z) - power(regr_sxy(w, z), 2) / regr_sxx(w, z))) / ((regr_syy(w, z) - power(regr_sxy(w, z), 2) / regr_sxx(w, z)) / (count(*) - 2)), 4) AS f_stat FROM w GROUP BY 1, 2""")
def anderson_rubin(spark, d):
    return I.anderson_rubin(_iv(spark, d), ["code"], "y", "x", ["z"], [0.5, 1.0, 1.5]).select("code", "beta0", r("f_stat", 4))


@query()
def anderson_rubin_band(spark, d):
    tests = I.anderson_rubin(_iv(spark, d), ["code"], "y", "x", ["z"], [k / 20 for k in range(61)])
    return I.anderson_rubin_band(tests, ["code"])


@query()
def over_identification(spark, d):
    t = _iv(spark, d).withColumn("z2", (F.month("date") % 4).cast("double"))
    return I.hansen(t, ["code"], "y", "x", ["z", "z2"])


@query()
def lewbel_iv(spark, d):
    t = _iv(spark, d).withColumn("z2", (F.month("date") % 4).cast("double"))
    return rounded(I.lewbel(t, ["code"], "y", "x", ["z", "z2"]))


@query(f"""WITH {IV}, m AS (SELECT code, avg(y) AS my, avg(x) AS mx, covar_pop(x, z) / var_pop(x) AS g, avg(z) AS mz FROM v GROUP BY 1) SELECT code, date, round(z - mz - g * (x - mx), 6) AS cleaned FROM v JOIN m USING (code)""")
def cleaned_instrument(spark, d):
    return I.cleaned(_iv(spark, d), ["code"], "z", ["x"]).select("code", "date", r("cleaned", 6))


def _pooled_sql(z):
    return f"""WITH {IV}, w AS (SELECT code, y - avg(y) OVER p AS y, x - avg(x) OVER p AS x, {z} - avg({z}) OVER p AS z FROM v WINDOW p AS (PARTITION BY code)), b AS (SELECT sum(z * y) / sum(z * x) AS beta, sum(z * x) AS zx, count(*) AS n FROM w),
q AS (SELECT code, beta, n, sum(z * (y - beta * x) / zx) AS q FROM w, b GROUP BY 1, 2, 3), v2 AS (SELECT any_value(beta) AS beta, any_value(n) AS n, sqrt(sum(q * q)) AS se FROM q)
SELECT round(beta, 5) AS beta, round(se, 5) AS se, round(beta / se, 3) AS t, round(beta - {Z} * se, 5) AS lo, round(beta + {Z} * se, 5) AS hi, n FROM v2"""


@query(_pooled_sql("z"))
def pooled_iv(spark, d):
    return rounded(I.pooled(_iv(spark, d), "code", "y", "x", "z"))


@query(_pooled_sql("x"))
def pooled_ols(spark, d):
    return rounded(I.pooled(_iv(spark, d), "code", "y", "x"))


@query()
def panel_lp_iv(spark, d):
    return I.panel_lp_iv(_iv(spark, d), "code", "date", "y", "x", "z", [0, 1, 2], 1)


@query()
def regime_interaction(spark, d):
    t = logs(src.trade_wide(spark, d)).withColumn("late", (F.year("date") > 1998).cast("int"))
    return I.regime_interaction(t, "code", "date", "y", "x", "late", [0, 1, 2], 1)


@query(f"""WITH {REGION}, f AS (SELECT date FROM s GROUP BY 1 HAVING count(*) = 5), k AS (SELECT s.* FROM s JOIN f USING (date)), p AS (SELECT a.code AS i, b.code AS j, corr(a.y, b.y) AS rho, count(*) AS t FROM k a JOIN k b ON a.date = b.date AND a.code < b.code GROUP BY 1, 2)
SELECT round(sqrt(2 * any_value(t) / CAST(20 AS DOUBLE)) * sum(rho), 5) AS cd_stat FROM p""")
def cross_dependence(spark, d):
    wide = system(spark, d)
    long = wide.unpivot("date", REGIONS, "code", "y")  # dates that all regions have
    return I.cross_dependence(long, "code", "date", "y").select(r("cd_stat"))


@query(f"""WITH {LOGS}, b AS (SELECT code, regr_slope(y, x) AS beta, sqrt((regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM s GROUP BY 1)
SELECT round(sum(power((beta - m) / se, 2)), 4) AS stat, count(*) - 1 AS df FROM b, (SELECT avg(beta) AS m FROM b)""")
def slope_homogeneity(spark, d):
    return I.slope_homogeneity(logs(src.trade_wide(spark, d)), "code", "y", ["x"], "x").select(r("stat", 4), "df")


_PP = f"""WITH {REGION}, a AS (SELECT code, date, lag(y) OVER w AS level, y - lag(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY code ORDER BY date)), {partialled("q", "a", ["code"], "dy", ["level"], "level")},
l AS (SELECT *, lag(u, 1) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(u, 3) OVER w AS u3 FROM q WINDOW w AS (PARTITION BY code ORDER BY date)),
g AS (SELECT code, count(*) AS n, any_value(beta) AS beta, any_value(sxx) AS sxx, sum(u * u) AS ssr, sum(u * u) / count(*) AS g0, (sum(u * u) + CAST(1.5 AS DOUBLE) * sum(u * u1) + sum(u * u2) + CAST(0.5 AS DOUBLE) * sum(u * u3)) / count(*) AS lrv FROM l GROUP BY 1)
SELECT code, round(sqrt(g0 / lrv) * beta / sqrt(ssr / (n - 2) / sxx) - CAST(0.5 AS DOUBLE) * (lrv - g0) * sqrt(n / sxx) / lrv, 5) AS pp_t, n FROM g"""


@query(_PP)
def phillips_perron(spark, d):
    return K.phillips_perron(logs(src.region_wide(spark, d)), ["code"], "date", "y", 3).select("code", r("pp_t"), "n")


@query(f"""WITH {REGION}, i AS (SELECT code, date, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY code) AS t, lag(y) OVER w AS level, y - lag(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY code ORDER BY date)),
a AS (SELECT *, lag(dy) OVER (PARTITION BY code ORDER BY date) AS l1 FROM i), b AS (SELECT code, date, dy, level, l1, CAST(k.k AS INT) AS break_at, CAST(i > k.k AS INT) AS after FROM a, (SELECT unnest(range(500)) AS k) k WHERE k.k BETWEEN CAST(floor(CAST(0.15 AS DOUBLE) * t) AS INT) AND CAST(floor((1 - CAST(0.15 AS DOUBLE)) * t) AS INT) AND l1 IS NOT NULL),
{partialled("q", "b", ["code", "break_at"], "dy", ["level", "after", "l1"], "level")}, t AS (SELECT code, break_at, any_value(n) AS n, any_value(beta) / sqrt(sum(u * u) / (any_value(n) - 4) / any_value(sxx)) AS t FROM q GROUP BY 1, 2)
SELECT code, round(min(t), 4) AS za_t, arg_min(break_at, t) AS break_at, any_value(n) AS n FROM t GROUP BY 1""")
def zivot_andrews(spark, d):
    return K.zivot_andrews(logs(src.region_wide(spark, d)), ["code"], "date", "y", 1).select("code", r("za_t", 4), "break_at", "n")


@query(f"""WITH {REGION}, a AS (SELECT code, date, y, lag(y) OVER w AS l, 1 - 7 / CAST(count(*) OVER (PARTITION BY code) AS DOUBLE) AS a FROM s WINDOW w AS (PARTITION BY code ORDER BY date)), z AS (SELECT *, CASE WHEN l IS NULL THEN 1 ELSE 1 - a END AS z, CASE WHEN l IS NULL THEN y ELSE y - a * l END AS v FROM a),
m AS (SELECT code, date, y - sum(z * v) OVER p / sum(z * z) OVER p AS y FROM z WINDOW p AS (PARTITION BY code)), e AS (SELECT code, date, lag(y) OVER w AS level, y - lag(y) OVER w AS dy FROM m WINDOW w AS (PARTITION BY code ORDER BY date)), b AS (SELECT *, lag(dy) OVER (PARTITION BY code ORDER BY date) AS l1 FROM e),
{partialled("q", "b", ["code"], "dy", ["level", "l1"], "level", constant=False)} SELECT code, t AS dfgls_t, n FROM ({result("q", ["code"], "classical", digits=6)})""")
def df_gls(spark, d):
    return K.df_gls(logs(src.region_wide(spark, d)), ["code"], "date", "y").select("code", r("dfgls_t", 4), "n")


@query(f"""WITH {REGION}, m AS (SELECT code, regr_slope(y, x) AS beta, regr_intercept(y, x) AS a FROM s GROUP BY 1), u AS (SELECT code, date, beta, y - a - beta * x AS u FROM s JOIN m USING (code)), e AS (SELECT code, date, lag(u) OVER w AS level, u - lag(u) OVER w AS dy FROM u WINDOW w AS (PARTITION BY code ORDER BY date)),
b AS (SELECT *, lag(dy, 1) OVER w AS l1, lag(dy, 2) OVER w AS l2 FROM e WINDOW w AS (PARTITION BY code ORDER BY date)), {partialled("q", "b", ["code"], "dy", ["level", "l1", "l2"], "level")}
SELECT code, round(m.beta, 5) AS beta, t AS adf_t, n FROM ({result("q", ["code"], "classical", digits=6).replace("beta, 6) AS beta", "beta, 6) AS rho")}) JOIN m USING (code)""")
def engle_granger(spark, d):
    return K.engle_granger(logs(src.region_wide(spark, d)), ["code"], "date", "y", "x", 2).select("code", r("beta"), r("adf_t", 4), "n")


@query(f"""WITH {REGION}, a AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS dx FROM s WINDOW w AS (PARTITION BY code ORDER BY date)), b AS (SELECT *, lag(dx, 2) OVER w AS a1, lag(dx, 1) OVER w AS a2, lead(dx, 1) OVER w AS a3, lead(dx, 2) OVER w AS a4 FROM a WINDOW w AS (PARTITION BY code ORDER BY date)),
{partialled("q", "b", ["code"], "y", ["x", "a1", "a2", "a3", "a4"], "x")} {result("q", ["code"], "hac", "3", 3)}""")
def dynamic_ols(spark, d):
    return rounded(K.dynamic_ols(logs(src.region_wide(spark, d)), ["code"], "date", "y", "x"))


@query()
def johansen(spark, d):
    return spark.createDataFrame(K.johansen(system(spark, d), "date", REGIONS[:3], 2))


@query()
def mean_breaks(spark, d):
    return K.bai_perron(logs(src.region_wide(spark, d)), ["code"], "date", "y", 2)


@query()
def garch_fit(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("code").orderBy("date")
    t = daily(spark, d).select("code", "date", (F.log("rv") - F.log(F.lag("rv").over(w))).alias("r"))
    return T.garch_fit(t, ["code"], "date", "r")
