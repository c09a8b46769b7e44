"""Queries over the driver's tables that apply quantile projections, sliding estimates and the confidence set of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import bayes as B
from ..operators import confidence_set as C
from ..operators import quantile as Q
from ..operators import regression as G
from ..operators import rolling as R
from ..operators import seasonal as A
from ..operators import smoothing as M
from ..operators import svar as V
from ..sources import panel as src
from .estimator_queries import FORECASTS, REGION, REGIONS, forecasts, logs, system
from .partial_sql import partialled, projections

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


#: The best of the lines through any two rows.
_LINES = f"""WITH {REGION}, d AS (SELECT code, CAST(0 AS INT) AS h, date, x, y - lag(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY code ORDER BY date) UNION ALL SELECT code, 2, date, x, lead(y, 2) OVER w - lag(y) OVER w FROM s WINDOW w AS (PARTITION BY code ORDER BY date)),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY code, h ORDER BY date) AS i, count(*) OVER (PARTITION BY code, h) AS n FROM d WHERE dy IS NOT NULL),
lines AS (SELECT a.code, a.h, a.n, a.i, b.i AS j, (b.dy - a.dy) / (b.x - a.x) AS slope, a.dy - (b.dy - a.dy) / (b.x - a.x) * a.x AS level FROM rows_ a JOIN rows_ b ON a.code = b.code AND a.h = b.h AND a.i < b.i AND a.x <> b.x),
u AS (SELECT l.code, l.h, l.n, l.i, l.j, slope, sum(greatest(dy - level - slope * x, 0)) AS above, sum(greatest(level + slope * x - dy, 0)) AS below FROM lines l JOIN rows_ r ON l.code = r.code AND l.h = r.h GROUP BY ALL),
t AS (SELECT u.*, tau, tau * above + (1 - tau) * below AS objective FROM u, (SELECT unnest([CAST(0.25 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE)]) AS tau))
SELECT code, h, tau, round(arg_min(slope, objective), 4) AS beta, round(min(objective), 6) AS objective, any_value(n) AS n FROM t GROUP BY 1, 2, 3"""


@query(_LINES)
def quantile_projection(spark, d):
    return Q.quantile_lp(logs(src.region_wide(spark, d)), ["code"], "date", "y", "x", [0, 2], [0.25, 0.5, 0.9], 0).select("code", "h", "tau", r("beta", 4), r("objective", 6), "n")


@query()
def quantile_bands(spark, d):
    return Q.quantile_lp(logs(src.region_wide(spark, d)), ["code"], "date", "y", "x", [0, 4], [0.1, 0.5], 2, replicates=20)


_DRAW = "CAST(concat('0x', substr(md5(concat_ws(':', '{0}', '0', code, replicate, place)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


def _set_sql(models: list[str], replicates: int, alpha: float) -> str:
    """The elimination of three models written out: all three, then the two that are left."""
    mean, star = [f"l{i}" for i in range(3)], [f"s{i}" for i in range(3)]
    centre = lambda names, left: "(" + " + ".join(names[i] for i in left) + f") / {len(left)}"
    dev = lambda i, left: f"({star[i]} - {centre(star, left)} - ({mean[i]} - {centre(mean, left)}))"
    all_, pairs = [0, 1, 2], {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    steps = [f"WITH {FORECASTS}, d AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY date, a, b, c) AS taken, a, b, c FROM (SELECT code, date, {', '.join(f'{m} AS {c}' for m, c in zip(models, 'abc', strict=True))} FROM g))"]
    steps.append("n AS (SELECT code, count(*) AS n, avg(a) AS l0, avg(b) AS l1, avg(c) AS l2 FROM d GROUP BY 1)")
    steps.append(f"places AS (SELECT code, n, replicate, unnest(range(1, n + 1)) AS place FROM (SELECT code, n, unnest(range(1, {replicates + 1})) AS replicate FROM n))")
    steps.append(f"o AS (SELECT *, CASE WHEN place = 1 OR {_DRAW.format('new')} < 1 / greatest(greatest(2, round(cbrt(n))), 1) THEN {{'at_': CAST(floor({_DRAW.format('at')} * n) AS BIGINT), 'since': place}} END AS origin FROM places)")
    steps.append("p AS (SELECT code, n, replicate, place, last_value(origin IGNORE NULLS) OVER (PARTITION BY code, replicate ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM o)")
    steps.append("x AS (SELECT p.code, replicate, avg(a) AS s0, avg(b) AS s1, avg(c) AS s2 FROM p JOIN d ON d.code = p.code AND d.taken = (o.at_ + place - o.since) % n + 1 GROUP BY 1, 2)")
    steps.append("z AS (SELECT * FROM x JOIN n USING (code))")
    steps.append("sd AS (SELECT code, " + ", ".join(f"sqrt(avg(pow({dev(i, all_)}, 2))) AS sd{i}" for i in all_) + ", " + ", ".join(f"sqrt(avg(pow({dev(i, pairs[k])}, 2))) AS sd{k}_{i}" for k in all_ for i in pairs[k]) + " FROM z GROUP BY 1)")
    t = [f"({mean[i]} - {centre(mean, all_)}) / sd{i}" for i in all_]
    steps.append(f"first AS (SELECT code, l0, l1, l2, CASE WHEN {t[0]} >= {t[1]} AND {t[0]} >= {t[2]} THEN 0 WHEN {t[1]} >= {t[2]} THEN 1 ELSE 2 END AS w, greatest({', '.join(t)}) AS seen FROM n JOIN sd USING (code))")
    second = lambda k: [f"({mean[i]} - {centre(mean, pairs[k])}) / sd{k}_{i}" for i in pairs[k]]
    resampled2 = "CASE w " + " ".join(f"WHEN {k} THEN greatest({', '.join(f'{dev(i, pairs[k])} / sd{k}_{i}' for i in pairs[k])})" for k in all_) + " END"
    seen2 = "CASE w " + " ".join(f"WHEN {k} THEN greatest({', '.join(second(k))})" for k in all_) + " END"
    loser2 = "CASE w " + " ".join(f"WHEN {k} THEN CASE WHEN {second(k)[0]} >= {second(k)[1]} THEN {pairs[k][0]} ELSE {pairs[k][1]} END" for k in all_) + " END"
    steps.append(f"q AS (SELECT z.code, any_value(w) AS w, any_value(z.l0) AS l0, any_value(z.l1) AS l1, any_value(z.l2) AS l2, avg(CAST(greatest({', '.join(f'{dev(i, all_)} / sd{i}' for i in all_)}) >= seen - 1e-9 AS INT)) AS p1, avg(CAST({resampled2} >= {seen2} - 1e-9 AS INT)) AS p2, any_value({loser2}) AS w2 FROM (SELECT z.*, sd.* EXCLUDE (code), first.w, first.seen FROM z JOIN sd USING (code) JOIN first USING (code)) z GROUP BY 1)")
    rows = " UNION ALL ".join(f"SELECT code, '{m}' AS model, round(l{i}, 3) AS mean_loss, round(CASE WHEN w = {i} THEN p1 WHEN w2 = {i} THEN greatest(p1, p2) ELSE 1 END, 6) AS p_value, CAST(CASE WHEN w = {i} THEN 1 WHEN w2 = {i} THEN 2 ELSE 3 END AS INT) AS turn FROM q" for i, m in enumerate("abc"))
    return ",\n".join(steps) + f"\nSELECT *, p_value >= {alpha} AS included FROM ({rows})"


@query(_set_sql(["pow(realized - m1, 2)", "pow(realized - m2, 2)", "pow(realized - m3, 2)"], 200, 0.1))
def confidence_set(spark, d):
    f = forecasts(spark, d)
    square = lambda e: F.pow(F.col("realized") - e, F.lit(2))
    losses = f.select("code", "date", square(F.col("m1")).alias("a"), square(F.col("m2")).alias("b"), square(F.col("m3")).alias("c"))
    return C.confidence_set(losses, ["code"], "date", ["a", "b", "c"], replicates=200).select("code", "model", r("mean_loss", 3), r("p_value", 6), "turn", "included")


_W = "OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {REGION}, z AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS i, (y - avg(y) {_W.format(29)}) / stddev_pop(y) {_W.format(29)} AS zy, (x - avg(x) {_W.format(29)}) / stddev_pop(x) {_W.format(29)} AS zx, corr(y, x) {_W.format(29)} AS rho FROM s)
SELECT code, date, round((zy + sign(rho) * zx) / sqrt(2 * (1 + abs(rho))), 5) AS fci, round((1 + abs(rho)) / 2, 5) AS share FROM z WHERE i >= 30""")
def rolling_conditions(spark, d):
    return R.rolling_conditions(logs(src.region_wide(spark, d)), ["code"], "date", ["y", "x"], 30, ["y"]).select("code", "date", r("fci"), r("share"))


def _two_sql() -> str:
    c = lambda a, b: f"covar_pop({a}, {b}) {_W.format(38)}"
    names = {"v1": ("y1", "y1"), "v2": ("x1", "x1"), "c": ("y1", "x1"), "p1": ("y", "y1"), "p2": ("y", "x1"), "q1": ("x", "y1"), "q2": ("x", "x1"), "yy": ("y", "y"), "xx": ("x", "x"), "yx": ("y", "x")}
    return f"""WITH {REGION}, l AS (SELECT *, lag(y) OVER w AS y1, lag(x) OVER w AS x1, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY code ORDER BY date)),
m AS (SELECT code, date, i, {', '.join(f'{c(*v)} AS {k}' for k, v in names.items())} FROM l WHERE i > 1),
a AS (SELECT *, (v2 * p1 - c * p2) / (v1 * v2 - c * c) AS a11, (v1 * p2 - c * p1) / (v1 * v2 - c * c) AS a12, (v2 * q1 - c * q2) / (v1 * v2 - c * c) AS a21, (v1 * q2 - c * q1) / (v1 * v2 - c * c) AS a22 FROM m WHERE i >= 40),
s2 AS (SELECT code, date, a11, a12, a21, a22, yy - a11 * p1 - a12 * p2 AS s11, yx - a11 * q1 - a12 * q2 AS s12, xx - a21 * q1 - a22 * q2 AS s22 FROM a),
b AS (SELECT *, a11 * s11 + a12 * s12 AS b11, a11 * s12 + a12 * s22 AS b12, a21 * s11 + a22 * s12 AS b21, a21 * s12 + a22 * s22 AS b22 FROM s2),
n AS (SELECT code, date, (s11 * s11 + b11 * b11) / s11 AS n11, (s12 * s12 + b12 * b12) / s22 AS n12, (s12 * s12 + b21 * b21) / s11 AS n21, (s22 * s22 + b22 * b22) / s22 AS n22 FROM b)
SELECT code, date, round(50 * (n12 / (n11 + n12) + n21 / (n21 + n22)), 4) AS total, round(100 * (n21 / (n21 + n22) - n12 / (n11 + n12)), 4) AS net_y FROM n"""


@query(_two_sql())
def rolling_spillover(spark, d):
    s = R.rolling_spillover(logs(src.region_wide(spark, d)), ["code"], "date", ["y", "x"], 40, 1, 1)
    return s.select("code", "date", r("total", 4), F.round(F.col("net")[0], 4).alias("net_y"))


@query()
def rolling_spillover_regions(spark, d):
    return R.rolling_spillover(system(spark, d), [], "date", REGIONS, 48).select("date", "total", *[F.col("net")[i].alias(c) for i, c in enumerate(REGIONS)])


@query()
def seasonal_adjustment(spark, d):
    m = src.region_wide(spark, d).select("code", "date", "revenue")
    return A.x11(m, ["code"], "date", "revenue").withColumn("month", F.month("date"))


@query(f"""WITH {REGION}, w AS (SELECT code, sum(revenue) / sum(sum(revenue)) OVER () AS weight FROM region_trade GROUP BY 1), g AS (SELECT code, date, y - lag(y) OVER (PARTITION BY code ORDER BY date) AS growth FROM s),
p AS (SELECT code, date, growth * weight AS part FROM g JOIN w USING (code) WHERE growth IS NOT NULL), t AS (SELECT date, sum(part) AS whole FROM p GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w)), c AS (SELECT code AS component, covar_pop(part, whole) AS phi, count(*) AS n FROM p JOIN t USING (date) GROUP BY 1)
SELECT component, round(phi, 6) AS phi, round(phi / sum(phi) OVER (), 6) AS share, n FROM c""")
def shapley_variance(spark, d):
    m = src.region_wide(spark, d)
    total = m.agg(F.sum("revenue").alias("all"))  # one row
    weights = m.groupBy("code").agg(F.sum("revenue").alias("own")).join(F.broadcast(total)).select("code", (F.col("own") / F.col("all")).alias("weight"))
    growth = logs(m).select("code", "date", (F.col("y") - F.lag("y").over(Window.partitionBy("code").orderBy("date"))).alias("growth"))
    return M.shapley_variance(growth.join(weights, "code"), [], "date", "code", "growth", "weight").select("component", r("phi", 6), r("share", 6), "n")


@query()
def smooth_projection(spark, d):
    return M.smooth_responses(G.lp_hac(logs(src.region_wide(spark, d)), ["code"], "date", "y", "x", list(range(9)), 2), ["code"])


@query()
def minnesota_mean(spark, d):
    constant, a, _ = B.minnesota_mean(B.var_moments(system(spark, d), "date", REGIONS, 2))
    rows = [(c, k + 1, other, float(a[k, i, j])) for k in range(2) for i, c in enumerate(REGIONS) for j, other in enumerate(REGIONS)] + [(c, 0, "constant", float(constant[i])) for i, c in enumerate(REGIONS)]
    return spark.createDataFrame(rows, "equation string, lag int, term string, coefficient double")


@query()
def minnesota_bands(spark, d):
    draws = B.posterior_responses(spark, REGIONS[:2], B.minnesota_posterior(B.var_moments(system(spark, d), "date", REGIONS[:2], 2)), 500, 8)
    return V.bands(draws, ["h", "response", "shock"])


_HAC = " + ".join(f"CASE WHEN {l} <= h + 1 THEN 2 * (1 - {l} / CAST(h + 2 AS DOUBLE)) * coalesce(sum(q * q{l}), 0) ELSE 0 END" for l in range(1, 4))
_DESIGN, _XS = projections("s", [0, 1, 2], 1)


@query(f"""WITH {REGION}, d AS ({_DESIGN}), {partialled("p", "d", ["code", "h"], "dy", _XS, "x")}, l AS (SELECT *, {', '.join(f"lag(q, {l}) OVER w AS q{l}" for l in range(1, 4))} FROM p WINDOW w AS (PARTITION BY code, h ORDER BY date)),
v AS (SELECT code, h, any_value(beta) AS beta, any_value(n) AS n, sqrt(sum(q * q) + {_HAC}) AS se FROM l GROUP BY 1, 2) SELECT code, h, round(beta, 5) AS beta, round(se, 5) AS se, round(beta / se, 3) AS t, n FROM v""")
def table_function(spark, d):
    """Local projections called from SQL."""
    tables.register(spark)
    logs(src.region_wide(spark, d)).createOrReplaceTempView("loomline_regions")
    out = spark.sql("SELECT * FROM lp_hac(TABLE(SELECT * FROM loomline_regions) PARTITION BY code ORDER BY (date), 'code', 'date', 'y', 'x', 2, 1)")
    return out.select("code", "h", r("beta"), r("se"), r("t", 3), "n")
