"""Queries over the driver's tables that apply the selections and measures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures as M
from ..sources import panel as src
from .panel_queries import LONG, TRADE

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def r6(c: str):
    return F.round(c, 6).alias(c)


@query(f"WITH {LONG} SELECT * FROM panel WHERE code IN ('NATION_6', 'NATION_12') OR variable = 'orders'")
def proxy_filter(spark, d):
    return M.proxy_filter(src.trade_panel(spark, d), ["NATION_6", "NATION_12"], ["orders"])


@query(f"WITH {TRADE} SELECT code, date, revenue, orders FROM trade WHERE code = 'NATION_6' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-06-01' AND revenue IS NOT NULL AND orders IS NOT NULL")
def country_slice(spark, d):
    return M.align(M.slice_country(src.trade_wide(spark, d), "NATION_6", "1997-01-01", "1998-06-01"), "revenue", "orders")


PROBS = f"{TRADE}, p AS (SELECT code, date, orders % 3 AS p0, orders % 5 AS p1, orders % 7 AS p2 FROM trade)"


@query(f"WITH {PROBS} SELECT code, date, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INT) AS regime, CAST(p1 >= 2 AS INT) AS in_one FROM p")
def likeliest_regime(spark, d):
    p = src.trade_wide(spark, d).select("code", "date", *[(F.col("orders") % k).alias(f"p{i}") for i, k in enumerate((3, 5, 7))])
    return p.select("code", "date", M.likeliest([F.col(f"p{i}") for i in range(3)]).alias("regime"), M.indicator(F.col("p1"), 2).alias("in_one"))


@query(f"WITH {TRADE} SELECT code, date, orders, orders > quantile_cont(orders, 0.75) OVER (PARTITION BY code) AS high FROM trade")
def high_volatility(spark, d):
    return M.high_volatility(src.trade_wide(spark, d).select("code", "date", "orders"), ["code"], "orders", 0.75)


@query(f"""WITH {LONG}, a AS (SELECT * FROM panel WHERE variable = 'orders' OR code < 'NATION_15'), b AS (SELECT code, date, variable, -value AS value, sa_source, 'second' AS source FROM panel)
SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (code, variable)""")
def missing_pairs(spark, d):
    p = src.trade_panel(spark, d)
    return M.fill_pairs(p.where("variable = 'orders' or code < 'NATION_15'"), p.withColumns({"value": -F.col("value"), "source": F.lit("second")}))


@query(f"""WITH {TRADE}, g AS (SELECT * FROM (VALUES ('revenue', 0), ('orders', 1)) v(outcome, i), (VALUES (1, 0), (2, 1), (4, 2)) l(lag, j), (VALUES (CAST(0.1 AS DOUBLE), 0), (CAST(0.9 AS DOUBLE), 1)) q(share, k))
SELECT CAST((i * 3 + j) * 2 + k AS INT) AS spec, outcome, CAST(lag AS INT) AS lag, share, round((SELECT quantile_cont(CASE WHEN outcome = 'revenue' THEN revenue ELSE orders END, g.share) FROM trade), 4) AS estimate FROM g""".replace("(SELECT quantile_cont(CASE WHEN outcome = 'revenue' THEN revenue ELSE orders END, g.share) FROM trade)", "CASE WHEN outcome = 'revenue' AND share < 0.5 THEN (SELECT quantile_cont(revenue, 0.1) FROM trade) WHEN outcome = 'revenue' THEN (SELECT quantile_cont(revenue, 0.9) FROM trade) WHEN share < 0.5 THEN (SELECT quantile_cont(orders, 0.1) FROM trade) ELSE (SELECT quantile_cont(orders, 0.9) FROM trade) END"))
def spec_grid(spark, d):
    specs = M.grid(spark, outcome=["revenue", "orders"], lag=[1, 2, 4], share=[0.1, 0.9])
    long = src.trade_panel(spark, d)
    estimates = long.groupBy(F.col("variable").alias("outcome")).agg(F.percentile("value", [0.1, 0.9]).alias("p"))
    return specs.join(estimates, "outcome").select("spec", "outcome", "lag", "share", F.round(F.when(F.col("share") < 0.5, F.col("p")[0]).otherwise(F.col("p")[1]), 4).alias("estimate"))


@query(f"""WITH {TRADE}, a AS (SELECT date, revenue AS a FROM trade WHERE code = 'NATION_6' AND month(date) <= 8), b AS (SELECT date, orders AS b FROM trade WHERE code = 'NATION_12' AND month(date) >= 3)
SELECT date, a, b, coalesce(b, a) AS last FROM a FULL JOIN b USING (date)""")
def aligned_series(spark, d):
    w = src.trade_wide(spark, d)
    a = w.where("code = 'NATION_6' and month(date) <= 8").select("date", F.col("revenue").alias("a"))
    b = w.where("code = 'NATION_12' and month(date) >= 3").select("date", F.col("orders").alias("b"))
    return M.aligned([a, b], "full").withColumn("last", M.last_wins([F.col("a"), F.col("b")]))


@query("""WITH e AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 20 = 0),
b AS (SELECT code, q, count(*) AS n FROM e GROUP BY 1, 2), c AS (SELECT code, CAST(unnest(generate_series(min(q), max(q), INTERVAL 3 MONTH)) AS DATE) AS q FROM b GROUP BY 1),
f AS (SELECT code, q, coalesce(n, 0) AS n FROM c LEFT JOIN b USING (code, q)), r AS (SELECT *, sum(CAST(n > 0 AS INT)) OVER (PARTITION BY code ORDER BY q) AS run FROM f),
g AS (SELECT code, run, sum(n) AS n, count(*) FILTER (n = 0) AS z FROM r GROUP BY 1, 2)
SELECT code, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(z) AS BIGINT) AS n_zero_qs, max(z) AS max_gap_q FROM g GROUP BY 1""")
def event_density(spark, d):
    o = src.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").where("o_orderkey % 20 = 0")
    e = o.join(src.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return M.event_density(e.select(F.col("c_nationkey").cast("string").alias("code"), F.col("o_orderdate").cast("date").alias("date")), ["code"])


@query(f"""WITH {TRADE}, z AS (SELECT date, (revenue - avg(revenue) OVER w) / nullif(stddev_pop(revenue) OVER w, 0) AS z FROM trade WINDOW w AS (PARTITION BY code))
SELECT date, round(avg(z), 6) AS consensus, round(stddev_pop(z), 6) AS disagreement, count(z) AS n_active FROM z GROUP BY 1 HAVING count(z) >= 3""")
def consensus_index(spark, d):
    return M.consensus(src.trade_wide(spark, d), "code", "date", "revenue", 3).select("date", r6("consensus"), r6("disagreement"), "n_active")


@query(f"""WITH {TRADE}, s AS (SELECT code, date, ln(revenue) - 2 * lag(ln(revenue), 1) OVER w + lag(ln(revenue), 2) OVER w AS d FROM trade WINDOW w AS (PARTITION BY code ORDER BY date)),
k AS (SELECT code, d, (row_number() OVER (PARTITION BY code ORDER BY date) - 1) % 12 AS k FROM s WHERE d IS NOT NULL), g AS (SELECT code, k, count(*) AS n, avg(d) AS m, var_pop(d) AS v FROM k GROUP BY 1, 2 HAVING count(*) > 1),
t AS (SELECT *, sum(n * m) OVER (PARTITION BY code) / sum(n) OVER (PARTITION BY code) AS grand FROM g), a AS (SELECT code, sum(n * power(m - grand, 2)) AS b, sum(n * v) AS w, CAST(sum(n) AS BIGINT) AS n, count(*) AS k FROM t GROUP BY 1)
SELECT code, round((b / (k - 1)) / (w / (n - k)), 5) AS f_stat, k - 1 AS df1, n - k AS df2 FROM a WHERE n >= 24 AND k > 1""")
def residual_seasonality(spark, d):
    w = src.trade_wide(spark, d).select("code", "date", F.log("revenue").alias("y"))
    return M.residual_seasonality(w, ["code"], "date", "y", 12).withColumn("f_stat", F.round("f_stat", 5))


MASS = """m AS (SELECT o_orderpriority AS grp, CAST(o_totalprice AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY x) / sum(w) OVER (PARTITION BY grp) AS cdf, sum(x * w) OVER (PARTITION BY grp ORDER BY x) / sum(x * w) OVER (PARTITION BY grp) AS share FROM m)"""


def _prices(spark, d):
    return src.table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").cast("double").alias("x"), F.lit(1.0).alias("w"))


@query(f"""WITH {MASS}, l AS (SELECT *, lag(x) OVER w AS x0, lag(cdf) OVER w AS c0 FROM c WINDOW w AS (PARTITION BY grp ORDER BY x)), q AS (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS q)
SELECT grp, q, round(CASE WHEN c0 IS NULL THEN x ELSE x0 + (x - x0) * (q - c0) / (cdf - c0) END, 4) AS value FROM l, q WHERE (c0 IS NULL AND q <= cdf) OR (q > c0 AND q <= cdf)""")
def weighted_quantiles(spark, d):
    return M.weighted_quantiles(_prices(spark, d), ["grp"], "x", "w", [0.1, 0.5, 0.99]).withColumn("value", F.round("value", 4))


@query(f"""WITH {MASS}, l AS (SELECT grp, (cdf - lag(cdf, 1, 0) OVER w) * (share + lag(share, 1, 0) OVER w) AS part FROM c WINDOW w AS (PARTITION BY grp ORDER BY x)) SELECT grp, round(1 - sum(part), 8) AS gini FROM l GROUP BY 1""")
def gini(spark, d):
    return M.gini(_prices(spark, d), ["grp"], "x", "w").withColumn("gini", F.round("gini", 8))


@query(f"WITH {TRADE} SELECT code, date, round(ln(lead(revenue) OVER w) - ln(revenue), 8) AS change FROM trade WINDOW w AS (PARTITION BY code ORDER BY date)")
def forward_log_change(spark, d):
    return src.trade_wide(spark, d).select("code", "date", F.round(M.forward_log_change("revenue", ["code"], "date"), 8).alias("change"))


RESPONSES = f"{TRADE}, i AS (SELECT code, CAST(datediff('month', DATE '1995-01-01', date) AS INT) AS h, orders - avg(orders) OVER (PARTITION BY code) AS beta FROM trade WHERE date < DATE '1997-01-01')"


def _responses(spark, d):
    from pyspark.sql import Window

    t = src.trade_wide(spark, d).where("date < date '1997-01-01'")
    h = (12 * (F.year("date") - 1995) + F.month("date") - 1).cast("int")
    return t.select("code", h.alias("h"), (F.col("orders") - F.avg("orders").over(Window.partitionBy("code"))).alias("beta"))


@query(f"WITH {RESPONSES} SELECT code, h, round(sum(beta) OVER (PARTITION BY code ORDER BY h), 6) AS cumulative FROM i")
def cumulative_response(spark, d):
    return _responses(spark, d).select("code", "h", F.round(M.cumulative("beta", ["code"]), 6).alias("cumulative"))


@query(f"""WITH {RESPONSES}, p AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(abs(beta), 9) DESC, h) AS a, row_number() OVER (PARTITION BY code ORDER BY round(beta, 9), h) AS b FROM i)
SELECT x.code, x.h AS peak_h, round(x.beta, 6) AS peak, y.h AS trough_h, round(y.beta, 6) AS trough FROM p x JOIN p y ON x.code = y.code AND x.a = 1 AND y.b = 1""")
def response_peaks(spark, d):
    i = _responses(spark, d).withColumn("beta", F.round("beta", 9))
    low = M.peaks(i, ["code"], "beta", signed=True).select("code", F.col("peak_h").alias("trough_h"), F.round("peak", 6).alias("trough"))
    return M.peaks(i, ["code"], "beta").select("code", "peak_h", r6("peak")).join(low, "code")


@query(f"WITH {TRADE} SELECT code, date, round((revenue - sum(revenue * orders) OVER w / sum(orders) OVER w) / CAST(7.1234567 AS DOUBLE), 3) AS value FROM trade WINDOW w AS (PARTITION BY date)")
def weighted_demean(spark, d):
    return src.trade_wide(spark, d).select("code", "date", F.round(M.weighted_demeaned("revenue", "orders", ["date"]) / 7.1234567, 3).alias("value"))


@query(f"""WITH {TRADE} SELECT code, date, CASE WHEN date BETWEEN DATE '1996-10-01' AND DATE '1999-01-01' THEN 'late' WHEN date BETWEEN DATE '1996-01-01' AND DATE '1997-01-01' THEN 'early' ELSE 'other' END AS regime FROM trade""")
def span_labels(spark, d):
    return src.trade_wide(spark, d).select("code", "date", M.labels_of_spans(F.col("date"), [("1996-01-01", "1997-01-01", "early"), ("1996-10-01", "1999-01-01", "late")], "other").alias("regime"))


@query("""SELECT o_orderkey, round((o_totalprice - o_totalprice * CAST(0.9 AS DOUBLE)) * day(last_day(o_orderdate)) / (day(last_day(o_orderdate)) - day(o_orderdate) + 1), 4) AS surprise,
CAST(greatest(0, 4 * (year(o_orderdate + INTERVAL 200 DAY) - year(o_orderdate)) + quarter(o_orderdate + INTERVAL 200 DAY) - quarter(o_orderdate)) AS INT) AS delay FROM orders""")
def month_scaled_surprise(spark, d):
    o, p = src.table(spark, d, "orders"), F.col("o_totalprice").cast("double")
    return o.select("o_orderkey", F.round(M.month_scaled(p * 0.9, p, F.col("o_orderdate")), 4).alias("surprise"), M.delay_quarters(F.col("o_orderdate"), F.date_add(F.col("o_orderdate").cast("date"), 200)).alias("delay"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b, CAST(0.3 AS DOUBLE) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(power(s * power(a, 1 - 1 / CAST(1.5 AS DOUBLE)) + (1 - s) * power(b, 1 - 1 / CAST(1.5 AS DOUBLE)), 1 / (1 - 1 / CAST(1.5 AS DOUBLE))), 3) AS quantity,
round(power(s * power(a, CAST(-0.5 AS DOUBLE)) + (1 - s) * power(b, CAST(-0.5 AS DOUBLE)), -2), 3) AS price, round(power(a, s) * power(b, 1 - s), 3) AS geometric FROM p""")
def power_means(spark, d):
    a, b, s = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"), F.lit(0.3)
    means = (M.power_mean(a, b, s, 1.5).alias("quantity"), M.power_mean(a, b, s, 1.5, True).alias("price"), M.power_mean(a, b, s, 1.0).alias("geometric"))
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *means).select("l_orderkey", "l_linenumber", *[F.round(c, 3).alias(c) for c in ("quantity", "price", "geometric")])


@query("SELECT page_id, sha256(url) AS key FROM pages")
def url_keys(spark, d):
    return src.table(spark, d, "pages").select("page_id", M.url_key(F.col("url")).alias("key"))


EVENTS = f"""{TRADE}, ev AS (SELECT o_orderkey AS event_id, n_name AS code, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(o_totalprice AS DOUBLE) END AS magnitude,
 CASE o_orderkey % 3 WHEN 0 THEN 'z' WHEN 1 THEN 'pct_gdp' ELSE 'other' END AS unit, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 4 < 2), df AS (SELECT code, date, orders / 10 AS deflator FROM trade WHERE month(date) IN (2, 9))"""


def _sized(spark, d):
    o = src.table(spark, d, "orders").where("o_orderkey % 4 < 2").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    j = o.join(src.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(src.table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    return j.select(k.alias("event_id"), F.col("n_name").alias("code"), F.col("o_orderdate").cast("date").alias("date"), F.when(k % 11 == 0, 0.0).otherwise(F.col("o_totalprice").cast("double")).alias("magnitude"), F.when(k % 3 == 0, "z").when(k % 3 == 1, "pct_gdp").otherwise("other").alias("unit"), ((k % 10).cast("double") / 10).alias("confidence"))


def _deflators(spark, d):
    return src.trade_wide(spark, d).where("month(date) in (2, 9)").select("code", "date", (F.col("orders") / 10).alias("deflator"))


@query(f"""WITH {EVENTS}, n AS (SELECT event_id, arg_min(deflator, struct_pack(a := abs(datediff('day', df.date, ev.date)), b := df.date)) AS deflator FROM ev JOIN df USING (code) GROUP BY 1)
SELECT event_id, ev.code, ev.date, round(CASE WHEN unit <> 'z' AND magnitude = 0 THEN 0.05 WHEN unit = 'pct_gdp' AND deflator > 0 THEN magnitude / deflator ELSE magnitude END, 6) AS magnitude,
CASE WHEN unit <> 'z' AND magnitude = 0 THEN 'stub_pct_gdp' ELSE unit END AS unit, confidence FROM ev LEFT JOIN n USING (event_id)""")
def harmonised_magnitudes(spark, d):
    return M.harmonised(_sized(spark, d), _deflators(spark, d)).withColumn("magnitude", F.round("magnitude", 6)).select("event_id", "code", "date", "magnitude", "unit", "confidence")


@query(f"""WITH {EVENTS} SELECT 'raw' AS step, count(*) AS n FROM ev UNION ALL SELECT 'sized', count(*) FROM ev WHERE unit <> 'z' UNION ALL SELECT 'harmonised', count(*) FROM ev WHERE unit <> 'z' UNION ALL SELECT 'confidence', count(*) FROM ev WHERE unit <> 'z' AND confidence >= 0.5""")
def quality_counts(spark, d):
    steps = [("sized", lambda e: e.where("unit <> 'z'")), ("harmonised", lambda e: M.harmonised(e, _deflators(spark, d)))]
    return M.quality(_sized(spark, d), steps)[1]


@query(f"""WITH {TRADE}, s AS (SELECT code, date, orders AS y, lag(orders, 1) OVER w AS a, lag(orders, 2) OVER w AS b FROM trade WINDOW w AS (PARTITION BY code ORDER BY date)), c AS (SELECT * FROM s WHERE b IS NOT NULL),
m AS (SELECT code, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM c GROUP BY 1),
k AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS p1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS p2 FROM m WHERE n >= 12), u AS (SELECT code, date, y - my - p1 * (a - ma) - p2 * (b - mb) AS u FROM c JOIN k USING (code))
SELECT code, date, round((u - avg(u) OVER w) / stddev_pop(u) OVER w, 5) AS value FROM u WINDOW w AS (PARTITION BY code)""")
def ar2_innovations(spark, d):
    return M.innovations(src.trade_wide(spark, d), ["code"], "date", "orders").withColumn("value", F.round("value", 5))


@query(f"""WITH {LONG}, p AS (SELECT * FROM panel UNION ALL SELECT 'EA', date, variable, value, sa_source, source FROM panel WHERE code = 'NATION_6' UNION ALL SELECT * FROM panel WHERE code = 'NATION_12' AND month(date) = 5)
SELECT 'repeated' AS problem, code || '/' || CAST(date AS VARCHAR) || '/' || variable AS what, count(*) AS n FROM p GROUP BY code, date, variable HAVING count(*) > 1
UNION ALL SELECT 'aggregate', code, count(*) FROM p WHERE code = 'EA' GROUP BY code UNION ALL SELECT 'coverage', v, 0 FROM (VALUES ('prices')) x(v)""")
def panel_problems(spark, d):
    p = src.trade_panel(spark, d)
    p = p.unionByName(p.where("code = 'NATION_6'").withColumn("code", F.lit("EA"))).unionByName(p.where("code = 'NATION_12' and month(date) = 5"))
    return M.validate(p, aggregates=("EA",), least={"orders": 5, "prices": 1})


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.v') AS DOUBLE) AS v FROM events""")
def json_values(spark, d):
    return src.table(spark, d, "events").select("event_id", M.json_value(F.col("props"), "k").alias("k"), M.json_value(F.col("props"), "v", "double").alias("v"))
