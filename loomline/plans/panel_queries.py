"""Queries over the driver's tables that apply the panel operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import resample as R
from ..operators import shares as S
from ..operators import windows as W
from ..sources import panel as src

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TRADE = """trade AS (
  SELECT n_name AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(count(*) AS DOUBLE) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
LONG = TRADE + """, panel AS (
  SELECT code, date, 'revenue' AS variable, revenue AS value, 'none' AS sa_source, 'testdata' AS source FROM trade
  UNION ALL SELECT code, date, 'orders', orders, 'none', 'testdata' FROM trade)"""
VINTAGES = """vintages AS (
  SELECT 'revenue' AS series_id, observation_date, vintage_date,
         CAST(sum(new) OVER (PARTITION BY observation_date ORDER BY vintage_date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value
  FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS observation_date,
               CAST(date_trunc('month', greatest(l_shipdate, o_orderdate)) AS DATE) AS vintage_date,
               sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS new
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2))"""
EMPLOYMENT = """industry AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS geo, p_brand AS industry, CAST(year(l_shipdate) AS INT) AS year, CAST(quarter(l_shipdate) AS INT) AS qtr,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS emp, count(*) < 2 AS suppressed
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geo, industry, year, qtr, emp, suppressed (cells of a single row)."""
    li = src.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity")
    s, p = src.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), src.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    d = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy(F.col("s_nationkey").cast("string").alias("geo"), F.col("p_brand").alias("industry"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("qtr")).agg(src.exact_sum("l_quantity").alias("emp"), (F.count("*") < 2).alias("suppressed"))


@query(f"WITH {LONG} SELECT * FROM panel")
def long_panel(spark, d):
    return src.trade_panel(spark, d)


@query(f"""WITH {LONG}, g AS (
  SELECT code, variable, min(date) AS first, max(date) AS last, count(*) AS n, min(sa_source) AS sa_source FROM panel GROUP BY 1, 2)
SELECT *, greatest(0, 1 - n / CAST(datediff('month', first, last) // 3 + 1 AS DOUBLE)) AS pct_missing FROM g""")
def coverage_report(spark, d):
    return P.coverage_report(src.trade_panel(spark, d))


@query(f"WITH {LONG} SELECT variable, count(DISTINCT code) AS n_countries FROM panel GROUP BY 1")
def variable_coverage(spark, d):
    return P.variable_coverage(src.trade_panel(spark, d))


@query(f"""WITH {TRADE}, c AS (SELECT upper(substr(code, 1, 3)) AS code, date, revenue AS value FROM trade
  UNION ALL SELECT 'EA', date, revenue FROM trade UNION ALL SELECT 'WLD', date, revenue FROM trade)
SELECT * FROM c WHERE regexp_matches(code, '^[A-Za-z]{{3}}$') AND code <> 'WLD'""")
def drop_aggregates(spark, d):
    w = src.trade_wide(spark, d).select("code", "date", F.col("revenue").alias("value"))
    codes = F.explode(F.array(F.upper(F.substring("code", 1, 3)), F.lit("EA"), F.lit("WLD"))).alias("code")
    return P.drop_aggregates(w.select(codes, "date", "value"))


@query(f"""WITH {LONG}, u AS (SELECT *, 1 AS rank FROM panel WHERE value > 100 UNION ALL SELECT code, date, variable, value * 2, 'x', 'other', 2 FROM panel)
SELECT * EXCLUDE (rank, k) FROM (SELECT *, row_number() OVER (PARTITION BY code, date, variable ORDER BY rank) AS k FROM u) WHERE k = 1""")
def merge_frames(spark, d):
    a = src.trade_panel(spark, d)
    return P.merge_frames(a.where("value > 100"), a.withColumns({"value": F.col("value") * 2, "sa_source": F.lit("x"), "source": F.lit("other")}))


@query(f"""WITH {LONG}, a AS (SELECT * FROM panel WHERE month(date) <= 6), b AS (SELECT code, date, variable, value / 2 AS value, sa_source, 'fallback' AS source FROM panel)
SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (code, date, variable)""")
def gap_fill(spark, d):
    a = src.trade_panel(spark, d)
    return P.gap_fill(a.where("month(date) <= 6"), a.withColumns({"value": F.col("value") / 2, "source": F.lit("fallback")}))


@query(f"""WITH {TRADE}, a AS (SELECT code, date, CASE WHEN orders > 3 THEN revenue END AS revenue, orders FROM trade WHERE month(date) <> 1),
b AS (SELECT code, date, revenue + 1 AS revenue, orders + 1 AS orders FROM trade WHERE month(date) <> 2)
SELECT coalesce(a.code, b.code) AS code, coalesce(a.date, b.date) AS date, coalesce(a.revenue, b.revenue) AS revenue, coalesce(a.orders, b.orders) AS orders
FROM a FULL JOIN b ON a.code = b.code AND a.date = b.date""")
def priority_coalesce(spark, d):
    w = src.trade_wide(spark, d)
    a = w.where("month(date) <> 1").withColumn("revenue", F.when(F.col("orders") > 3, F.col("revenue")))
    b = w.where("month(date) <> 2").withColumns({"revenue": F.col("revenue") + 1, "orders": F.col("orders") + 1})
    return P.priority_coalesce(a, b, ["code", "date"])


@query(f"""WITH {TRADE}, u AS (SELECT code, year(date) AS year, 1 AS pri, sum(revenue) AS v FROM trade WHERE month(date) <= 3 GROUP BY 1, 2
  UNION ALL SELECT code, year(date), 2, sum(revenue) FROM trade GROUP BY 1, 2)
SELECT code, CAST(year AS INT) AS year, pri, round(v, 2) AS v FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY pri) AS k FROM u) WHERE k = 1""")
def priority_splice(spark, d):
    w = src.trade_wide(spark, d).withColumn("year", F.year("date"))
    a = w.where("month(date) <= 3").groupBy("code", "year").agg(src.exact_sum("revenue").alias("v")).withColumn("pri", F.lit(1))
    b = w.groupBy("code", "year").agg(src.exact_sum("revenue").alias("v")).withColumn("pri", F.lit(2))
    return P.first_by(a.unionByName(b), ["code", "year"], "pri").select("code", "year", "pri", F.round("v", 2).alias("v"))


@query(f"""WITH {LONG}, j AS (SELECT variable, value AS va, value * 1.5 AS vb FROM panel WHERE month(date) > 3)
SELECT variable, count(*) AS n, round(avg(va / vb), 6) AS mean_ratio, round(avg(abs(va - vb)), 2) AS mean_gap, max(abs(va - vb)) AS max_gap FROM j GROUP BY 1""")
def splice_audit(spark, d):
    a = src.trade_panel(spark, d)
    out = P.splice_audit(a, a.where("month(date) > 3").withColumn("value", F.col("value") * 1.5), P.KEY)
    return out.select("variable", "n", F.round("mean_ratio", 6).alias("mean_ratio"), F.round("mean_gap", 2).alias("mean_gap"), "max_gap")


@query(f"""WITH {LONG}, p AS (SELECT * FROM panel WHERE NOT (variable = 'orders' AND code LIKE 'A%'))
SELECT * FROM p WHERE code IN (SELECT code FROM p GROUP BY 1 HAVING count(DISTINCT variable) = 2)""")
def sample_recipe(spark, d):
    p = src.trade_panel(spark, d).where("not (variable = 'orders' and code like 'A%')")
    return P.sample_recipe(p, ["revenue", "orders"])


@query(f"WITH {TRADE} SELECT * FROM trade")
def long_to_wide(spark, d):
    return P.long_to_wide(src.trade_panel(spark, d), ["revenue", "orders"])


@query(f"WITH {LONG} SELECT code, date, variable, value FROM panel")
def wide_to_long(spark, d):
    return P.wide_to_long(src.trade_wide(spark, d), ["revenue", "orders"])


@query(f"""WITH {LONG} SELECT code, variable, CAST(date_trunc('quarter', date) AS DATE) AS date, round(avg(value), 4) AS value FROM panel GROUP BY 1, 2, 3""")
def quarterly_mean(spark, d):
    return R.monthly_to_quarterly(src.trade_panel(spark, d)).withColumn("value", F.round("value", 4))


@query(f"""WITH {LONG} SELECT code, 'urate' AS variable, CAST(date_trunc('quarter', date) AS DATE) AS date, arg_max(value, date) AS value FROM panel WHERE variable = 'orders' GROUP BY 1, 3""")
def quarterly_last(spark, d):
    return R.monthly_to_quarterly(src.trade_panel(spark, d).where("variable = 'orders'").withColumn("variable", F.lit("urate")))


@query(f"""WITH {LONG} SELECT code, variable, CAST(date_trunc('quarter', date) AS DATE) AS date, round(avg(value), 4) AS value FROM panel GROUP BY 1, 2, 3 HAVING count(*) = 3""")
def complete_quarter_mean(spark, d):
    return R.complete_quarter_mean(src.trade_panel(spark, d)).withColumn("value", F.round("value", 4))


@query(f"""WITH {TRADE}, p AS (SELECT code, CAST(date_trunc('month', date) AS DATE) AS date, sum(orders) AS total, count(*) AS n FROM trade WHERE orders > 2 GROUP BY 1, 2),
cal AS (SELECT code, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS date FROM (SELECT code, min(date) AS lo, max(date) AS hi FROM p GROUP BY 1))
SELECT code, date, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM cal LEFT JOIN p USING (code, date)""")
def calendar_fill_sum(spark, d):
    return R.period_sum(src.trade_wide(spark, d).where("orders > 2"), ["code"], "date", "orders", "month")


@query(f"""WITH {TRADE}, y AS (SELECT code, CAST(year(date) AS INT) AS year, sum(orders) AS v FROM trade GROUP BY 1, 2)
SELECT code, CAST(make_date(year, 1, 1) + to_months(CAST(q * 3 AS INT)) AS DATE) AS date, v * w AS value FROM y, (VALUES (0, CAST(0.4 AS DOUBLE)), (1, CAST(0.3 AS DOUBLE)), (2, CAST(0.2 AS DOUBLE)), (3, CAST(0.1 AS DOUBLE))) t(q, w)""")
def annual_to_quarter(spark, d):
    y = src.trade_wide(spark, d).groupBy("code", F.year("date").alias("year")).agg(F.sum("orders").alias("v"))
    return R.annual_to_quarters(y, ["code"], "year", "v", "front_loaded")


@query("""WITH o AS (SELECT o_orderpriority AS code, o_orderdate FROM orders WHERE o_totalprice > 300000 OR (year(o_orderdate) = 1997 AND quarter(o_orderdate) = 1)),
q AS (SELECT DISTINCT code, year(o_orderdate) * 4 + quarter(o_orderdate) AS q FROM o WHERE o_orderdate < DATE '1996-02-01' OR o_orderdate > DATE '1997-01-01'),
g AS (SELECT code, q, lead(q) OVER (PARTITION BY code ORDER BY q) - q - 1 AS gap FROM q)
SELECT code, make_date((q + 1 - 1) // 4, (q + 1 - 1) % 4 * 3 + 1, 1) AS gap_start, make_date((q + gap - 1) // 4, (q + gap - 1) % 4 * 3 + 1, 1) AS gap_end, gap FROM g WHERE gap >= 2""")
def find_gaps(spark, d):
    o = src.table(spark, d, "orders").where("o_totalprice > 300000 or (year(o_orderdate) = 1997 and quarter(o_orderdate) = 1)").where("o_orderdate < '1996-02-01' or o_orderdate > '1997-01-01'")
    return R.gaps(o.select(F.col("o_orderpriority").alias("code"), "o_orderdate"), ["code"], "o_orderdate", 2)


@query(f"""WITH {TRADE}, c AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS i, CASE WHEN month(date) % 3 = 1 THEN orders END AS v FROM trade),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY code ORDER BY i ROWS UNBOUNDED PRECEDING) AS pi,
  last_value(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY i ROWS UNBOUNDED PRECEDING) AS pv,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY code ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  first_value(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM c)
SELECT code, date, CAST(i AS INT) AS i, round(coalesce(v, pv + (nv - pv) / nullif(ni - pi, 0) * (i - pi)), 6) AS v FROM k""")
def interpolate(spark, d):
    from pyspark.sql import Window

    w = src.trade_wide(spark, d).select("code", "date", F.row_number().over(Window.partitionBy("code").orderBy("date")).alias("i"), F.when(F.month("date") % 3 == 1, F.col("orders")).alias("v"))
    return R.interpolate(w, ["code"], "i", "v").withColumn("v", F.round("v", 6))


@query(f"""WITH {TRADE}, c AS (SELECT code, date, CASE WHEN month(date) = 1 THEN orders END AS v FROM trade)
SELECT code, date, last_value(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS v FROM c""")
def forward_fill(spark, d):
    w = src.trade_wide(spark, d).select("code", "date", F.when(F.month("date") == 1, F.col("orders")).alias("v"))
    return w.select("code", "date", R.forward_fill("v", ["code"], "date", 5).alias("v"))


@query(f"""WITH {TRADE} SELECT code, date, CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '2006-12-31' THEN 'PreGR' ELSE 'OTHER' END AS world,
 CASE WHEN date BETWEEN DATE '2001-01-01' AND DATE '2008-12-31' THEN 'Bush43' ELSE 'OTHER' END AS political FROM trade""")
def regime_tag(spark, d):
    return src.trade_wide(spark, d).select("code", "date", P.regime(F.col("date"), P.REGIMES["global"]).alias("world"), P.regime(F.col("date"), P.REGIMES["us_political"]).alias("political"))


@query(f"""WITH {TRADE}, t AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS t FROM trade), r AS (SELECT code, date, CAST(CASE WHEN t >= 50 THEN 2 WHEN t >= 20 THEN 1 ELSE 0 END AS INT) AS regime FROM t)
SELECT *, CAST(regime = 0 AS INT) AS regime_0, CAST(regime = 1 AS INT) AS regime_1, CAST(regime = 2 AS INT) AS regime_2 FROM r""")
def break_regimes(spark, d):
    from pyspark.sql import Window

    t = F.row_number().over(Window.partitionBy("code").orderBy("date")) - 1
    w = src.trade_wide(spark, d).select("code", "date", t.alias("t")).select("code", "date", P.break_regime(F.col("t"), [20, 50]).alias("regime"))
    return w.select("*", *P.dummies(F.col("regime"), [0, 1, 2]))


@query(f"""WITH {VINTAGES} SELECT series_id, observation_date, arg_max(value, vintage_date) AS value, max(vintage_date) AS vintage_date FROM vintages WHERE vintage_date <= DATE '1998-06-01' GROUP BY 1, 2""")
def as_of(spark, d):
    return P.as_of(src.vintages(spark, d), F.lit("1998-06-01").cast("date"))


@query(f"""WITH {VINTAGES}, a(as_of) AS (VALUES (DATE '1996-01-01'), (DATE '1997-01-01'), (DATE '1998-01-01'))
SELECT series_id, observation_date, as_of, arg_max(value, vintage_date) AS value FROM vintages JOIN a ON vintage_date <= as_of GROUP BY 1, 2, 3""")
def align_vintages(spark, d):
    return P.align_vintages(src.vintages(spark, d), ["1996-01-01", "1997-01-01", "1998-01-01"])


@query(f"""WITH {VINTAGES} SELECT series_id, count(*) AS n, min(vintage_date) AS first_vintage, max(vintage_date) AS last_vintage, count(DISTINCT observation_date) AS n_observations, count(DISTINCT vintage_date) AS n_vintages FROM vintages GROUP BY 1""")
def vintage_coverage(spark, d):
    return P.vintage_coverage(src.vintages(spark, d))


@query(f"""WITH {VINTAGES} SELECT series_id, observation_date, arg_min(value, vintage_date) AS first_value, arg_max(value, vintage_date) AS last_value, count(*) AS n, arg_max(value, vintage_date) - arg_min(value, vintage_date) AS revision FROM vintages GROUP BY 1, 2""")
def vintage_revisions(spark, d):
    return P.revisions(src.vintages(spark, d))


@query(f"""WITH {VINTAGES}, n AS (SELECT series_id, observation_date, vintage_date, value + 1 AS value FROM vintages WHERE month(vintage_date) = 6)
SELECT v.* FROM vintages v ANTI JOIN n USING (series_id, observation_date, vintage_date) UNION ALL SELECT * FROM n""")
def vintage_upsert(spark, d):
    v = src.vintages(spark, d)
    return src.upsert(v, v.where("month(vintage_date) = 6").withColumn("value", F.col("value") + 1), ["series_id", "observation_date", "vintage_date"])


@query(f"""WITH {TRADE}, r AS (SELECT code, date, orders AS deflator FROM trade WHERE month(date) IN (1, 8)), l AS (SELECT code, date FROM trade WHERE month(date) % 2 = 0),
j AS (SELECT l.code, l.date, r.deflator, row_number() OVER (PARTITION BY l.code, l.date ORDER BY abs(datediff('day', l.date, r.date)), r.date) AS k FROM l LEFT JOIN r ON l.code = r.code)
SELECT code, date, deflator FROM j WHERE k = 1""")
def nearest_join(spark, d):
    w = src.trade_wide(spark, d)
    return P.nearest_on(w.where("month(date) % 2 = 0").select("code", "date"), w.where("month(date) in (1, 8)").select("code", "date", F.col("orders").alias("deflator")), "code", "date", "deflator").select("code", "date", "deflator")


@query(f"""WITH {EMPLOYMENT}, m AS (SELECT geo, industry, avg(emp) AS emp FROM industry WHERE NOT suppressed AND year = 1996 GROUP BY 1, 2)
SELECT geo, industry, round(emp / sum(emp) OVER (PARTITION BY geo), 8) AS share FROM m""")
def base_year_shares(spark, d):
    return S.base_year_shares(employment(spark, d), 1996).withColumn("share", F.round("share", 8))


@query(f"""WITH {EMPLOYMENT}, q AS (SELECT *, year * 4 + qtr - 1 AS q FROM industry), b AS (SELECT min(q) AS lo, max(q) AS hi FROM q),
t AS (SELECT unnest(generate_series(lo + 4, hi)) AS t, lo FROM b),
m AS (SELECT geo, industry, t, avg(emp) AS emp FROM q JOIN t ON q.q BETWEEN t - 4 AND t - 1 AND t - 4 >= lo WHERE NOT suppressed GROUP BY 1, 2, 3)
SELECT geo, industry, CAST(t // 4 AS INT) AS year, CAST(t % 4 + 1 AS INT) AS qtr, round(emp / sum(emp) OVER (PARTITION BY geo, t), 8) AS share FROM m""")
def rolling_shares(spark, d):
    return S.rolling_shares(employment(spark, d), 4, 1).withColumn("share", F.round("share", 8))


BETAS = "betas AS (SELECT DISTINCT p_brand AS industry, CAST(right(p_brand, 1) AS DOUBLE) / 10 AS beta FROM part WHERE p_brand <> 'Brand#11')"


def betas(spark, d):
    return src.table(spark, d, "part").where("p_brand <> 'Brand#11'").select(F.col("p_brand").alias("industry"), (F.substring("p_brand", -1, 1).cast("double") / 10).alias("beta")).distinct()


@query(f"""WITH {EMPLOYMENT}, {BETAS}, m AS (SELECT geo, industry, avg(emp) AS emp FROM industry WHERE NOT suppressed AND year = 1996 GROUP BY 1, 2), s AS (SELECT geo, industry, emp / sum(emp) OVER (PARTITION BY geo) AS share FROM m)
SELECT geo, round(sum(share * coalesce(beta, 0)), 8) AS exposure FROM s LEFT JOIN betas USING (industry) GROUP BY 1""")
def exposure_iv(spark, d):
    return S.exposure(S.base_year_shares(employment(spark, d), 1996), betas(spark, d)).withColumn("exposure", F.round("exposure", 8))


@query(f"""WITH {EMPLOYMENT}, {BETAS}, m AS (SELECT geo, industry, avg(emp) AS emp FROM industry WHERE NOT suppressed AND year = 1996 GROUP BY 1, 2), s AS (SELECT geo, industry, emp / sum(emp) OVER (PARTITION BY geo) AS share FROM m),
v AS (SELECT industry, var_pop(emp) AS variance FROM industry GROUP BY 1), r AS (SELECT industry, any_value(beta) * sum(share * share) * any_value(variance) AS raw FROM s JOIN betas USING (industry) JOIN v USING (industry) GROUP BY 1)
SELECT industry, round(raw / sum(raw) OVER (), 8) AS weight FROM r""")
def rotemberg_weights(spark, d):
    e = employment(spark, d)
    return S.rotemberg_weights(S.base_year_shares(e, 1996), betas(spark, d), e.groupBy("industry").agg(F.var_pop("emp").alias("variance"))).withColumn("weight", F.round("weight", 8))


@query(f"""WITH {TRADE} SELECT code, date, ln(orders) - ln(lag(orders) OVER w) AS dlog, lead(orders, 3) OVER w - lag(orders, 1) OVER w AS dy_3, lag(orders, 2) OVER w AS orders_L2 FROM trade WINDOW w AS (PARTITION BY code ORDER BY date)""")
def lag_design(spark, d):
    t = src.trade_wide(spark, d)
    return t.select("code", "date", W.log_difference("orders", ["code"], "date").alias("dlog"), W.long_difference("orders", 3, ["code"], "date").alias("dy_3"), F.lag("orders", 2).over(W.over(["code"], "date")).alias("orders_L2"))


@query(f"""WITH {TRADE} SELECT code, date, round((orders - avg(orders) OVER w) / nullif(stddev_pop(orders) OVER w, 0) * 20 + 100, 6) AS z FROM trade WINDOW w AS (PARTITION BY code)""")
def zscore(spark, d):
    return src.trade_wide(spark, d).select("code", "date", F.round(W.zscore("orders", ["code"], 100.0, 20.0), 6).alias("z"))


@query(f"""WITH {TRADE} SELECT code, date, (rank() OVER (PARTITION BY code ORDER BY orders) + (count(*) OVER (PARTITION BY code, orders) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY code) AS p FROM trade""")
def pct_rank_state(spark, d):
    return src.trade_wide(spark, d).select("code", "date", W.pct_rank("orders", ["code"]).alias("p"))


def _band_pass_sql() -> str:
    w = W.band_pass_weights()
    terms = " + ".join(f"CAST({x!r} AS DOUBLE) * (lag(orders, {j}) OVER w + lead(orders, {j}) OVER w)" for j, x in enumerate(w[1:], 1))
    return f"WITH {TRADE} SELECT code, date, round(orders * CAST({w[0]!r} AS DOUBLE) + {terms}, 6) AS cycle FROM trade WINDOW w AS (PARTITION BY code ORDER BY date)"


@query(_band_pass_sql())
def band_pass(spark, d):
    return src.trade_wide(spark, d).select("code", "date", F.round(W.band_pass("orders", ["code"], "date"), 6).alias("cycle"))


DAILY = """daily AS (SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000 AS rv FROM orders GROUP BY 1, 2)"""


def daily(spark, d):
    o = src.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("code"), F.to_date("o_orderdate").alias("date")).agg((src.exact_sum("o_totalprice") / 1000000).alias("rv"))


@query(f"""WITH {DAILY} SELECT code, date, lag(rv) OVER w AS rv_d,
 CASE WHEN count(*) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) = 4 THEN round(avg(rv) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING), 10) END AS rv_w,
 CASE WHEN count(*) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 22 PRECEDING AND 6 PRECEDING) = 17 THEN round(avg(rv) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 22 PRECEDING AND 6 PRECEDING), 10) END AS rv_m
FROM daily WINDOW w AS (PARTITION BY code ORDER BY date)""")
def har_design(spark, d):
    t = daily(spark, d).select("code", "date", *W.har_terms("rv", ["code"], "date"))
    return t.select("code", "date", "rv_d", F.round("rv_w", 10).alias("rv_w"), F.round("rv_m", 10).alias("rv_m"))


@query(f"""WITH {TRADE}, a AS (SELECT code, date, orders, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM trade),
w AS (SELECT a.code, a.date, k.k, b.orders AS v FROM a, (SELECT unnest([0, 1, 2, 3]) AS k) k, a b WHERE b.code = a.code AND b.i = ((a.i - k.k) % a.n + a.n) % a.n),
p AS (SELECT code, date, max(v) FILTER (k = 0) AS v0, max(v) FILTER (k = 1) AS v1, max(v) FILTER (k = 2) AS v2, max(v) FILTER (k = 3) AS v3 FROM w GROUP BY 1, 2)
SELECT code, date, (v0 - v1) / 2 AS d1, ((v0 + v1) / 2 - (v2 + v3) / 2) / 2 AS d2, ((v0 + v1) / 2 + (v2 + v3) / 2) / 2 AS smooth FROM p""")
def haar_modwt(spark, d):
    return W.haar(src.trade_wide(spark, d), "orders", ["code"], "date", 2)


@query(f"""WITH {TRADE}, t AS (SELECT date, avg(orders) AS m, var_pop(orders) AS v FROM trade GROUP BY 1), s AS (SELECT var_pop(m) AS b, avg(v) AS w FROM t)
SELECT round(b, 8) AS between, round(w, 8) AS within, round(b / (b + w), 8) AS share FROM s""")
def between_within(spark, d):
    out = W.between_within(src.trade_wide(spark, d), "code", "date", "orders")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query(f"""WITH {TRADE}, t AS (SELECT date, avg(orders) AS m, var_pop(orders) AS v FROM trade GROUP BY 1), s AS (SELECT date, count(*) OVER w AS n, var_pop(m) OVER w AS b, avg(v) OVER w AS wi FROM t WINDOW w AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))
SELECT date, round(b, 6) AS between, round(wi, 6) AS within, round(b / (b + wi), 6) AS share FROM s WHERE n = 25""")
def rolling_between_within(spark, d):
    t = src.trade_wide(spark, d).withColumn("i", F.year("date") * 12 + F.month("date"))
    out = W.rolling_between_within(t, "date", "orders", "i", 12)
    return out.select("date", *[F.round(c, 6).alias(c) for c in ("between", "within", "share")])


@query(f"""WITH {TRADE}, r AS (SELECT code, month(date) AS g, count(*) OVER (PARTITION BY code) AS n, count(*) OVER (PARTITION BY code, orders) AS t,
  rank() OVER (PARTITION BY code ORDER BY orders) + (count(*) OVER (PARTITION BY code, orders) - 1) / CAST(2 AS DOUBLE) AS r FROM trade),
s AS (SELECT code, g, sum(r) AS s, count(*) AS k, any_value(n) AS n, CAST(sum(t * t - 1) AS DOUBLE) AS tie FROM r GROUP BY 1, 2)
SELECT code, round((CAST(12 AS DOUBLE) / (any_value(n) * (any_value(n) + 1)) * sum(s * s / k) - 3 * (any_value(n) + 1)) / (1 - sum(tie) / (power(any_value(n), 3) - any_value(n))), 6) AS h_stat, count(*) - 1 AS df, any_value(n) AS n FROM s GROUP BY 1 HAVING any_value(n) >= 36""")
def kruskal_wallis(spark, d):
    out = W.kruskal_wallis(src.trade_wide(spark, d), ["code"], F.month("date"), "orders")
    return out.withColumn("h_stat", F.round("h_stat", 6))
