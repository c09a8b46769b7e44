"""Queries over the driver's tables for text, events, scores, volatility and estimators, with SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import did as D
from ..operators import events as E
from ..operators import regression as G
from ..operators import scoring as C
from ..operators import series as T
from ..operators import text as X
from ..operators import volatility as V
from ..sources import panel as src
from .panel_queries import DAILY, TRADE, daily
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


RECORDS = "records AS (SELECT DATE '2000-01-01' + CAST(doc_id % 4000 AS INT) AS date, text, 'doc://' || doc_id AS url, lang FROM documents)"


#: Terms by language; rows of another language, or of none, go by the English ones.
TERMS = {
    "en": {"economy": ["the", "and"], "policy": ["of", "in"], "doubt": ["was", "from"]}, "de": {"economy": ["der", "und"], "policy": ["die", "in"], "doubt": ["nicht", "von"]},
    "fr": {"economy": ["le", "et"], "policy": ["la", "en"], "doubt": ["dans", "sur"]}, "es": {"economy": ["el", "y"], "policy": ["la", "en"], "doubt": ["por", "que"]},
}
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _listed(terms):
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _each(form):
    """A CASE over languages of an SQL form of the language's terms."""
    return "CASE " + " ".join(f"WHEN lang = '{x}' THEN {form(t)}" for x, t in TERMS.items() if x != "en") + f" ELSE {form(TERMS['en'])} END"


def _count(*groups):
    return _each(lambda t: f"len(list_filter({WORDS}, lambda w: list_contains({_listed(sum((t[g] for g in groups), []))}, w)))")


def _has(text, *groups):
    tokens = rf"regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+')"
    return _each(lambda t: "(" + " AND ".join(f"list_has_any({tokens}, {_listed(t[g])})" for g in groups) + ")")


def counted(*groups):
    return X.by_language(F.col("lang"), {x: X.count_terms(F.col("text"), sum((t[g] for g in groups), []), x) for x, t in TERMS.items()})


def records(spark, d):
    """All documents as text records, with their language."""
    return src.text_records(spark, d).withColumn("lang", F.col("metadata")["lang"])


@query("SELECT DATE '2000-01-01' + CAST(doc_id % 4000 AS INT) AS date, text, 'doc://' || doc_id AS url FROM documents")
def text_records(spark, d):
    return src.text_records(spark, d).select("date", "text", "url")


@query(rf"""WITH {RECORDS}, c AS (SELECT url, {_count("economy", "policy")} AS hits, len(regexp_extract_all(text, '\S+')) AS words FROM records)
SELECT *, CASE WHEN words > 0 THEN round(hits / CAST(words AS DOUBLE) * 1000, 6) ELSE 0 END AS per_thousand FROM c""")
def keyword_count(spark, d):
    c = records(spark, d).select("url", counted("economy", "policy").cast("long").alias("hits"), X.n_words(F.col("text")).cast("long").alias("words"))
    return c.withColumn("per_thousand", F.round(X.per_thousand(F.col("hits"), F.col("words")), 6))


@query(rf"""WITH {RECORDS} SELECT url, CAST({_has("lower(text)", "economy", "policy", "doubt")} AS INT) AS doc_hit,
 CAST(len(list_filter(list_transform(string_split_regex(lower(text), '[.!?]+'), lambda s: trim(s)), lambda s: s <> '' AND {_has("s", "economy", "doubt")})) AS INT) AS sentence_hits FROM records""")
def cooccurrence(spark, d):
    each = lambda groups, unit: X.by_language(F.col("lang"), {x: X.cooccurrence(F.col("text"), [t[g] for g in groups], unit) for x, t in TERMS.items()})
    return records(spark, d).select("url", each(["economy", "policy", "doubt"], "document").alias("doc_hit"), each(["economy", "doubt"], "sentence").alias("sentence_hits"))


@query(rf"""WITH {RECORDS}, c AS (SELECT url, {_count("economy")} AS a, {_count("policy")} AS b FROM records) SELECT url, CASE WHEN a + b > 0 THEN round((a - b) / CAST(a + b AS DOUBLE), 8) ELSE 0 END AS tone FROM c""")
def tone(spark, d):
    each = X.by_language(F.col("lang"), {x: X.tone(F.col("text"), t["economy"], t["policy"]) for x, t in TERMS.items()})
    return records(spark, d).select("url", F.round(each, 8).alias("tone"))


def _index_sql(agg):
    return rf"""WITH {RECORDS}, s AS (SELECT date, {_count("doubt")} AS score FROM records),
q AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, {agg} AS value FROM s GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 3 MONTH)) AS DATE) AS date FROM q)
SELECT date, round(value, 6) AS value FROM cal LEFT JOIN q USING (date)"""


def _index(spark, d, how):
    scored = records(spark, d).select("date", counted("doubt").alias("score"))
    return X.index_quarterly(scored, how).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(_index_sql("avg(score)"))
def index_mean(spark, d):
    return _index(spark, d, "mean")


@query(_index_sql("CAST(max(score) AS DOUBLE)"))
def index_max(spark, d):
    return _index(spark, d, "max")


@query(_index_sql("coalesce(stddev_samp(score), 0)"))
def index_dispersion(spark, d):
    return _index(spark, d, "dispersion")


@query(_index_sql("avg(score)").replace("SELECT date, round(value, 6) AS value FROM cal LEFT JOIN q USING (date)", "SELECT date, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value FROM cal LEFT JOIN q USING (date)"))
def index_zscore(spark, d):
    scored = records(spark, d).select("date", counted("doubt").alias("score"))
    return X.normalise(X.index_quarterly(scored)).withColumn("value", F.round("value", 6))


@query(rf"""WITH {RECORDS} SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, count(*) AS n_docs, round(avg(len(regexp_extract_all(text, '\S+'))), 6) AS mean_words FROM records GROUP BY 1""")
def sparsity_report(spark, d):
    return X.sparsity(records(spark, d)).withColumn("mean_words", F.round("mean_words", 6))


@query("""WITH p AS (SELECT avg(e) AS m, i FROM (SELECT unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 0) GROUP BY 2), s AS (SELECT list(CAST(m AS DOUBLE) ORDER BY i) AS seed FROM p)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), seed), 6) AS cosine FROM embeddings, s""")
def embedding_cosine(spark, d):
    v = src.table(spark, d, "embeddings")
    seed = v.where("label = 0").select(F.posexplode("embedding")).groupBy("pos").agg(F.avg("col").alias("m"))
    seed = seed.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("seed"))  # one row of one vector
    return v.join(F.broadcast(seed)).select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("seed")), 6).alias("cosine"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|li|tr|h[1-6]|article|section)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM a)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS text FROM b""")
def strip_html(spark, d):
    return src.table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


EVENTS = """ev AS (SELECT o_orderkey AS event_id, n_name AS code, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderpriority LIKE '1%' THEN 'fiscal' WHEN o_orderpriority LIKE '2%' THEN 'macropru' WHEN o_orderpriority LIKE '3%' THEN 'structural' ELSE 'monetary' END AS kind,
 CASE o_orderstatus WHEN 'F' THEN -1 ELSE 1 END AS sign, CAST(round(o_totalprice) AS DOUBLE) AS magnitude, o_orderkey % 10 / CAST(10 AS DOUBLE) AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 'tax' ELSE 'both' END AS target, CASE o_orderkey % 4 WHEN 0 THEN 'Wages' WHEN 1 THEN 'vat' WHEN 2 THEN 'general' END AS subtarget FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def narrative(spark, d):
    o = src.table(spark, d, "orders").join(src.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(src.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = F.col("o_orderpriority")
    kind = F.when(p.startswith("1"), "fiscal").when(p.startswith("2"), "macropru").when(p.startswith("3"), "structural").otherwise("monetary")
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.col("n_name").alias("code"), F.to_date("o_orderdate").alias("date"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("sign"),
        F.round("o_totalprice").alias("magnitude"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), F.when(F.col("o_orderkey") % 3 == 0, "tax").otherwise("both").alias("target"),
        F.when(F.col("o_orderkey") % 4 == 0, "Wages").when(F.col("o_orderkey") % 4 == 1, "vat").when(F.col("o_orderkey") % 4 == 2, "general").alias("subtarget"),
        F.lit("keyword").alias("scoring"), F.array().cast("array<struct<date:date,weight:double>>").alias("profile"), F.lit(False).alias("unanticipated"),
    )


def _events_sql(value):
    return f"""WITH {EVENTS}, e AS (SELECT *, CAST(date_trunc('quarter', date) AS DATE) AS q, CASE WHEN kind IN ('macropru', 'structural') THEN CAST(sign AS DOUBLE) ELSE sign * magnitude END AS v FROM ev WHERE confidence >= CAST(0.2 AS DOUBLE)),
p AS (SELECT code, kind, q AS date, CASE WHEN any_value(kind) = 'macropru' THEN sum(v) WHEN any_value(kind) = 'structural' THEN arg_min(v, (date, v)) ELSE {value} END AS value FROM e GROUP BY 1, 2, 3),
cal AS (SELECT code, kind, CAST(unnest(generate_series(lo, hi, INTERVAL 3 MONTH)) AS DATE) AS date FROM (SELECT code, kind, min(date) AS lo, max(date) AS hi FROM p GROUP BY 1, 2))
SELECT code, kind, date, round(coalesce(value, 0), 4) AS value FROM cal LEFT JOIN p USING (code, kind, date)"""


def _events(spark, d, how):
    return E.quarterly(narrative(spark, d), how, 0.2).withColumn("value", F.round("value", 4) + 0.0)


@query(_events_sql("sum(v)"))
def events_quarterly_sum(spark, d):
    return _events(spark, d, "sum")


@query(_events_sql("avg(v)"))
def events_quarterly_mean(spark, d):
    return _events(spark, d, "mean")


@query(_events_sql("arg_max(v, (abs(v), date))"))
def events_quarterly_max(spark, d):
    return _events(spark, d, "max")


@query(_events_sql("arg_min(v, (date, v))"))
def events_quarterly_first(spark, d):
    return _events(spark, d, "first")


@query(f"""WITH {EVENTS}, f AS (SELECT event_id, CASE WHEN ((code = 'NATION_3' AND month(date) = 3) OR (code = 'NATION_7' AND month(date) = 9)) AND subtarget IN ('Wages', 'general') THEN confidence * CAST(0.25 AS DOUBLE) ELSE confidence END AS confidence FROM ev) SELECT * FROM f WHERE confidence >= CAST(0.1 AS DOUBLE)""")
def surprise_filter(spark, d):
    return E.surprise_filter(narrative(spark, d), {"NATION_3": 3, "NATION_7": 9}).select("event_id", "confidence")


CHAINS = f"""{EVENTS}, l AS (SELECT *, lag(date) OVER w AS d0, lag(magnitude) OVER w AS m0 FROM ev WINDOW w AS (PARTITION BY code, target, sign ORDER BY date, event_id)),
c AS (SELECT *, CAST(sum(CASE WHEN d0 IS NULL OR datediff('day', d0, date) > 90 OR (m0 > 0 AND magnitude > 0 AND greatest(m0, magnitude) / least(m0, magnitude) > 4) THEN 1 ELSE 0 END) OVER (PARTITION BY code, target, sign ORDER BY date, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM l)"""


@query(f"WITH {CHAINS} SELECT event_id, cluster FROM c")
def event_clusters(spark, d):
    return E.chains(narrative(spark, d)).select("event_id", "cluster")


@query(f"WITH {CHAINS} SELECT event_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY code, target, sign, cluster ORDER BY confidence DESC, magnitude DESC, date, event_id) AS k FROM c) WHERE k = 1")
def event_representatives(spark, d):
    return E.representatives(E.chains(narrative(spark, d))).select("event_id", "cluster")


@query("""WITH l AS (SELECT event_type AS source, ts, CASE WHEN value > 20 THEN 'success' ELSE 'error' END AS outcome, CASE WHEN user_id % 4 = 0 THEN 'wayback' ELSE 'live' END AS fallback_used FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20')
SELECT source, count(*) AS n_total, count(*) FILTER (outcome = 'success') AS n_success, count(*) FILTER (fallback_used <> 'live') AS n_fallback, max(ts) AS last_seen, count(*) FILTER (outcome = 'success') / CAST(count(*) AS DOUBLE) AS success_rate, count(*) FILTER (fallback_used <> 'live') / CAST(count(*) AS DOUBLE) AS fallback_rate FROM l GROUP BY 1""")
def connector_health(spark, d):
    e = src.table(spark, d, "events").select(F.col("event_type").alias("source"), "ts", F.when(F.col("value") > 20, "success").otherwise("error").alias("outcome"), F.when(F.col("user_id") % 4 == 0, "wayback").otherwise("live").alias("fallback_used"))
    return E.connector_health(e, "2024-01-20 00:00:00")


DAYS = "r AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, (value - 50) / 1000 AS r, value, 1 + value AS price FROM events)"


def ticks(spark, d):
    return src.table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", ((F.col("value") - 50) / 1000).alias("r"), "value", (1 + F.col("value")).alias("price"))


@query(f"""WITH {DAYS}, p AS (SELECT *, abs(lag(r) OVER (PARTITION BY user_id, day ORDER BY ts, event_id)) * abs(r) AS p FROM r), g AS (SELECT user_id, day, sum(r * r) AS rv, coalesce(sum(p), 0) * pi() / 2 AS bv FROM p GROUP BY 1, 2)
SELECT user_id, day, round(rv, 10) AS rv, round(bv, 10) AS bv, CASE WHEN rv > 0 THEN round(greatest(0, rv - bv) / rv, 8) ELSE 0 END AS jump FROM g""")
def realised_measures(spark, d):
    out = V.realised(ticks(spark, d), ["user_id", "day"], ["ts", "event_id"], "r")
    return out.select("user_id", "day", F.round("rv", 10).alias("rv"), F.round("bv", 10).alias("bv"), F.round("jump", 8).alias("jump"))


@query(f"""WITH {DAYS}, b AS (SELECT user_id, day, arg_min(price, (ts, event_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, event_id)) AS c FROM r GROUP BY 1, 2)
SELECT user_id, day, round(power(ln(h / l), 2) / (4 * ln(2)), 8) AS parkinson, round(power(ln(h / l), 2) / 2 - (2 * ln(2) - 1) * power(ln(c / o), 2), 8) AS garman_klass, round(ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o), 8) AS rogers_satchell FROM b""")
def range_measures(spark, d):
    bars = ticks(spark, d).groupBy("user_id", "day").agg(F.min_by("price", F.struct("ts", "event_id")).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", F.struct("ts", "event_id")).alias("c"))
    o, h, l, c = (F.col(x) for x in "ohlc")
    return bars.select("user_id", "day", F.round(V.parkinson(h, l), 8).alias("parkinson"), F.round(V.garman_klass(o, h, l, c), 8).alias("garman_klass"), F.round(V.rogers_satchell(o, h, l, c), 8).alias("rogers_satchell"))


@query("""WITH t AS (SELECT user_id % 10 AS region, CAST(ts AS DATE) AS day, avg(value) / 2 AS temp FROM events GROUP BY 1, 2) SELECT region, day, round(greatest(temp - 18, 0), 6) AS cdd, round(greatest(18 - temp, 0), 6) AS hdd FROM t""")
def degree_days(spark, d):
    t = src.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("region"), F.to_date("ts").alias("day")).agg((F.avg("value") / 2).alias("temp"))
    cool, heat = V.degree_days(F.col("temp"))
    return t.select("region", "day", F.round(cool, 6).alias("cdd"), F.round(heat, 6).alias("hdd"))


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS origin, o_orderstatus AS destination FROM orders),
g AS (SELECT month, origin, destination, count(*) AS n FROM m WHERE origin IS NOT NULL GROUP BY 1, 2, 3) SELECT *, n / CAST(sum(n) OVER (PARTITION BY month, origin) AS DOUBLE) AS p FROM g""")
def labour_transitions(spark, d):
    o = src.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    m = o.select(src.period(F.col("o_orderdate"), "month").alias("month"), F.lag("o_orderstatus").over(w).alias("origin"), F.col("o_orderstatus").alias("destination")).where("origin is not null")
    return V.transitions(m, "month", "origin", "destination")


_STATES = "(SELECT unnest(['F', 'O', 'P']) AS {0}) {0}"
_CHAIN = f"""m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_orderstatus AS j FROM orders), g AS (SELECT month, i, j, count(*) AS n FROM m WHERE i IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT month, i, j, n / CAST(sum(n) OVER (PARTITION BY month, i) AS DOUBLE) AS p FROM g), q AS (SELECT DISTINCT CAST(date_trunc('quarter', month) AS DATE) AS g FROM p),
f AS (SELECT q.g, k.k, i.i, j.j, CASE WHEN EXISTS (SELECT 1 FROM p z WHERE z.month = CAST(q.g + to_months(CAST(k.k AS INT)) AS DATE)) THEN coalesce(p.p, CAST(i.i = j.j AS DOUBLE)) ELSE CAST(i.i = j.j AS DOUBLE) END AS p
 FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) k CROSS JOIN {_STATES.format("i")} CROSS JOIN {_STATES.format("j")} LEFT JOIN p ON p.month = CAST(q.g + to_months(CAST(k.k AS INT)) AS DATE) AND p.i = i.i AND p.j = j.j)"""


@query(f"""WITH {_CHAIN} SELECT a.g, a.i AS origin, c.j AS destination, round(sum(a.p * b.p * c.p), 8) AS p FROM f a JOIN f b ON a.g = b.g AND a.k = 0 AND b.k = 1 AND a.j = b.i JOIN f c ON b.g = c.g AND c.k = 2 AND b.j = c.i GROUP BY 1, 2, 3""")
def labour_quarterly_chain(spark, d):
    chain = V.chained(labour_transitions(spark, d), "month", "origin", "destination", ["F", "O", "P"], src.period(F.col("month"), "quarter"))
    return chain.withColumn("p", F.round("p", 8))


FORECASTS = f"""{TRADE}, f AS (SELECT code, date, orders AS realized, lag(orders) OVER w AS m1, avg(orders) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m2, lag(orders, 12) OVER w AS m3, row_number() OVER w AS k FROM trade WINDOW w AS (PARTITION BY code ORDER BY date)),
g AS (SELECT * FROM f WHERE k > 12)"""


def forecasts(spark, d):
    w = Window.partitionBy("code").orderBy("date")
    t = src.trade_wide(spark, d).select("code", "date", F.col("orders").alias("realized"), F.lag("orders").over(w).alias("m1"), F.avg("orders").over(w.rowsBetween(-6, -1)).alias("m2"), F.lag("orders", 12).over(w).alias("m3"), F.row_number().over(w).alias("k"))
    return t.where("k > 12")


@query(f"""WITH {FORECASTS}, l AS (SELECT code, model, realized, forecast FROM g UNPIVOT (forecast FOR model IN (m1, m2, m3))), e AS (SELECT code, model, avg(power(forecast - realized, 2)) AS mse FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY mse, model) AS rank, CASE WHEN mse <= CAST(1.1 AS DOUBLE) * min(mse) OVER (PARTITION BY code) THEN CAST(1 AS DOUBLE) ELSE 0 END AS keep FROM e)
SELECT code, model, round(mse, 6) AS mse, round(CAST(1 AS DOUBLE) / count(*) OVER w, 8) AS w_equal, round(1 / mse / sum(1 / mse) OVER w, 8) AS w_inverse, round(CAST(1 AS DOUBLE) / rank / sum(CAST(1 AS DOUBLE) / rank) OVER w, 8) AS w_rank, round(keep / sum(keep) OVER w, 8) AS w_set FROM r WINDOW w AS (PARTITION BY code)""")
def forecast_weights(spark, d):
    l = forecasts(spark, d).unpivot(["code", "date", "realized"], ["m1", "m2", "m3"], "model", "forecast")
    out = C.weights(l, ["code"])
    return out.select("code", "model", F.round("mse", 6).alias("mse"), *[F.round(c, 8).alias(c) for c in ("w_equal", "w_inverse", "w_rank", "w_set")])


@query(f"""WITH {FORECASTS}, e AS (SELECT code, date, power(realized - m1, 2) - power(realized - m2, 2) AS d FROM g), c AS (SELECT code, date, avg(d) OVER (PARTITION BY code) AS mean, d - avg(d) OVER (PARTITION BY code) AS c FROM e),
l AS (SELECT *, lag(c) OVER (PARTITION BY code ORDER BY date) AS c1 FROM c), s AS (SELECT code, any_value(mean) AS mean, sum(c * c) + 2 * (1 - CAST(1 AS DOUBLE) / 2) * sum(c * c1) AS s2, count(*) AS n FROM l GROUP BY 1)
SELECT code, round(mean / sqrt(CASE WHEN s2 > 0 THEN s2 / n / n END) * sqrt((n + 1 - 4 + CAST(2 AS DOUBLE) / n) / n), 6) AS stat, n FROM s""")
def diebold_mariano(spark, d):
    f = forecasts(spark, d).withColumn("e1", F.col("realized") - F.col("m1")).withColumn("e2", F.col("realized") - F.col("m2"))
    return C.diebold_mariano(f, ["code"], "date", "e1", "e2", 2).withColumn("stat", F.round("stat", 6))


@query(f"""WITH {FORECASTS}, x AS (SELECT code, date, realized AS y, unnest([m1, m2, m3]) AS x FROM g), a AS (SELECT code, date, any_value(y) AS y, avg(abs(x - y)) AS near, avg(CASE WHEN x <= y THEN CAST(1 AS DOUBLE) ELSE 0 END) AS pit FROM x GROUP BY 1, 2),
p AS (SELECT i.code, i.date, sum(abs(i.x - j.x)) AS spread FROM x i JOIN x j USING (code, date) GROUP BY 1, 2)
SELECT code, date, round(near - spread / 12, 6) AS crps_fair, round(near - spread / 18, 6) AS crps, round(pit, 6) AS pit FROM a JOIN p USING (code, date)""")
def crps_ensembles(spark, d):
    draws, y = F.array("m1", "m2", "m3"), F.col("realized")
    return forecasts(spark, d).select("code", "date", F.round(C.crps_ensemble(y, draws, True), 6).alias("crps_fair"), F.round(C.crps_ensemble(y, draws, False), 6).alias("crps"), F.round(C.pit(y, draws), 6).alias("pit"))


@query("""SELECT toxic, count(*) AS n, round(avg(power(CAST(0.3 AS DOUBLE) + CAST(0.4 AS DOUBLE) * quality - toxic, 2)), 8) AS brier FROM labels GROUP BY 1""")
def brier_score(spark, d):
    return src.table(spark, d, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.round(F.avg(C.brier(F.col("toxic"), 0.3 + 0.4 * F.col("quality"))), 8).alias("brier"))


@query()
def crps_gaussian(spark, d):
    w = Window.partitionBy("code")
    t = src.trade_wide(spark, d).select("code", "date", "orders", F.avg("orders").over(w).alias("mu"), F.stddev_samp("orders").over(w).alias("sd"))
    return t.select("code", "date", C.crps_gaussian(F.col("orders"), F.col("mu"), F.col("sd")).alias("crps"), C.log_score_gaussian(F.col("orders"), F.col("mu"), F.col("sd")).alias("log_score"))


def logs(df):
    return df.select("code", "date", F.log("revenue").alias("y"), F.log("orders").alias("x"))


LOGS = f"{TRADE}, s AS (SELECT code, date, ln(revenue) AS y, ln(orders) AS x FROM trade)"


def _lp_sql(h_max=4):
    lags = " + ".join(f"CASE WHEN {l} <= h + 1 THEN 2 * (1 - {l} / CAST(h + 2 AS DOUBLE)) * coalesce(sum(q * q{l}), 0) ELSE 0 END" for l in range(1, h_max + 2))
    cols = ", ".join(f"lag(q, {l}) OVER o AS q{l}" for l in range(1, h_max + 2))
    return f"""WITH {LOGS}, k AS (SELECT unnest(range({h_max + 1})) AS h), n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS t FROM s),
d AS (SELECT a.code, a.date, h, a.x, b.y - c.y AS dy FROM n a, k, n b, n c WHERE b.code = a.code AND c.code = a.code AND b.t = a.t + h AND c.t = a.t - 1),
f AS (SELECT code, h, regr_slope(dy, x) AS beta, regr_intercept(dy, x) AS a, avg(x) AS mx, regr_sxx(dy, x) AS sxx, count(*) AS n FROM d GROUP BY 1, 2),
q AS (SELECT d.code, d.h, date, beta, n, (x - mx) / sxx * (dy - a - beta * x) AS q FROM d JOIN f ON d.code = f.code AND d.h = f.h),
l AS (SELECT *, {cols} FROM q WINDOW o AS (PARTITION BY code, h ORDER BY date)),
v AS (SELECT code, h, any_value(beta) AS beta, any_value(n) AS n, sum(q * q) + {lags} AS v FROM l GROUP BY code, h)
SELECT code, CAST(h AS INT) AS h, round(beta, 6) AS beta, round(sqrt(greatest(v, 0)), 6) AS se, n FROM v"""


@query(_lp_sql())
def lp_simple(spark, d):
    out = G.lp_hac(logs(src.trade_wide(spark, d)), ["code"], "date", "y", "x", list(range(5)), 0)
    return out.select("code", "h", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), "n")


REGION = f"""region_trade AS (SELECT r_name AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(count(*) AS DOUBLE) AS orders
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), s AS (SELECT code, date, ln(revenue) AS y, ln(orders) AS x FROM region_trade)"""


def rounded(df, digits: int = 5):
    """An estimate's columns, rounded as in its SQL."""
    return df.withColumns({c: F.round(c, digits - 2 * (c == "t")) for c in ("beta", "se", "t", "lo", "hi") if c in df.columns})


def _lp(hs, n_lags, se, most, source="s", extra=(), regressors=None, target="x"):
    design, xs = projections(source, hs, n_lags, extra)
    return f"d AS ({design}), " + partialled("q", "d", ["code", "h"], "dy", regressors(xs) if regressors else xs, target)


@query(f"WITH {REGION}, {_lp(list(range(9)), 2, 'hac', 9)} {result('q', ['code', 'h'], 'hac', 'h + 1', 9)}")
def lp_hac(spark, d):
    return rounded(G.lp_hac(logs(src.region_wide(spark, d)), ["code"], "date", "y", "x", list(range(9)), 2))


@query(f"WITH {REGION}, {_lp([0, 1, 2, 4], 6, 'hc0', 0)} {result('q', ['code', 'h'], 'hc0')}")
def la_lp(spark, d):
    return rounded(G.la_lp(logs(src.region_wide(spark, d)), ["code"], "date", "y", "x", [0, 1, 2, 4], 2))


def _asymmetric_sql():
    design, xs = projections("c", [0, 1, 2, 4], 1)
    parts = [partialled(f"q_{s}", "e", ["code", "h"], "dy", ["pos", "neg", *xs[1:]], s) for s in ("pos", "neg")]
    out = " UNION ALL ".join(f"SELECT *, '{s}' AS sign FROM ({result(f'q_{s}', ['code', 'h'], 'hac', 'h + 1', 5)})" for s in ("pos", "neg"))
    return f"WITH {REGION}, c AS (SELECT code, date, y, x - avg(x) OVER (PARTITION BY code) AS x FROM s), d AS ({design}), e AS (SELECT *, greatest(x, 0) AS pos, least(x, 0) AS neg FROM d WHERE x IS NOT NULL), {', '.join(parts)} {out}"


@query(_asymmetric_sql())
def lp_asymmetric(spark, d):
    w = Window.partitionBy("code")
    t = logs(src.region_wide(spark, d)).withColumn("x", F.col("x") - F.avg("x").over(w))
    return rounded(G.lp_asymmetric(t, ["code"], "date", "y", "x", [0, 1, 2, 4], 1))


def _state_sql():
    design, xs = projections("c", [0, 1, 2, 4], 1, ("z",))
    parts = [partialled(f"q_{s}", "e", ["code", "h"], "dy", ["high", "low", *xs[1:]], s) for s in ("high", "low")]
    out = " UNION ALL ".join(f"SELECT *, '{s}' AS state FROM ({result(f'q_{s}', ['code', 'h'], 'hac', 'h + 1', 5)})" for s in ("high", "low"))
    rows = " AND ".join(f"{c} IS NOT NULL" for c in ("dy", "z", *xs))
    return f"""WITH {REGION}, c AS (SELECT *, lag(y) OVER (PARTITION BY code ORDER BY date) AS z FROM s), d AS ({design}), f AS (SELECT *, 1 / (1 + exp(-3 * (z - avg(z) OVER w) / stddev_pop(z) OVER w)) AS f FROM d WHERE {rows} WINDOW w AS (PARTITION BY code, h)),
e AS (SELECT *, f * x AS high, (1 - f) * x AS low FROM f), {', '.join(parts)} {out}"""


@query(_state_sql())
def lp_state_dependent(spark, d):
    t = logs(src.region_wide(spark, d)).withColumn("z", F.lag("y", 1).over(Window.partitionBy("code").orderBy("date")))
    return rounded(G.lp_state(t, ["code"], "date", "y", "x", "z", [0, 1, 2, 4], 1))


def _iv_sql():
    design, xs = projections("c", [0, 1, 2, 4], 1, ("z",))
    rest, keys = xs[1:], ["code", "h"]
    rows = " AND ".join(f"{c} IS NOT NULL" for c in ("dy", "z", *xs))
    first = partialled("a", "e", keys, "x", ["z", *rest], "z")
    f = result("a", keys, "hac", "h + 1", 5).replace("n FROM (SELECT", "n, beta * beta / greatest(v, 0) AS f FROM (SELECT", 1)
    second = partialled("q", "g", keys, "dy", ["fitted", *rest], "fitted")
    main = result("q", keys, "hac", "h + 1", 5)
    return f"""WITH {REGION}, c AS (SELECT *, ln(exp(x) + 10 * (month(date) % 3)) AS z FROM s), d AS ({design}), e AS (SELECT * FROM d WHERE {rows}), {first},
g AS (SELECT e.*, e.x - a.u AS fitted FROM e JOIN a ON e.code = a.code AND e.h = a.h AND e.date = a.date), {second}
SELECT m.*, round(f.f, 3) AS first_stage_f FROM ({main}) m JOIN ({f}) f ON m.code = f.code AND m.h = f.h"""


@query(_iv_sql())
def lp_iv(spark, d):
    t = logs(src.region_wide(spark, d)).withColumn("z", F.log(F.exp("x") + 10 * (F.month("date") % 3)))
    return rounded(G.lp_iv(t, ["code"], "date", "y", "x", "z", [0, 1, 2, 4], 1)).withColumn("first_stage_f", F.round("first_stage_f", 3))


@query()
def panel_lp(spark, d):
    return G.panel_lp(logs(src.trade_wide(spark, d)), "code", "date", "y", "x", [0, 1, 2, 4], 2)


@query()
def panel_lp_dk(spark, d):
    return G.panel_lp(logs(src.trade_wide(spark, d)), "code", "date", "y", "x", [0, 1, 2, 4], 2, se="dk")


def _mean_group_sql():
    design, xs = projections("s", [0, 1, 2, 4], 1)
    one = f"SELECT code, h, any_value(beta) AS beta, any_value(n) AS n FROM q GROUP BY 1, 2"
    return f"""WITH {LOGS}, d AS ({design}), {partialled("q", "d", ["code", "h"], "dy", xs, "x")}, o AS ({one}), g AS (SELECT h, avg(beta) AS beta, stddev_samp(beta) / sqrt(count(*)) AS se, count(*) AS n FROM o WHERE n >= 30 GROUP BY 1)
SELECT h, round(beta, 5) AS beta, round(se, 5) AS se, n, round(beta - {Z} * se, 5) AS lo, round(beta + {Z} * se, 5) AS hi FROM g"""


@query(_mean_group_sql())
def mean_group_lp(spark, d):
    return rounded(G.mean_group(logs(src.trade_wide(spark, d)), "code", "date", "y", "x", [0, 1, 2, 4], 1))


def _cce_sql():
    design, xs = projections("c", [0, 1, 2], 1, ("m_y", "m_x"))
    cols = ["dy", *xs, "m_y", "m_x"]
    rows = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    within = ", ".join(f"{c} - avg({c}) OVER w AS {c}" for c in cols)
    return f"""WITH {LOGS}, c AS (SELECT *, avg(y) OVER w AS m_y, avg(x) OVER w AS m_x FROM s WINDOW w AS (PARTITION BY date)), d AS ({design}), e AS (SELECT code, h, date, {within} FROM d WHERE {rows} WINDOW w AS (PARTITION BY code, h)),
{partialled("q", "e", ["h"], "dy", cols[1:], "x", ("code", "date"), constant=False)} {result("q", ["h"], "cluster")}"""


@query(_cce_sql())
def cce_lp(spark, d):
    return rounded(G.cce_lp(logs(src.trade_wide(spark, d)), "code", "date", "y", "x", [0, 1, 2], 1))


UNITS = """q AS (SELECT o_custkey AS unit, CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INT) AS time, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y, min(CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice > 200000 THEN 1 END) AS hit FROM orders GROUP BY 1, 2),
u AS (SELECT unit, min(CASE WHEN hit = 1 AND time >= 4 THEN time END) AS treat_time FROM q GROUP BY 1), span AS (SELECT min(time) AS lo, max(time) AS hi FROM q), grid AS (SELECT unit, treat_time, CAST(unnest(range(lo, hi + 1)) AS INT) AS time FROM u, span),
panel AS (SELECT grid.unit, grid.time, treat_time, coalesce(y, 0) AS y FROM grid LEFT JOIN q ON q.unit = grid.unit AND q.time = grid.time)"""


def units(spark, d):
    """Customers by quarter, zero-filled; treated from the first large urgent order after a year."""
    o = src.table(spark, d, "orders")
    q = o.groupBy(F.col("o_custkey").alias("unit"), ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).alias("time")).agg(src.exact_sum("o_totalprice").alias("y"), F.max(F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_totalprice") > 200000), 1)).alias("hit"))
    u = q.groupBy("unit").agg(F.min(F.when((F.col("hit") == 1) & (F.col("time") >= 4), F.col("time"))).alias("treat_time"))
    span = q.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))  # one row
    grid = u.join(F.broadcast(span)).select("unit", "treat_time", F.explode(F.sequence("lo", "hi")).alias("time"))
    return grid.join(q.select("unit", "time", "y"), ["unit", "time"], "left").na.fill(0.0, ["y"])


ATT = f"""{UNITS}, cells AS (SELECT treat_time AS g, time AS t, avg(y) AS m, count(*) AS n FROM panel GROUP BY 1, 2),
att AS (SELECT a.g, a.t, (a.m - b.m) - (c.m - e.m) AS att, a.n FROM cells a JOIN cells b ON b.g = a.g AND b.t = a.g - 1 JOIN cells c ON c.g IS NULL AND c.t = a.t JOIN cells e ON e.g IS NULL AND e.t = a.g - 1 WHERE a.t >= a.g - 1)"""


@query(f"WITH {ATT} SELECT g, t, round(att, 6) AS att, n FROM att")
def did_att_gt(spark, d):
    return D.att_gt(units(spark, d)).withColumn("att", F.round("att", 6) + 0.0)


@query(f"WITH {ATT} SELECT t - g AS e, round(avg(att), 4) AS att, count(*) AS cells FROM att GROUP BY 1")
def did_event_study(spark, d):
    return D.event_study(D.att_gt(units(spark, d))).withColumn("att", F.round("att", 4) + 0.0)


@query(f"WITH {ATT} SELECT t - g AS e, round(sum(att * n) / sum(n), 4) AS att, count(*) AS cells FROM att GROUP BY 1")
def did_sun_abraham(spark, d):
    return D.event_study(D.att_gt(units(spark, d)), weighted=True).withColumn("att", F.round("att", 4) + 0.0)


@query(f"""WITH {UNITS}, l AS (SELECT time, y - lag(y) OVER w AS dy, CASE WHEN treat_time <= time THEN 1 ELSE 0 END AS d, lag(CASE WHEN treat_time <= time THEN 1 ELSE 0 END) OVER w AS before FROM panel WINDOW w AS (PARTITION BY unit ORDER BY time)),
p AS (SELECT time, avg(CASE WHEN d = 1 THEN dy END) AS s, count(CASE WHEN d = 1 THEN 1 END) AS n, avg(CASE WHEN d = 0 THEN dy END) AS c FROM l WHERE dy IS NOT NULL AND before = 0 GROUP BY 1)
SELECT round(sum((s - c) * n) / sum(n), 4) AS did, CAST(sum(n) AS BIGINT) AS n_switchers FROM p WHERE s IS NOT NULL AND c IS NOT NULL""")
def did_switchers(spark, d):
    return D.switchers(units(spark, d)).withColumn("did", F.round("did", 4))


@query()
def did_imputation(spark, d):
    return D.imputation(units(spark, d))


@query()
def lp_did(spark, d):
    return G.lp_did(units(spark, d), "unit", "time", "y", "treat_time", [-2, -1, 0, 1, 2])


_ADF = f"""WITH {REGION}, a AS (SELECT code, date, lag(y) OVER w AS level, y - lag(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY code ORDER BY date)), b AS (SELECT *, lag(dy, 1) OVER w AS l1, lag(dy, 2) OVER w AS l2 FROM a WINDOW w AS (PARTITION BY code ORDER BY date)),
{partialled("q", "b", ["code"], "dy", ["level", "l1", "l2"], "level")}"""


@query(f"{_ADF} SELECT code, beta AS rho, t AS adf_t, n FROM ({result('q', ['code'], 'classical')})")
def adf_test(spark, d):
    a = T.adf(logs(src.region_wide(spark, d)), ["code"], "date", "y", 2)
    return a.select("code", F.round("rho", 5).alias("rho"), F.round("adf_t", 3).alias("adf_t"), "n")


@query(f"""WITH {LOGS}, q AS (SELECT code, date, y - avg(y) OVER (PARTITION BY code) AS q FROM s), r AS (SELECT *, sum(q) OVER w AS p, lag(q) OVER w AS q1, lag(q, 2) OVER w AS q2, lag(q, 3) OVER w AS q3, lag(q, 4) OVER w AS q4 FROM q WINDOW w AS (PARTITION BY code ORDER BY date)),
v AS (SELECT code, count(*) AS n, sum(p * p) AS ss, (sum(q * q) + CAST(1.6 AS DOUBLE) * sum(q * q1) + CAST(1.2 AS DOUBLE) * sum(q * q2) + CAST(0.8 AS DOUBLE) * sum(q * q3) + CAST(0.4 AS DOUBLE) * sum(q * q4)) / count(*) AS lrv FROM r GROUP BY 1)
SELECT code, round(ss / (n * n * lrv), 6) AS kpss, n FROM v""")
def kpss_test(spark, d):
    return T.kpss(logs(src.trade_wide(spark, d)), ["code"], "date", "y").withColumn("kpss", F.round("kpss", 6))


@query(f"""WITH {REGION}, b AS (SELECT code, date, y, lag(y, 8) OVER w AS x0, lag(y, 9) OVER w AS x1, lag(y, 10) OVER w AS x2, lag(y, 11) OVER w AS x3 FROM s WINDOW w AS (PARTITION BY code ORDER BY date)),
{partialled("q", "b", ["code"], "y", ["x0", "x1", "x2", "x3"], "x0")} SELECT code, date, round(b.y - q.u, 5) AS trend, round(q.u, 5) AS cycle FROM q JOIN b USING (code, date)""")
def hamilton_filter(spark, d):
    h = T.hamilton(logs(src.region_wide(spark, d)), ["code"], "date", "y")
    return h.select("code", "date", F.round("trend", 5).alias("trend"), F.round("cycle", 5).alias("cycle"))


@query(f"""WITH {REGION}, b AS (SELECT code, date, y, x, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY code ORDER BY date)), c AS (SELECT * FROM b WHERE y2 IS NOT NULL AND x2 IS NOT NULL),
{partialled("r", "c", ["code"], "y", ["y1", "y2"], "y1")}, {partialled("u", "c", ["code"], "y", ["y1", "y2", "x1", "x2"], "y1")}, a AS (SELECT code, sum(u * u) AS r FROM r GROUP BY 1), e AS (SELECT code, sum(u * u) AS u, count(*) - 5 AS df2 FROM u GROUP BY 1)
SELECT code, round((a.r - e.u) / 2 / (e.u / df2), 4) AS f_stat, CAST(2 AS INT) AS df1, df2 FROM a JOIN e USING (code)""")
def granger_causality(spark, d):
    return T.granger(logs(src.region_wide(spark, d)), ["code"], "date", "y", "x", 2).withColumn("f_stat", F.round("f_stat", 4))


@query(f"""WITH {DAILY}, b AS (SELECT code, date, lead(rv) OVER w AS next, rv AS d1, CASE WHEN count(rv) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING) = 5 THEN avg(rv) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING) END AS d5,
CASE WHEN count(rv) OVER (PARTITION BY code ORDER BY date ROWS 21 PRECEDING) = 22 THEN avg(rv) OVER (PARTITION BY code ORDER BY date ROWS 21 PRECEDING) END AS d22 FROM daily WINDOW w AS (PARTITION BY code ORDER BY date)),
{partialled("q", "b", ["code"], "next", ["d1", "d5", "d22"], "d1")} {result("q", ["code"], "hac", "5", 5)}""")
def har_regression(spark, d):
    return rounded(T.har(daily(spark, d), ["code"], "date", "rv"))


@query()
def hp_filter(spark, d):
    return T.hp_filter(logs(src.region_wide(spark, d)), ["code"], "date", "y", 14400.0)


@query()
def garch_path(spark, d):
    w = Window.partitionBy("code").orderBy("date")
    r = daily(spark, d).select("code", "date", (F.log("rv") - F.log(F.lag("rv").over(w))).alias("r"))
    return T.garch_path(r, ["code"], "date", "r", 0.05, 0.1, 0.8)


def system(spark, d):
    """Monthly log revenue of each region, side by side."""
    return logs(src.region_wide(spark, d)).groupBy("date").pivot("code", REGIONS).agg(F.first("y")).dropna()


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query()
def var_irf(spark, d):
    import numpy as np

    _, a, sigma, _ = T.var_ols(system(spark, d), "date", REGIONS, 1)
    return T.tidy(spark, REGIONS, T.moving_average(a, 8) @ np.linalg.cholesky(sigma), "irf")


@query()
def var_fevd(spark, d):
    import numpy as np

    _, a, sigma, _ = T.var_ols(system(spark, d), "date", REGIONS, 1)
    return T.tidy(spark, REGIONS, T.fevd(T.moving_average(a, 8) @ np.linalg.cholesky(sigma)), "share")


@query()
def spillover_index(spark, d):
    _, a, sigma, _ = T.var_ols(system(spark, d), "date", REGIONS, 1)
    total, to, frm = T.spillover(T.gfevd(T.moving_average(a, 10), sigma)[-1])
    return spark.createDataFrame([(n, float(to[i]), float(frm[i]), float(to[i] - frm[i]), float(total)) for i, n in enumerate(REGIONS)], "code string, to_others double, from_others double, net double, total double")


@query()
def common_factor(spark, d):
    s = system(spark, d)
    loadings, _, mean, sd = T.principal_component(s, REGIONS)
    return s.select("date", T.factor(REGIONS, loadings[:, 0], mean, sd).alias("factor"))
