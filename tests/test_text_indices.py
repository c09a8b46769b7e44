"""Index kernels against plain Python on small texts."""

import re

import pytest
from pyspark.sql import functions as F

from loomline.operators import text_indices as N

TEXTS = [
    "Jobs are not uncertain. Labour worries rise, uncertain times!  Labour.\n\nThe war on labour is uncertain here.\n \nWar.", "No labour market doubts; never, in any real way, uncertain labour", "", None, "   ", "labour uncertain", "LABOUR Uncertain? v1.5 labour",
    "without labour uncertain words labour one two three four five uncertain",
]
GROUPS = [["labour", "jobs"], ["uncertain", "in any real"]]


def negated(text, at, language="en"):
    words = re.findall(r"\w+", text[max(0, at - 80) : at])
    return any(w in N.NEGATIONS[language] for w in words[-4:])


def hits(text, terms, negation):
    return sum(not (negation and negated(text, m.start())) for t in terms for m in re.finditer(r"\b" + re.escape(t) + r"\b", text))


def matched(text, unit, negation, weight=None):
    parts = [p.strip() for p in re.split(r"[.!?]+(?:\s+|$)" if unit == "sentence" else r"\n\s*\n+", (text or "").lower()) if p.strip()]
    score = lambda p: (1 + (hits(p, GROUPS[weight], negation) / max(1, len(re.findall(r"\w+", p))) if weight is not None else 0)) * all(hits(p, g, negation) for g in GROUPS)
    return sum(map(score, parts)) / len(parts) if parts else 0.0


@pytest.mark.parametrize("negation", [False, True])
def test_windows_and_negation(spark, negation):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    low = F.lower(F.coalesce("t", F.lit("")))
    got = df.select("i", N.hits(low, GROUPS[0] + GROUPS[1], "en", negation).alias("n"), N.matched(low, GROUPS, "sentence", "en", negation).alias("s"), N.matched(low, GROUPS, "paragraph", "en", negation, 1).alias("p")).collect()
    for r in got:
        t = (TEXTS[r.i] or "").lower()
        assert r.n == hits(t, GROUPS[0] + GROUPS[1], negation)
        assert abs(r.s - matched(t, "sentence", negation)) < 1e-12 and abs(r.p - matched(t, "paragraph", negation, 1)) < 1e-12


def test_unspaced_languages(spark):
    df = spark.createDataFrame([("不就业。就业不确定。很长很长的句子没有" + "一" * 40 + "就业不确定",)], "t string")
    r = df.select(N.hits(F.col("t"), ["就业"], "zh").alias("a"), N.hits(F.col("t"), ["就业"], "zh", True).alias("b"), N.matched(F.col("t"), [["就业"], ["确定"]], "sentence", "zh").alias("m")).first()
    assert (r.a, r.b) == (3, 1) and abs(r.m - 2 / 3) < 1e-12


def test_lexicon_table_language_and_groups(spark):
    table = spark.createDataFrame([("lui", "en", "labor_domain", "labour"), ("lui", "en", "uncertainty_tone", "uncertain"), ("lui", "de", "labor_domain", "arbeit"), ("lui", "de", "uncertainty_tone", "ungewiss"), ("epu", "en", "economy", "x")], "index string, language string, term_group string, term string")
    lex = N.lexicon_of(table, "lui")
    assert set(lex) == {"en", "de"} and lex["de"]["labor_domain"] == ["arbeit"]
    docs = spark.createDataFrame([("2020-01-05", "labour uncertain. rest", "en", "a"), ("2020-02-05", "arbeit ungewiss", "de", "b"), ("2020-05-05", "labour uncertain", None, "a"), ("2020-11-05", "nothing", "fr", "b")], "date string, text string, lang string, district string").withColumn("date", F.to_date("date")).withColumn("url", F.lit("u"))
    got = {str(r.date): r.value for r in N.by_group(docs, "lui", lex, F.col("lang"), "district").where("district = 'a'").collect()}
    assert got == {"2020-01-01": 0.5, "2020-04-01": 1.0}
    z = [r.value for r in N.index(docs, "lui", lex, F.col("lang")).orderBy("date").collect()]
    assert len(z) == 4 and z[2] is None and abs(sum(v for v in z if v is not None)) < 1e-12
    posts = N.actor_months(docs, F.col("district")).collect()
    assert len(posts) == 4 and {r.actor for r in posts} == {"a", "b"}


def test_corpora_and_districts(spark):
    rows = [("2020-01-05", "labour uncertain. rest", "en", "A", "labor"), ("2020-02-05", "nothing", "en", "A", "prices"), ("2020-08-05", "labour uncertain", "en", "A", "labor"), ("2020-01-05", "labour uncertain", "de", "Ab", "labor"), ("2020-01-05", "labour uncertain", None, None, "labor")]
    d = spark.createDataFrame(rows, "date string, text string, lang string, district string, section string").withColumn("date", F.to_date("date")).withColumn("url", F.lit("u")).withColumn("metadata", F.create_map(F.lit("lang"), "lang", F.lit("district"), "district"))
    count = lambda *a, **k: N.having(d, *a, **k).count()
    assert (count({"lang": "EN"}), count({"district": "a"}), count(containing={"district": "A"}), count({"lang": "en"}, {"district": "b"}), count({"act": "x"}), count()) == (3, 3, 4, 0, 0, 5)
    lex = {"en": {"labor_domain": ["labour"], "uncertainty_tone": ["uncertain"]}}
    got = {(r.district, str(r.date)): tuple(r)[2:] for r in N.district_panel(d, "bbui", lex, F.col("lang"), "district", "section", normalised=False).collect()}
    assert got == {("A", "2020-01-01"): (0.25, 2, 2), ("A", "2020-04-01"): (None, 0, 0), ("A", "2020-07-01"): (1.0, 1, 1), ("Ab", "2020-01-01"): (1.0, 1, 1)}
    z = {(r.district, str(r.date)): r.value for r in N.district_panel(d, "bbui", lex, F.col("lang"), "district", "section", only="labor").collect()}
    assert z == {("A", "2020-01-01"): -1.0, ("A", "2020-04-01"): None, ("A", "2020-07-01"): 1.0, ("Ab", "2020-01-01"): None}


def test_terms_are_counted_in_one_pass(spark):
    """Words are one expression, which counts what each of them did; phrases, signs and terms given twice keep their own."""
    from loomline.operators import text as X

    terms = ["labour", "Jobs", "in", "in any", "c++", "straße", "x_1", "²", "labour"]
    texts = [*TEXTS, "in any labour, in-in; labours c++ c++x x_1 x_12 straße m² ²", "é labouŕ in‍in in\n\nin", "LABOUR labour labour labour"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower(F.coalesce("t", F.lit(""))).alias("t"))
    each = lambda ts: sum((F.regexp_count("t", F.lit(X.term_pattern(t))) for t in ts), F.lit(0))
    rows = df.select(X.count_terms(F.col("t"), terms).alias("a"), each(terms).alias("b"), N.hits(F.col("t"), terms).alias("c"), each(set(terms)).alias("d"), N.holds(F.col("t"), terms).alias("e"), N.holds(F.col("t"), []).alias("f")).collect()
    assert all(r.a == r.b and r.c == r.d and r.e == (r.d > 0) and not r.f for r in rows) and sum(r.b for r in rows) > 20
    assert len(X.term_patterns([f"w{i}" for i in range(50)])) == 1 and len(X.term_patterns(["不", "没"], "zh")) == 2


@pytest.mark.parametrize(("name", "most"), [("tone", 4), ("ltui_up", 10), ("epu", 6)])
def test_each_text_is_scored_once(spark, name, most):
    """One scan, with an expression for each use of a group of terms (in a mean's sum and in its count), whatever the number of terms."""
    lex = {"en": {g: [f"{g[0]}{i}" for i in range(6)] for g in N.SPECS[name].groups}}
    docs = spark.createDataFrame([("2020-01-05", "e1 h1 p1 u1", "en"), ("2021-01-05", None, "en")], "date string, text string, lang string").withColumn("date", F.to_date("date"))
    d = N.index(docs, name, lex, F.col("lang"), negation=False)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("(?U)\\b") <= most
    rows = d.orderBy("date").collect()
    assert [str(r.date) for r in rows] == ["2020-01-01", "2020-04-01", "2020-07-01", "2020-10-01", "2021-01-01"] and all(r.value is None for r in rows[1:4])
    assert N.index(docs.where("false"), name, lex, F.col("lang")).count() == 0
