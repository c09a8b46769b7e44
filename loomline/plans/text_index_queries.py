"""Queries over the driver's documents that apply the named text indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import text_indices as N
from .estimator_queries import RECORDS, TERMS, records

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The groups of terms that the indices' lexicons have; ltui_up and ltui_down differ in the one of their polarity.
GROUPS = ["labor_domain", "uncertainty_tone", "tech_domain", "war_domain", "wage_domain", "polarity_up", "polarity_down", "economy", "policy", "uncertainty", "gpr", "mpu", "wui", "hawkish", "dovish"]
#: Terms of a group and language in the table that the queries make: the invented languages have no lexicon of their own.
TERMS_EACH = 6
KNOWN = ["en", "de", "fr", "es"]


def _group(name: str, group: str) -> str:
    return f"polarity_{name.rpartition('_')[2]}" if group == "polarity" else group


def lexicon_table(spark, d) -> DataFrame:
    """index, language, term_group, term: each language's most frequent words, dealt out to the groups by rank."""
    r = records(spark, d)
    language = F.when(F.col("lang").isin(*KNOWN), F.col("lang")).otherwise("en")
    words = r.select(language.alias("language"), F.explode(F.expr(r"regexp_extract_all(lower(text), '(?U)\\w+', 0)")).alias("term"))
    counts = words.groupBy("language", "term").count()
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("count"), "term"))).where(F.col("k") <= len(GROUPS) * TERMS_EACH)
    group = F.element_at(F.array(*map(F.lit, GROUPS)), ((F.col("k") - 1) % len(GROUPS) + 1).cast("int"))
    of = spark.createDataFrame([(n, g, _group(n, g)) for n, spec in N.SPECS.items() for g in spec.groups], "index string, term_group string, own string")
    return top.withColumn("own", group).join(F.broadcast(of), "own").select("index", "language", "term_group", "term")


_LEX = rf"""words AS (SELECT l, term, row_number() OVER (PARTITION BY l ORDER BY count(*) DESC, term) AS k FROM (SELECT CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'en' END AS l, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM records) GROUP BY l, term),
lex AS (SELECT l, {', '.join(f"list(term) FILTER (k <= {len(GROUPS) * TERMS_EACH} AND (k - 1) % {len(GROUPS)} = {i}) AS {g}" for i, g in enumerate(GROUPS))} FROM words GROUP BY l)"""


def _score_sql(name):
    spec = N.SPECS[name]
    groups = [_group(name, g) for g in spec.groups]
    words = lambda t: rf"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+')"
    n = lambda t, g: f"len(list_filter({words(t)}, lambda w: list_contains({g}, w)))"
    every = lambda t: "(" + " AND ".join(f"{n(t, g)} > 0" for g in groups) + ")"
    if spec.kernel == "count":
        return f"CAST({n('low', groups[0])} AS DOUBLE)"
    if spec.kernel == "per_thousand":
        return f"coalesce({n('low', groups[0])} * 1000 / CAST(nullif(len({words('low')}), 0) AS DOUBLE), 0)"
    if spec.kernel == "document":
        return f"CAST({every('low')} AS DOUBLE)"
    if spec.kernel == "tone":
        a, b = n("low", groups[0]), n("low", groups[1])
        return f"CASE WHEN {a} + {b} > 0 THEN ({a} - {b}) / CAST({a} + {b} AS DOUBLE) ELSE 0 END"
    size = f"1 + {n('p', groups[spec.weight])} / CAST(greatest(1, len({words('p')})) AS DOUBLE)" if spec.weight is not None else "CAST(1 AS DOUBLE)"
    parts = "sentences" if spec.kernel == "sentence" else "paragraphs"
    return f"coalesce(list_sum(list_transform({parts}, lambda p: CASE WHEN {every('p')} THEN {size} ELSE 0 END)) / nullif(len({parts}), 0), 0)"


def _value_sql(name):
    return {"raw": "value", "zscore": "(value - avg(value) OVER ()) / nullif(stddev_pop(value) OVER (), 0)", "bbd_100": "value * 100 / nullif(avg(value) OVER (), 0)"}[N.SPECS[name].normalisation]


def _texts_sql(source):
    """w: date, l, low, sentences, paragraphs, the terms' lists, and what else ``source`` has."""
    split = lambda cut: rf"list_filter(list_transform(string_split_regex(low, '{cut}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
    return rf"t AS (SELECT * EXCLUDE (text), coalesce(lower(text), '') AS low, CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'en' END AS l FROM {source}), w AS (SELECT *, {split(r'[.!?]+(?:\s+|$)')} AS sentences, {split(r'\n\s*\n+')} AS paragraphs FROM t JOIN lex USING (l))"


def _sql(name, source="records", extra=""):
    score = _score_sql(name)
    return f"""WITH {RECORDS.replace("AS url, lang", "AS url, lang, source")}, {_LEX}{extra}, {_texts_sql(source)}
SELECT '{name}' AS name, date, round({_value_sql(name)}, 5) AS value FROM (SELECT date, value FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 3 MONTH)) AS DATE) AS date FROM (SELECT CAST(date_trunc('quarter', date) AS DATE) AS date FROM w))
LEFT JOIN (SELECT CAST(date_trunc('quarter', date) AS DATE) AS date, avg({score}) AS value FROM w GROUP BY 1) USING (date))"""


def _index(spark, d, name, of):
    lexicon = N.lexicon_of(lexicon_table(spark, d), name)
    return N.index(of, name, lexicon, F.col("lang"), negation=False).select(F.lit(name).alias("name"), "date", F.round("value", 5).alias("value"))


def _register(name, choose=None, source="records", extra=""):
    def run(spark, d):
        r = records(spark, d)
        return _index(spark, d, name, choose(r) if choose else r)

    run.__name__ = f"index_{name}"
    QUERIES[run.__name__], ORACLE[run.__name__] = run, _sql(name, source, extra)


for _name in ("lui", "epu", "gpr", "mpu", "wui", "tone", "ltui", "ltui_up", "ltui_down", "lwui", "lwui_wage"):
    _register(_name)


def _corpus(where):
    return f", corpus AS (SELECT * FROM records WHERE {where})"


#: Official documents: of one language, of chapters or titles that hold a word, of one kind.
_register("eurlex_ui", lambda r: N.having(r, {"lang": "DE"}), "corpus", _corpus("lang = 'de'"))
_register("ep_ui", lambda r: N.having(r, {"lang": "fr"}), "corpus", _corpus("lang = 'fr'"))
_register("erpui", lambda r: N.having(r, containing={"source": "SRC1"}), "corpus", _corpus("contains(source, 'src1')"))
_register("sotuui", lambda r: N.having(r, {"source": "src2"}), "corpus", _corpus("source = 'src2'"))
_register("cboui", lambda r: N.having(r, {"lang": "en"}, {"source": "7"}), "corpus", _corpus("lang = 'en' AND contains(source, '7')"))


def _by_district(records_, lexicon):
    r = records_.withColumn("district", F.col("metadata")["source"])
    return N.district_panel(r, "bbui", lexicon, F.col("lang"), "district", "lang", negation=False).withColumn("value", F.round("value", 5))


def index_bbui(spark, d):
    """Sources as districts, each against its own history."""
    return _by_district(records(spark, d), N.lexicon_of(lexicon_table(spark, d), "bbui"))


QUERIES["index_bbui"] = index_bbui
ORACLE["index_bbui"] = f"""WITH {RECORDS.replace("AS url, lang", "AS url, lang, source")}, {_LEX}, {_texts_sql("records")},
q AS (SELECT source AS district, CAST(date_trunc('quarter', date) AS DATE) AS date, avg({_score_sql("bbui")}) AS value, count(*) AS n_docs, count(DISTINCT lang) AS n_sections FROM w WHERE source IS NOT NULL GROUP BY 1, 2),
span AS (SELECT district, CAST(unnest(generate_series(min(date), max(date), INTERVAL 3 MONTH)) AS DATE) AS date FROM q GROUP BY 1)
SELECT district, date, round((value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0), 5) AS value, coalesce(n_docs, 0) AS n_docs, coalesce(n_sections, 0) AS n_sections FROM span LEFT JOIN q USING (district, date) WINDOW p AS (PARTITION BY district)"""


def index_bluesky_ui(spark, d):
    """Sources as actors, whose texts of a month are one."""
    posts = N.actor_months(records(spark, d), F.col("metadata")["source"])
    return _index(spark, d, "bluesky_ui", posts.withColumn("lang", F.lit("en")))


QUERIES["index_bluesky_ui"] = index_bluesky_ui
ORACLE["index_bluesky_ui"] = _sql("bluesky_ui", "posts", ", posts AS (SELECT source, CAST(date_trunc('month', date) AS DATE) AS date, 'en' AS lang, coalesce(string_agg(text, chr(10) ORDER BY date, url), '') AS text FROM records GROUP BY source, 2)")


def index_negated(spark, d):
    """Sentence scores of each document with negations."""
    lexicon = {lang: {"labor_domain": t["economy"], "uncertainty_tone": t["doubt"], "phrases": [" ".join(t["policy"])]} for lang, t in TERMS.items()}
    return N.scored(records(spark, d), "lui", lexicon, F.col("lang")).select("url", F.round("score", 6).alias("score"))


QUERIES["index_negated"] = index_negated
