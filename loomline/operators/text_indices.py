"""Named indices of texts: each a kernel over a lexicon's groups of terms, by quarter, normalised.

A lexicon is {language: {group: [terms]}}, kept as a table (index, language, term_group, term) and read by
``lexicon_of``; the lists themselves are data, not code. A record's score goes by its own language.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import UNSPACED, balance, by_language, index_quarterly, normalise, term_pattern, term_patterns

Lexicon = dict[str, dict[str, list[str]]]

#: Words that undo a term up to four words later.
NEGATIONS = {
    "en": "not no never neither nor without hardly barely scarcely rarely seldom cannot fail fails failed failing dont isnt arent wasnt werent wont cant".split(),
    "de": "nicht kein keine keiner keinen keinem keines nie niemals weder noch ohne kaum schwerlich".split(),
    "fr": "pas ne non ni sans jamais aucun aucune guère peu".split(),
    "es": "no nunca jamás ni sin tampoco apenas difícilmente raramente deja deje dejó dejan fracas fracasa fracasó".split(),
    "it": "non no né ne mai senza nessun nessuno appena raramente".split(),
    "pt": "não nao nunca jamais nem sem tampouco mal raramente dificilmente deixa deixe deixou fracass fracassa fracassou".split(),
    "ja": ["ない", "なく", "なかっ", "ません", "ぬ", "ぬる"], "zh": list("不没无未非莫勿"),
}


class Spec(NamedTuple):
    """``kernel``: count, per_thousand, document, sentence, paragraph or tone; ``weight``: the group whose density counts."""

    kernel: str
    groups: tuple[str, ...]
    normalisation: str = "zscore"
    negation: bool = True
    weight: int | None = None


_LABOUR = ("labor_domain", "uncertainty_tone")
_SENTENCE = Spec("sentence", _LABOUR)
#: The indices' kernels, groups and normalisations.
SPECS = {
    "bbui": _SENTENCE, "bluesky_ui": _SENTENCE, "eurlex_ui": _SENTENCE, "ep_ui": _SENTENCE, "erpui": _SENTENCE, "sotuui": _SENTENCE, "cboui": _SENTENCE, "lui": _SENTENCE,
    "epu": Spec("document", ("economy", "policy", "uncertainty"), "bbd_100", False),
    "gpr": Spec("count", ("gpr",), negation=False), "mpu": Spec("count", ("mpu",), negation=False), "wui": Spec("per_thousand", ("wui",), negation=False),
    "tone": Spec("tone", ("hawkish", "dovish"), "raw", False),
    "ltui": Spec("paragraph", (*_LABOUR, "tech_domain"), weight=2), "ltui_up": Spec("paragraph", (*_LABOUR, "tech_domain", "polarity"), weight=2), "ltui_down": Spec("paragraph", (*_LABOUR, "tech_domain", "polarity"), weight=2),
    "lwui": Spec("paragraph", (*_LABOUR, "war_domain"), weight=2), "lwui_wage": Spec("paragraph", (*_LABOUR, "wage_domain"), weight=2),
}


def lexicon_of(table: DataFrame, index: str) -> Lexicon:
    """The terms of one index from a table (index, language, term_group, term): a few thousand rows."""
    out: Lexicon = {}
    for r in table.where(F.col("index") == index).select("language", "term_group", "term").distinct().collect():
        out.setdefault(r.language, {}).setdefault(r.term_group, []).append(r.term)
    return out


def unnegated_pattern(term: str, language: str) -> str:
    """A term that no negation precedes: within four words, or thirty characters where words aren't set apart."""
    own, marks = term_pattern(term, language), NEGATIONS.get(language)
    if not marks:
        return own
    some = "|".join(marks)
    if language in UNSPACED:
        return rf"(?<!(?:{some})(?s:.{{0,29}})){own}"
    # one look behind for each distance, as Java wants to see how long they can be
    word = r"\W{1,16}\w{1,24}"
    behind = "".join(rf"(?<!\b(?:{some})\b{word * n}\W{{1,16}})" for n in range(4))
    return rf"(?U)(?={own}){behind}{own}"


def _patterns(terms: list[str], language: str, negation: bool) -> list[str]:
    return [unnegated_pattern(t, language) for t in sorted(set(terms))] if negation else term_patterns(list(set(terms)), language)


def hits(text: Column, terms: list[str], language: str = "en", negation: bool = False) -> Column:
    """Matches of each term, phrases too, summed; ``text`` in lower case."""
    return sum((F.regexp_count(text, F.lit(p)) for p in _patterns(terms, language, negation)), F.lit(0))


def holds(text: Column, terms: list[str], language: str = "en", negation: bool = False) -> Column:
    """Whether ``text``, in lower case, has a term: the first match is enough."""
    return text.rlike("|".join(f"(?:{p})" for p in _patterns(terms, language, negation))) if terms else F.lit(False)


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def windows(text: Column, unit: str, language: str = "en") -> Column:
    """Sentences or paragraphs that aren't empty."""
    if unit == "sentence":
        cut = "[。！？]+" if language in ("zh", "ja") else r"[.!?]+(?:\s+|$)"
    else:
        cut = r"(?:\n\s*\n+)|　{2,}" if language in ("zh", "ja") else r"\n\s*\n+"
    return F.filter(F.transform(F.split(text, cut), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def matched(text: Column, groups: list[list[str]], unit: str, language: str = "en", negation: bool = False, weight: int | None = None, phrases: list[str] | None = None) -> Column:
    """Share of a text's windows with a term of every group, or with a phrase; with ``weight``, each counts one more than
    that group's hits in it per word. 0 without windows."""
    def score(w: Column) -> Column:
        every = F.lit(True)
        for g in groups:
            every = every & holds(w, g, language, negation)
        if phrases:
            every = every | holds(w, phrases, language, negation)
        size = 1.0 if weight is None else 1.0 + hits(w, groups[weight], language, negation) / F.greatest(F.lit(1), tokens(w))
        return F.when(every, size).otherwise(0.0)

    parts = windows(text, unit, language)
    return F.get(F.transform(F.array(parts), lambda p: F.coalesce(F.try_divide(F.aggregate(F.transform(p, score), F.lit(0.0), lambda a, b: a + b), F.size(p)), F.lit(0.0))), 0)


def score(text: Column, spec: Spec, terms: dict[str, list[str]], language: str, negation: bool | None = None) -> Column:
    """A text's score by one language's terms; groups that the lexicon lacks match nothing."""
    negation = spec.negation if negation is None else negation
    low, groups = F.lower(F.coalesce(text, F.lit(""))), [terms.get(g, []) for g in spec.groups]
    if spec.kernel == "count":
        return hits(low, groups[0], language, negation).cast("double")
    if spec.kernel == "per_thousand":
        return F.coalesce(F.try_divide(hits(low, groups[0], language, negation) * 1000.0, tokens(low)), F.lit(0.0))
    if spec.kernel == "document":
        every = F.lit(True)
        for g in groups:
            every = every & holds(low, g, language, negation)
        return every.cast("double")
    if spec.kernel == "tone":
        return balance(hits(low, groups[0], language), hits(low, groups[1], language))
    return matched(low, groups, spec.kernel, language, negation, spec.weight, terms.get("phrases") if spec.kernel == "sentence" else None)


def scored(records: DataFrame, name: str, lexicon: Lexicon, language: Column, default: str = "en", negation: bool | None = None) -> DataFrame:
    """``records`` with ``score``, by each record's language."""
    forms = {lang: score(F.col("text"), SPECS[name], terms, lang, negation) for lang, terms in lexicon.items()}
    return records.withColumn("score", by_language(language, forms, default if default in forms else next(iter(forms))))


def index(records: DataFrame, name: str, lexicon: Lexicon, language: Column, how: str = "mean", negation: bool | None = None) -> DataFrame:
    """date (quarter), value of a named index over its records; quarters without any are null."""
    series = index_quarterly(scored(records, name, lexicon, language, negation=negation).select("date", "score"), how)
    return series if SPECS[name].normalisation == "raw" else normalise(series, SPECS[name].normalisation)


def by_group(records: DataFrame, name: str, lexicon: Lexicon, language: Column, group: str, negation: bool | None = None) -> DataFrame:
    """group, date, value: the quarterly means of a named index by district, country or actor, not normalised."""
    s = scored(records, name, lexicon, language, negation=negation)
    return s.groupBy(group, F.date_trunc("quarter", "date").cast("date").alias("date")).agg(F.avg("score").alias("value"), F.count("*").alias("n_docs"))


def having(records: DataFrame, equal: dict[str, str] | None = None, containing: dict[str, str] | None = None) -> DataFrame:
    """Records whose metadata have the given values (in any case of letters), or hold them; those that lack one go.

    What sets the indices of official documents apart: their language, type of act, chapter or title.
    """
    of = lambda k: F.lower(F.col("metadata")[k])
    tests = [of(k) == v.lower() for k, v in (equal or {}).items()] + [F.contains(of(k), F.lit(v.lower())) for k, v in (containing or {}).items()]
    for t in tests:
        records = records.where(t)
    return records


def district_panel(records: DataFrame, name: str, lexicon: Lexicon, language: Column, district: str, section: str, only: str | None = None, normalised: bool = True, negation: bool | None = None) -> DataFrame:
    """date (quarter), district, value, n_docs, n_sections: a named index of each district, against its own history.

    ``only`` keeps one section's records. Every district has all quarters between its first and last; value is null in those
    without a record, which have no documents. Records without a district go.
    """
    r = records.where(F.col(district).isNotNull())
    if only is not None:
        r = r.where(F.col(section) == only)
    s = scored(r, name, lexicon, language, negation=negation).withColumn("quarter", F.date_trunc("quarter", "date").cast("date"))
    q = s.groupBy(F.col(district).alias("district"), F.col("quarter").alias("date")).agg(F.avg("score").alias("value"), F.count("*").alias("n_docs"), F.count_distinct(section).alias("n_sections"))
    span = q.groupBy("district").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select("district", F.explode(F.sequence("lo", "hi", F.expr("interval 3 month"))).alias("date"))
    d = span.join(q, ["district", "date"], "left").na.fill(0, ["n_docs", "n_sections"])
    w = Window.partitionBy("district")
    return d.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w))) if normalised else d


def actor_months(records: DataFrame, actor: Column) -> DataFrame:
    """One record per actor and month with its posts' texts in order of date, as short posts have too few sentences.

    An actor's posts of a month are one row; a month of one account is small.
    """
    posts = F.array_sort(F.collect_list(F.struct("date", "url", "text")))
    g = records.groupBy(actor.alias("actor"), F.date_trunc("month", "date").cast("date").alias("date")).agg(posts.alias("p"), F.first("lang").alias("lang"))
    return g.select("actor", "date", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.concat(F.lit("actor://"), F.col("actor")).alias("url"), "lang")
