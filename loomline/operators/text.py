"""Text records (date, text, url, metadata, magnitude) to index values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import period

#: Languages whose words aren't set apart by spaces.
UNSPACED = ("zh", "ja", "ko")


def term_pattern(term: str, language: str = "en") -> str:
    import re

    quoted = "\\Q" + re.sub(r"\\E", r"\\E\\\\E\\Q", term.lower()) + "\\E"
    return quoted if language in UNSPACED else rf"(?U)\b{quoted}\b"


def term_patterns(terms: list[str], language: str = "en") -> list[str]:
    """Expressions whose matches add up to those of each term: two whole words never overlap, so all words are one."""
    rest = sorted(t.lower() for t in terms)
    words = [] if language in UNSPACED else sorted({t for t in rest if t and all(c == "_" or c.isalpha() or c.isdecimal() for c in t)})
    for w in words:
        rest.remove(w)  # a term given twice counts twice
    return [*([rf"(?U)\b(?:{'|'.join(words)})\b"] if words else []), *(term_pattern(t, language) for t in rest)]


def count_terms(text: Column, terms: list[str], language: str = "en") -> Column:
    """Matches of each term summed: a term inside another counts for both."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.regexp_count(low, F.lit(p)) for p in term_patterns(terms, language)), F.lit(0))


def balance(up: Column, down: Column) -> Column:
    """(up - down) / (up + down), 0 without either; each is computed once."""
    pair = F.array(F.struct(up.alias("up"), down.alias("down")))
    return F.get(F.transform(pair, lambda c: F.when(c["up"] + c["down"] > 0, (c["up"] - c["down"]) / (c["up"] + c["down"])).otherwise(0.0)), 0)


def count_terms_unnegated(text: Column, terms: list[str], negations: list[str], window: int = 4) -> Column:
    """Matches of one-word terms that no negation precedes within ``window`` words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\w']+"), F.lit(0))
    is_term = F.array(*[F.lit(t.lower()) for t in terms])
    is_not = F.array(*[F.lit(t.lower()) for t in negations])
    hit = lambda w, i: F.array_contains(is_term, w) & ~F.arrays_overlap(F.slice(words, F.greatest(i + 1 - window, F.lit(1)), F.least(i, F.lit(window))), is_not)
    return F.size(F.filter(words, hit))


def by_language(language: Column, forms: dict[str, Column], default: str = "en") -> Column:
    """The form of a row's language, that of ``default`` for others and for null."""
    out = forms[default]
    for name, form in forms.items():
        if name != default:
            out = F.when(language == name, form).otherwise(out)
    return out


def n_words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def per_thousand(hits: Column, words: Column) -> Column:
    return F.when(words > 0, hits / words * 1000).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")


def _holds(part: Column, terms: list[str]) -> Column:
    return part.rlike("|".join(term_pattern(t) for t in sorted(terms)))


def cooccurrence(text: Column, groups: list[list[str]], unit: str = "document") -> Column:
    """How many units (document: 0 or 1, sentence, paragraph) hold a term of every group."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.array(low) if unit == "document" else sentences(low) if unit == "sentence" else paragraphs(low)

    def every(p: Column) -> Column:
        out = F.lit(True)
        for g in groups:
            out = out & _holds(p, g)
        return out

    return F.size(F.filter(parts, every))


def tone(text: Column, up: list[str], down: list[str]) -> Column:
    """(up - down) / (up + down), 0 without either."""
    return balance(count_terms(text, up), count_terms(text, down))


def density(text: Column, terms: list[str]) -> Column:
    return F.try_divide(count_terms(text, terms), F.sqrt(n_words(text).cast("double")))


def index_quarterly(scored: DataFrame, how: str = "mean", date: str = "date", score: str = "score", weight: str | None = None) -> DataFrame:
    """date (quarter), value over the whole calendar: null in quarters without documents. how: mean, max, dispersion
    (sample deviation, 0 for one document), or sum_weighted (of scores times ``weight``, 1 where that is null)."""
    if (how == "sum_weighted") != (weight is not None):
        raise ValueError("sum_weighted, and only that, takes a weight")
    weighted = F.sum(F.col(score) * F.coalesce(F.col(weight).cast("double"), F.lit(1.0))) if weight else None
    agg = {"mean": F.avg(score), "max": F.max(score), "dispersion": F.coalesce(F.stddev_samp(score), F.lit(0.0)), "sum_weighted": weighted}[how]
    q = scored.where(F.col(score).isNotNull()).groupBy(period(F.col(date), "quarter").alias("date")).agg(agg.alias("value"))
    # one row with all quarters: a join with a calendar of them would score every text again
    whole = q.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.map_from_entries(F.collect_list(F.struct("date", "value"))).alias("of"))
    return whole.select("of", F.explode(F.sequence("lo", "hi", F.expr("interval 3 month"))).alias("date")).select("date", F.try_element_at("of", "date").alias("value"))


def normalise(index: DataFrame, how: str = "zscore") -> DataFrame:
    """zscore by the population deviation, or bbd_100: mean 100."""
    w = Window.partitionBy()  # one row per quarter
    v = F.col("value")
    return index.withColumn("value", F.try_divide(v - F.avg(v).over(w), F.stddev_pop(v).over(w)) if how == "zscore" else F.try_divide(v * 100, F.avg(v).over(w)))


def sparsity(records: DataFrame, whole: bool = False) -> DataFrame:
    """Documents and mean words per quarter; with ``whole`` also for the quarters between that have no document: 0, and null words."""
    q = records.groupBy(period(F.col("date"), "quarter").alias("date")).agg(F.count("*").alias("n_docs"), F.avg(n_words(F.col("text"))).alias("mean_words"))
    if not whole:
        return q
    span = q.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 3 month"))).alias("date"))
    return span.join(q, "date", "left").na.fill(0, ["n_docs"])


#: What a unit is worth, in billions and in basis points.
BILLIONS = {"trillion": 1000.0, "billion": 1.0, "b": 1.0, "million": 0.001, "m": 0.001}
BASIS_POINTS = {"basis point": 1.0, "basis points": 1.0, "bp": 1.0, "bps": 1.0, "percentage point": 100.0, "percentage points": 100.0}
NUMBER = r"([0-9]+(?:\.[0-9]+)?)\s*"


def _largest(text: Column, before: str, units: dict[str, float]) -> Column:
    """The largest product of a number and the worth of the unit after it; 0 without one."""
    pattern = F.lit(f"{before}{NUMBER}({'|'.join(sorted(units, reverse=True))})\\b")
    worth = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    numbers, names = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in (1, 2))
    return F.coalesce(F.array_max(F.zip_with(numbers, names, lambda n, u: n.try_cast("double") * worth[u])), F.lit(0.0))


def billions(text: Column) -> Column:
    """Largest amount named in a text, in billions; 0 without one."""
    return _largest(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))), "", BILLIONS)


def basis_points(text: Column) -> Column:
    """Largest change named in a text, in basis points; percentage points count where ``by`` stands before them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    points = {u: w for u, w in BASIS_POINTS.items() if w > 1}
    return F.greatest(_largest(low, r"\b", {u: w for u, w in BASIS_POINTS.items() if w == 1}), _largest(low, r"\bby\s", points))


def strip_html(html: Column) -> Column:
    """Text of markup by expressions alone: scripts, styles and comments go, block tags break lines."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|tr|h[1-6]|article|section)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
