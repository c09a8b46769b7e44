"""Personal data and what gives it away, with DataFrame operations only.

Base spans come from regular expressions. A span's place is found without a row-wise function: the text
split by the expression and the expression's matches alternate, so running sums of their lengths are
the places, in code points. Running sums go by chunks of an array, so that their cost follows its length.

On top of them come spans of terms that reveal a protected entity, by information content. Entities are
the values themselves (one address, number, ...) and their classes (an address's domain or net, a
number's issuer or area). Over all documents, the probability of the entity where the term stands, at the
lower end of its Wilson interval, gives the pointwise mutual information; its share of the entity's own
information, -log p(entity), is the term's disclosure. Few observations widen the interval, so there is no
floor on them. Terms at or over a threshold are generalised, those at or over a higher one are removed,
wherever they stand in a text with that entity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Fixed values. Kinds in order of their spans, with expressions that match what the contract's match,
#: leftmost and longest, in linear time: runs aren't given back, and none starts inside a run.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text that every match of the kind holds; texts without it aren't searched.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"[\p{L}\p{N}]+"
TERM = "term"
SPAN = "array<struct<start:int,end:int,value:string>>"
PLACED = "array<struct<start:int,end:int,value:string,disclosure:double>>"
#: Elements of an array that are folded one by one.
CHUNK = 128
#: Stands for a character of a base span while words are looked for: a letter, so that words touching it are no terms.
MASK = "\u2e2f"
#: Copies of a small side's rows in joins on keys that may be hot.
SALTS = 8
#: Terms that are broadcast at most, about 10 MB; more aren't.
BROADCAST = 200_000


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def before(values: Column, zero: Column, join: Callable[[Column, Column], Column], level: int = 2) -> Column:
    """For each element of an array the fold of those before it by an associative ``join``."""
    if not level:
        grown = F.aggregate(
            values, F.struct(zero.alias("at"), F.transform(F.slice(values, 1, 0), lambda _: zero).alias("out")),
            lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        )
        return grown["out"]

    def parts(v: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / CHUNK)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * CHUNK + 1, CHUNK))

    def whole(chunks: Column) -> Column:
        heads = before(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: join(a, x))), zero, join, level - 1)
        return F.flatten(F.zip_with(chunks, heads, lambda c, h: F.transform(before(c, zero, join, 0), lambda x: join(h, x))))

    return bound(values, lambda v: bound(parts(v), whole))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost matches in a non-null text."""

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), F.char_length(m).alias("n"), m.alias("m")))

        def spread(x: Column) -> Column:
            heads = before(F.transform(x, lambda s: s["gap"] + s["n"]), F.lit(0), lambda a, b: a + b)
            return F.zip_with(x, heads, lambda s, at: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["n"]).alias("end"), s["m"].alias("value")))

        return bound(steps, spread)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def replaced(text: Column, cuts: Column) -> Column:
    """A text with its ``cuts``, sorted structs of start, end and ``put``, replaced by what they put. Where cuts
    overlap, the later adds what it puts alone."""
    size = 1024

    def between(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / size).cast("int") - first + 1), "")
        return F.when(end > start, F.substr(near, start - first * size + 1, end - start)).otherwise("")

    def build(cuts: Column) -> Column:
        n = F.char_length(text)
        last = F.struct(n.alias("start"), n.alias("end"), F.lit("").alias("put"))
        return bound(F.concat(cuts, F.array(last)), lambda all_cuts: bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda blocks: F.array_join(
            F.zip_with(all_cuts, before(F.transform(all_cuts, lambda c: c["end"]), F.lit(0), F.greatest), lambda c, at: F.concat(between(blocks, at, c["start"]), c["put"])), ""
        )))

    return bound(cuts, build)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = F.transform(F.split(F.reverse(number), ""), lambda x: x.try_cast("int"))
    d = F.filter(d, lambda x: x.isNotNull())
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    n = F.length(digits(s["value"]))
    if kind == "card":
        return n.between(16, 19) & luhn(digits(s["value"]))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Checked spans of each kind in a text (null: none)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    out = {}
    for kind, pattern in KINDS.items():
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.rlike(text, F.lit(pattern))
        own = spans(text, pattern) if kind == "email" else F.filter(spans(text, pattern), partial(_valid, kind))
        out[kind] = F.when(may, own).otherwise(F.array().cast(SPAN))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, text_hash, text (null where nothing is found), and an array of spans per kind."""
    kinds = base_spans(F.col(text_col))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in kinds.items()])
    any_found = F.lit(False)
    for k in kinds:
        any_found = any_found | (F.size(k) > 0)
    return d.withColumn("text", F.when(any_found, F.col("text")))


def entities(found: DataFrame) -> DataFrame:
    """One row per different text with base spans: text_hash, text, and its entities. An entity is a
    kind and its value, e-mail addresses in lower case, numbers as digits; or a class of such values: an
    address's domain or first two parts, a number's first six digits or those before the last seven."""

    def name(kind: str, label: str, form: Callable[[Column], Column]) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{label}:"), form(s["value"])))

    each = F.concat(
        name("email", "email", F.lower), name("email", "domain", lambda v: F.lower(F.substring_index(v, "@", -1))),
        name("ip", "ip", lambda v: v), name("ip", "net", lambda v: F.substring_index(v, ".", 2)),
        name("card", "card", digits), name("card", "issuer", lambda v: F.substring(digits(v), 1, 6)),
        name("phone", "phone", digits), name("phone", "area", lambda v: F.regexp_replace(digits(v), "[0-9]{7}$", "")),
    )
    texts = found.where("text is not null").dropDuplicates(["text_hash"])
    return texts.select("text_hash", "text", F.array_distinct(each).alias("entities"), *KINDS)


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _salted(large: DataFrame, small: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """A join whose small side has each row SALTS times, so that a hot key is dealt to as many tasks by ``by``; beyond
    that many, Spark splits skewed partitions."""
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*keys, "salt"], how).drop("salt")


def profiles(texts: DataFrame) -> DataFrame:
    """(text_hash, own, n_e): entities by the set of texts that hold them. Entities of one set have the same
    statistics, so that a text of many addresses found nowhere else has one row, not one for each."""
    held = texts.select("text_hash", F.explode("entities").alias("entity"))
    sets = held.groupBy("entity").agg(F.count("*").alias("n_e"), F.struct(F.bit_xor(F.xxhash64("text_hash")), F.bit_xor(F.xxhash64("text_hash", F.lit(1)))).alias("own"))
    return _salted(held, sets, ["entity"], F.col("text_hash")).groupBy("text_hash", "own").agg(F.first("n_e").alias("n_e"))


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """The lower end of the Wilson interval of a share of ``hits`` in ``n``."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosures(docs: DataFrame, texts: DataFrame, text_col: str = "text", threshold: float = 0.8, z: float = 1.96) -> DataFrame:
    """(text_hash, term, disclosure): terms of each text that reveal an entity of it, by the whole corpus.

    disclosure = 1 + log P(entity | term) / -log p(entity), from 0 to 1, with P the lower end of the Wilson
    interval (``z`` standard deviations) of the different texts with both in the documents with the term.
    Copies of a text add to its terms' counts and not to what they reveal.
    """
    held = scratch.write_table(profiles(texts), "pii-profiles")
    n_term = docs.select(F.explode(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n_term = scratch.write_table(n_term, "pii-terms")
    n, most_texts = docs.count(), held.agg(F.max("n_e")).first()[0] or 0
    # a text's profiles come to its words as one array: one shuffle of the words, whatever the number of profiles
    own_profiles = held.groupBy("text_hash").agg(F.collect_list(F.struct("own", "n_e")).alias("profiles"))
    words = texts.select("text_hash", words_of(F.col("text")).alias("words"))
    pairs = own_profiles.join(words, "text_hash").select("text_hash", "profiles", F.explode("words").alias("term"))
    # where P is enough, a term is in at most n_et (n / n_e)^(1 - threshold) documents; so terms in more than this tell of no entity
    common = n_term.where(F.col("n_t") > most_texts**threshold * n ** (1 - threshold) * (1 + 1e-9)).select("term")
    if common.count() <= BROADCAST:
        pairs = pairs.join(F.broadcast(common), "term", "left_anti")
    pairs = pairs.select("text_hash", F.explode("profiles").alias("p"), "term").select("text_hash", "p.own", "p.n_e", "term")
    together = pairs.groupBy("own", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"))
    information = F.log(F.lit(float(n)) / F.col("n_e"))
    weighed = together.where(information > 0)
    most = weighed.groupBy("term").agg(F.max(F.col("n_et") * F.exp((1 - threshold) * information)).alias("most"))
    rare = n_term.join(most, "term").where(F.col("n_t") <= F.col("most") * (1 + 1e-9)).drop("most")
    share = F.greatest(F.lit(0.0), 1 + F.log(lower_bound(F.col("n_et"), F.col("n_t"), z)) / information)
    d = _salted(weighed, rare, ["term"], F.col("own"))
    telling = d.select("own", "term", share.alias("disclosure")).where(F.col("disclosure") >= threshold)
    return _salted(pairs.drop("n_e"), telling, ["own", "term"], F.col("text_hash")).groupBy("text_hash", "term").agg(F.max("disclosure").alias("disclosure"))


def analyse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, z: float = 1.96) -> DataFrame:
    """Base and term spans of every row's whole text.

    Returns the id column, an array of spans per kind (start, end in code points, value), and terms
    (start, end, value, disclosure): words that touch no base span. A null or empty text has none. Rows
    that repeat count each. Other columns of the input aren't carried. An empty table gives an empty
    result.
    """
    found = scratch.write_table(find(docs, id_col, text_col), "pii-found")
    texts = scratch.write_table(entities(found), "pii-texts")
    by_text = disclosures(docs, texts, text_col, threshold, z).groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("telling"))
    base = F.array_sort(F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("put"))) for k in KINDS]))
    # the mask has each character of a base span once, also where spans overlap
    ends = lambda c: bound(c, lambda x: F.zip_with(x, before(F.transform(x, lambda s: s["end"]), F.lit(0), F.greatest), lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(MASK), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], at))).alias("put"))))
    masked = texts.join(by_text, "text_hash").select("text_hash", "telling", replaced(F.col("text"), ends(base)).alias("masked"))
    places = F.filter(spans(F.col("masked"), WORD), lambda s: F.map_contains_key("telling", F.lower(s["value"])))
    terms = F.transform(places, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.element_at("telling", F.lower(s["value"])).alias("disclosure")))
    some = _salted(found.where("text is not null"), masked.select("text_hash", terms.alias("terms")), ["text_hash"], F.col("id"), "left")
    both = some.drop("text").unionByName(found.where("text is null").drop("text").withColumn("terms", F.lit(None).cast(PLACED)))
    return both.select(F.col("id").alias(id_col), "text_hash", *KINDS, F.coalesce("terms", F.array().cast(PLACED)).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.95, **options) -> DataFrame:
    """The id column and the text with base spans replaced by their kind in brackets, telling terms by what
    they look like ([NUMBER], [NAME] if capitalised, else [TERM]), or by nothing where they tell
    ``remove_at`` of an entity's information or more.

    Null and empty texts stay as they are. One row per different pair of id and text; null ids too. Where spans
    of two kinds overlap, both tags appear. Other columns aren't carried; an empty table gives an empty result.
    """
    a = analyse(docs, id_col, text_col, **options)
    tag = lambda kind: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put")))
    form = lambda v: F.when(F.rlike(v, F.lit(r"^\p{N}+$")), "[NUMBER]").when(F.rlike(v, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[TERM]")
    tagged = F.concat(*map(tag, KINDS), F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= remove_at, "").otherwise(form(s["value"])).alias("put"))))
    a = a.select(F.col(id_col).alias("id_"), F.col("text_hash").alias("hash_"), F.array_sort(tagged).alias("cuts")).dropDuplicates(["id_", "hash_"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash")).dropDuplicates(["id", "hash"])
    j = rows.join(a, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")))
    return j.select(F.col("id").alias(id_col), F.when(F.size("cuts") > 0, replaced(F.col("text"), F.col("cuts"))).otherwise(F.col("text")).alias(text_col))


def _written(kind: str, own: Column | str) -> Column:
    return F.transform(own, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = analyse(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat(*[_written(k, k) for k in KINDS])
    return d.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _written(TERM, "terms")), ",").alias("spans"),
    )


QUERIES = {"op3_pii": op3_pii}
ORACLE: dict[str, str] = {}
