"""Mix sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. A source's rows are ordered by that key without ever being in one
task: the key's leading bits cut each source into buckets of bounded size, sums of the buckets are
accumulated over the few rows of the bucket table, and a window orders the rows inside a bucket. The
running word count then tells what each source's exact budget takes; budgets over a source's own
words take it whole, once or more, before the rest is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: int) -> DataFrame:
    """Targets of the sources: (src, source_size) -> + target, in one row per source.

    Sources in order of ``src`` have the weights in turn. With ``total`` words in all, ``share * total``
    is dealt out by weight, a source getting ``most`` times its words at most; the excess goes to the
    others by weight. That is target = min(most * source_size, level * weight) for the one level at
    which the targets add up, found from the sources in order of most * source_size / weight.
    """
    order = Window.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    d = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    d = d.withColumn("level", level)
    # the first source that its cap doesn't bind has the level that holds for it and all after it
    open_level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(Window.partitionBy())["level"]
    return d.select("src", "source_size", F.least("cap", F.coalesce(F.col("weight") * open_level, F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), most: int = 2, seed: str = "mix", bucket_rows: int = 4_000) -> DataFrame:
    """How many words of each row the mix takes.

    Returns one row per input row: the id and source columns, size (words), source_size, target (of
    its source), taken (words, over all epochs), epochs (whole passes), cut (words of a last, partial
    pass; below size only for the row at the budget's end). A null text has no words; a null source is
    a source of its own, last in order. Rows that repeat count each time; equal keys go by id and
    size. Other columns of the input aren't carried. An empty table gives an empty result. The same
    rows give the same mix whatever their partitions.
    """
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), src.alias("src"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
    )
    rows = scratch.write_table(rows, "mix-rows")
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows))
    leading = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.shiftright(leading * F.lit(buckets), 32))
    targets = budgets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), share, weights, most)
    in_source = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words")).select("src", "bucket", F.coalesce(F.sum("words").over(in_source), F.lit(0)).alias("offset")).join(targets, "src")
    in_bucket = Window.partitionBy("src", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(offsets, ["src", "bucket"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("inside")
    placed = placed.withColumn("budget", budget).withColumn("epochs", epochs).withColumn("cut", F.least(F.col("size"), F.greatest(F.lit(0), rest)))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"), "epochs", "cut")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` once per epoch that takes it, its columns unchanged.

    The row at the end of a source's budget keeps only the words that the budget still takes. A row of
    no words is taken as often as its source is passed whole. Null texts stay null, null ids and sources count
    like any; rows that repeat are taken each; an empty table gives an empty result.
    """
    plan = mix(docs, id_col, text_col, source_col, **options)
    # rows are told apart by id and size; repeats of both share one plan row's epochs and cuts in order
    repeat = lambda *order: F.row_number().over(Window.partitionBy("id", "size").orderBy(*order))
    plan = plan.select(F.col(id_col).alias("plan_id"), F.col("size").alias("plan_size"), "epochs", "cut", F.row_number().over(Window.partitionBy(id_col, "size").orderBy("epochs", "cut")).alias("plan_n"))
    text = F.col("row")[text_col]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id")).withColumn("size", word_count(text)).withColumn("n", repeat(F.xxhash64(text)))
    joined = rows.join(plan, F.col("id").eqNullSafe(F.col("plan_id")) & (F.col("size") == F.col("plan_size")) & (F.col("n") == F.col("plan_n")))
    start = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("cut").cast("string"), F.lit("}+"))
    partial = (F.col("cut") > 0) & (F.col("cut") < F.col("size"))
    whole = F.col("epochs") + F.when((F.col("cut") > 0) & (F.col("cut") == F.col("size")), 1).otherwise(0)
    parts = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(partial, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    out = joined.withColumn("part", F.explode(parts))
    cut = F.when(F.col("part"), F.call_function("regexp_extract", text, start, F.lit(0))).otherwise(text)
    return out.select(*[(cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH rows_ AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
sizes AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY src),
weighed AS (
  SELECT src, source_size, CAST(source_size AS DOUBLE) * 2 AS cap,
         CAST(CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM sizes),
levels AS (
  SELECT *, cap / weight AS ratio,
         (CAST(1.5 AS DOUBLE) * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
chosen AS (SELECT level AS lvl FROM levels WHERE level <= ratio ORDER BY ratio, src LIMIT 1),
targets AS (SELECT src, source_size, least(cap, coalesce(weight * (SELECT lvl FROM chosen), cap)) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY r.src ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows_ r JOIN targets t ON r.src = t.src),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM passes
"""

QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLE = {"op10_mix_sources": SQL}
