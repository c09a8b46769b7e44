"""The trie of conversations' beginnings, with totals of its subtrees by message passing.

A node is a sequence of turns with which conversations begin. Turns are told apart by digests, and a
conversation's digests are chained, so that a node has one key in whatever conversation it is met; texts
aren't shuffled. Counts and smallest members of the nodes are plain aggregations of the chained keys.

Totals go from the leaves up. Node by node that takes as many rounds as the longest conversation has
turns, so the trie is first cut into paths: each node lies on the path of one of its members, that of the
smallest hash. That member is also the one of all nodes below on its path until it ends, so a path is a
range of one conversation's depths, and it hangs on a node of another path. Seen from a leaf upwards the member
changes as often as a running minimum of random numbers does, some ln(conversations) times, however deep
the trie is. Paths hold counters of the paths that hang on them: a path without any is complete and sends
its totals to the one that it hangs on, and is peeled off, until only the root's is left. Inside of
a path, sums from its end upwards then give every node's totals.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import scratch

#: Ids of a node's ending conversations are put in order by ranges of so many.
RANGE = 4096
#: A parent of more than one in so many of all nodes is joined by broadcast: there are at most so many.
HOT = 1000


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id and turns: (key, chars) of each turn in order, where key is a digest of role and text.

    Rows go by turn, null first; rows of equal turn by role, then by digest. Null roles and texts are empty ones; rows
    without an id belong to no conversation and go.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col)), 256)), 1, 16)
    one = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), key.alias("key"), F.length(text(text_col)).cast("long").alias("chars"))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), one.alias("one"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("one")).alias("all")).select("id", F.transform("all", lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars"))).alias("turns"))


@F.pandas_udf(ArrayType(LongType()))
def _chained(keys: pd.Series) -> pd.Series:
    """Of a list of digests, 128 bits of a digest of each beginning, the empty one too, as two numbers each."""

    def chain(own) -> np.ndarray:
        state = hashlib.sha256()
        out = [state.digest()[:16]]
        for k in own:
            state.update(k)
            out.append(state.digest()[:16])
        return np.frombuffer(b"".join(out), ">i8").astype(np.int64)

    return keys.map(chain)


def _scrambled(x: Column) -> Column:
    """Another number for each whole number, no two alike, in an order as good as random."""
    x = x.bitwiseXOR(F.lit(0x2545F4914F6CDD1D))
    for _ in range(3):
        for to, n in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
            x = x.bitwiseXOR(to(x, n))
    return x


KEY = ["a", "b"]


def _nodes(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all nodes: a, b, their parent's pa, pb, depth, first, rep, n_convs, chars; where each conversation ends: a, b, id)."""
    chained = convs.select(F.col("id").cast("long").alias("id"), F.transform("turns", lambda t: t["chars"]).alias("chars"), _chained(F.transform("turns", lambda t: t["key"])).alias("keys"))
    chained = scratch.write_table(chained, "trie-chains")
    at = lambda i: F.get("keys", i)
    node = lambda d: F.struct(d.cast("long").alias("depth"), at(2 * d).alias("a"), at(2 * d + 1).alias("b"), at(2 * d - 2).alias("pa"), at(2 * d - 1).alias("pb"), F.coalesce(F.get("chars", d - 1), F.lit(0)).alias("chars"))
    met = chained.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("chars")), node)).alias("node")).select("id", _scrambled(F.col("id")).alias("mixed"), "node.*")
    # all that share a key share their parent, depth and last turn
    same = [F.first(c).alias(c) for c in ("pa", "pb", "depth", "chars")]
    nodes = met.groupBy(*KEY).agg(*same, F.min("id").alias("first"), F.min("mixed").alias("rep"), F.count("*").alias("n_convs"))
    return scratch.write_table(nodes, "trie-nodes"), chained.select(F.element_at("keys", -2).alias("a"), F.element_at("keys", -1).alias("b"), "id")


def _ends(ends: DataFrame) -> DataFrame:
    """Key and digest of the ids that end there, in order and joined by commas.

    Ids are first put in order within ranges, of at most RANGE ids each, by any number of tasks. A node of more than
    one range is then read by one task, as a digest must be, which holds one range at a time.
    """
    ranges = ends.groupBy(*KEY, F.floor(F.col("id") / F.lit(RANGE)).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    ranges = scratch.write_table(ranges, "trie-ends")
    counts = ranges.groupBy(*KEY).agg(F.count("*").alias("n"))
    split = ranges.join(counts.where("n > 1").drop("n"), KEY).repartition(*KEY).sortWithinPartitions(*KEY, "range").select(*KEY, "ids")
    single = ranges.join(counts.where("n = 1").drop("n"), KEY).select(*KEY, F.sha2("ids", 256).alias("ends_sha256"))

    def digest(batches):
        import pyarrow as pa

        row = lambda k, state: pa.RecordBatch.from_pylist([{"a": k[0], "b": k[1], "ends_sha256": state.hexdigest()}])
        at, state = None, None
        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    yield row(at, state)
                at, state = (a, b), hashlib.sha256(ids.encode())
        if at is not None:
            yield row(at, state)

    return single.union(split.mapInArrow(digest, "a long, b long, ends_sha256 string"))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children and their parent's rep and first, without a join on a parent of very many children."""
    counts = nodes.where("pa IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = scratch.write_table(nodes.join(counts, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-counted")
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("parent_rep"), F.col("first").alias("parent_first"), "n_children")
    hot = F.col("n_children") > nodes.count() / HOT
    # fewer than HOT rows, as more than one in HOT of all nodes are children of each
    near = nodes.join(F.broadcast(above.where(hot).drop("n_children")), ["pa", "pb"], "left").where("pa IS NULL OR parent_rep IS NOT NULL")
    return near.unionByName(nodes.join(above.where(~hot).drop("n_children"), ["pa", "pb"]))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def peel(paths: DataFrame) -> DataFrame:
    """Totals that complete paths send up: path, to, depth, leaves, saved, and the round in which they do.

    ``paths`` has path, to (the path it hangs on, null for the last) and depth (there), leaves and saved of its own nodes, and
    pending: how many paths hang on it. Each round writes what is sent and what is left, so none is computed again.
    """
    spark, sent, left, k = paths.sparkSession, [], paths, 0
    while not left.isEmpty():
        done = scratch.write_table(left.where("pending = 0").drop("pending").withColumn("round", F.lit(k)), f"trie-sent-{k}")
        if done.isEmpty():
            raise ValueError("paths hang on each other, or on none that is there")
        sent.append(done)
        told = done.where("to IS NOT NULL").groupBy(F.col("to").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("new_leaves"), F.sum("saved").alias("new_saved"))
        rest = left.where("pending > 0").join(told, "path", "left")
        left = scratch.write_table(rest.select("path", "to", "depth", (F.col("leaves") + _zero("new_leaves")).alias("leaves"), (F.col("saved") + _zero("new_saved")).alias("saved"), (F.col("pending") - _zero("n")).alias("pending")), f"trie-left-{k}")
        k += 1
    none = spark.createDataFrame([], "path long, to long, depth long, leaves long, saved long, round int")
    return reduce(DataFrame.unionByName, sent, none)


def trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``convs`` (id, turns: array of (key, chars)).

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Conversations without turns are members of the root; of no conversations there is no node.
    Ids are whole numbers, distinct and not null. A conversation's digests are one row, 24 bytes a turn.
    """
    nodes, ends = _nodes(convs)
    nodes = scratch.write_table(_with_parents(nodes).join(_ends(ends), KEY, "left"), "trie-joined")
    own, leaf = (F.col("n_convs") - 1) * F.col("chars"), (F.col("n_children") == 0).cast("long")
    tops = nodes.where("parent_rep IS NULL OR parent_rep <> rep").select(F.col("rep").alias("path"), F.col("parent_rep").alias("to"), (F.col("depth") - 1).alias("depth"))
    hung = tops.where("to IS NOT NULL").groupBy(F.col("to").alias("path")).agg(F.count("*").alias("pending"))
    sums = nodes.groupBy(F.col("rep").alias("path")).agg(F.sum(leaf).alias("leaves"), F.sum(own).alias("saved"))
    paths = tops.join(sums, "path").join(hung, "path", "left").select("path", "to", "depth", "leaves", "saved", _zero("pending").alias("pending"))
    sent = peel(scratch.write_table(paths, "trie-paths"))
    told = sent.where("to IS NOT NULL").groupBy(F.col("to").alias("rep"), "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # from the end of a path, which is a range of one conversation's depths
    up = Window.partitionBy("rep").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda mine, theirs, name: F.sum(mine + _zero(theirs)).over(up).alias(name)
    return nodes.join(told, ["rep", "depth"], "left").select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), "n_convs", "n_children", total(leaf, "leaves", "n_leaves"), total(own, "saved", "saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that begin with up to five turns of the one whose id ends in 00."""
    base = convs.where(F.col("id") % 100 == 0).select(F.col("id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    # at most 199 conversations share a base
    d = convs.withColumn("base", F.col("id") - F.col("id") % 100).join(base, "base", "left")
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % 6).cast("int")
    own = F.slice("turns", h + 1, F.size("turns"))
    return d.select("id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), h), own)).alias("turns"))


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(k AS BIGINT) FOR k IN range(8)]), lambda x, k: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT))"
SQL = f"""
WITH own AS (
  SELECT conv_id AS id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT id, t, {CRC} % 6 AS h FROM own),
conv AS (SELECT a.id, list_concat(coalesce(list_slice(b.t, 1, a.h), []), list_slice(a.t, a.h + 1, len(a.t))) AS t FROM h a LEFT JOIN own b ON b.id = a.id - a.id % 100),
met AS (SELECT id, d, len(t) AS n, list_slice(t, 1, d) AS k, CASE WHEN d > 0 THEN list_slice(t, 1, d - 1) END AS up, CASE WHEN d > 0 THEN len(t[d].text) ELSE 0 END AS chars
        FROM (SELECT id, t, unnest(range(len(t) + 1)) AS d FROM conv)),
node AS (
  SELECT k, d, any_value(up) AS up, min(id) AS id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM met GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON node.k = kids.k),
sums AS (SELECT m.k, m.d, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved FROM full_ f JOIN met m ON m.id = f.id AND m.d <= f.d GROUP BY 1, 2)
SELECT f.id AS conv_id, f.d AS depth, p.id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s ON s.k = f.k AND s.d = f.d LEFT JOIN full_ p ON f.d > 0 AND p.d = f.d - 1 AND p.k = f.up
"""

QUERIES = {"op12_turn_trie": op12_turn_trie}
ORACLE = {"op12_turn_trie": SQL}
