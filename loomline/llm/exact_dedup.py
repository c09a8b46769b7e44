"""Exact dedup by Grace hash partitioning.

1. Each task puts its rows' normalised texts in an open-addressing table, which compares complete
   contents, and keeps one local representative per content. The tagged rows are written.
2. Only representatives are shuffled, by digest: a content arrives once per window of step 1 at most,
   however many copies it has. Each task folds its bucket into a table as it reads: a row of a content
   that is there is told its leader and forgotten; once the table is full, rows of other contents are
   dealt out to spill files by further bits of the hash, and each file goes the same way again. A
   digest with many representatives is folded in shares by several tasks first.
3. The smallest id and the number of rows of each leader are aggregated, and these verdicts joined back
   to the tagged rows on the representative.

Spill files are in the shared folder, named by attempt, and deleted as they are read: a lost executor's
task starts again from the shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .batches import by_bytes, values

SPACE = b" \t\n\x0b\x0c\r"
TAGGED = "id long, rep long, is_rep boolean, sha string, content binary, n long"
MEMBER = "rep long, lead long, id long, n long"
#: Representatives of one digest that one task folds.
HOT = 1000


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; runs at the ends stay as one space too."""
    if not text:
        return text
    out = b" ".join(text.split())
    if not out:
        return b" "
    return (b" " if text[0] in SPACE else b"") + out + (b" " if text[-1] in SPACE else b"")


class ContentTable:
    """Open addressing with linear probing; equal means equal content, the hash only finds the slot."""

    def __init__(self, slots: int = 1024):
        self.slot = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def _probe(self, h: int, content: bytes | None) -> int:
        mask = len(self.slot) - 1
        i = h & mask
        while (k := int(self.slot[i])) >= 0:
            if content is not None and self.hashes[k] == h and self.contents[k] == content:
                return k
            i = (i + 1) & mask
        return ~i

    def find(self, h: int, content: bytes) -> int:
        """The index of the content's entry, negative if it has none."""
        return self._probe(h, content)

    def put(self, h: int, content: bytes) -> tuple[int, bool]:
        """(index of the content's entry, whether it's new)."""
        if (k := self._probe(h, content)) >= 0:
            return k, False
        if 2 * (len(self) + 1) > len(self.slot):
            self.slot = np.full(2 * len(self.slot), -1, np.int64)
            for j, old in enumerate(self.hashes):
                self.slot[~self._probe(old, None)] = j
            k = self._probe(h, content)
        self.slot[~k] = len(self)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        return len(self) - 1, True


def _less(a, b) -> bool:
    """Order of ids with nulls last."""
    return b is None and a is not None or a is not None and a < b


def tag(limit: int):
    """mapInArrow: rows (id, text) -> TAGGED, with one representative per content and window.

    A window ends when its table holds ``limit`` bytes; a content of two windows has two representatives.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 36, 0
        table, rows, best, shas, count = ContentTable(), [], [], [], []

        def flush():
            nonlocal table, rows, best, shas, count, made
            cols = [[], [], [], [], [], []]
            for at in range(0, len(rows), 2000):
                for c in cols:
                    c.clear()
                for j, (doc, k) in enumerate(rows[at : at + 2000], at):
                    first = best[k] == j
                    for c, v in zip(cols, (doc, base + made + k, first, shas[k], table.contents[k] if first else None, count[k] if first else None), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.int64()), strict=True)], names=["id", "rep", "is_rep", "sha", "content", "n"])
            made += len(table)
            table, rows, best, shas, count = ContentTable(), [], [], [], []

        for batch in by_bytes(batches, "text"):
            for doc, text in zip(batch.column("id").to_pylist(), values(batch.column("text")), strict=True):
                content = normalise(text)
                digest = hashlib.sha256(content)
                k, new = table.put(int.from_bytes(digest.digest()[:8], "little"), content)
                if new:
                    best.append(len(rows))
                    shas.append(digest.hexdigest())
                    count.append(0)
                elif _less(doc, rows[best[k]][0]):
                    best[k] = len(rows)
                count[k] += 1
                rows.append((doc, k))
            if table.bytes + 48 * len(rows) >= limit:
                yield from flush()
        if rows:
            yield from flush()

    return run


SPILL = pa.schema([("rep", pa.int64()), ("id", pa.int64()), ("sha", pa.string()), ("content", pa.binary()), ("n", pa.int64())])


def grace(folder: str, limit: int, fan_out: int = 16):
    """mapInArrow: representatives -> MEMBER by Grace hash dedup with spill files under ``folder``.

    ``lead`` is the first representative met of the same content. A task holds contents of ``limit`` bytes.
    """

    def dedup(stream: Iterable[tuple], level: int) -> Iterator[tuple]:
        table, leads, waiting = ContentTable(), [], 0
        sinks: list = []
        parts: list[list] = [[] for _ in range(fan_out)]

        def write():
            nonlocal waiting
            if not sinks:
                fs.create_dir(own, recursive=True)
                sinks.extend(fs.open_output_stream(f"{own}/{b}") for b in range(fan_out))
                files.extend(pa.ipc.new_stream(x, SPILL) for x in sinks)
            for f, p in zip(files, parts, strict=True):
                if p:
                    f.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p, strict=True), SPILL.types, strict=True)], schema=SPILL))
                    p.clear()
            waiting = 0

        files: list = []
        fs, top = scratch.open_fs(folder)
        own = f"{top}/{uuid.uuid4().hex}"
        try:
            for row in stream:
                rep, doc, sha, content, n = row
                h = int(sha[:16], 16)
                if (k := table.find(h, content)) >= 0:
                    yield rep, leads[k], doc, n
                elif table.bytes <= limit:
                    table.put(h, content)
                    leads.append(rep)
                    yield rep, rep, doc, n
                else:
                    # from the digest's end; beyond its bits the table alone makes progress, a content at least each time
                    parts[int(sha[max(16, 63 - level)], 16) % fan_out].append(row)
                    waiting += len(content) + 200
                    if waiting > limit // 4:
                        write()
            table = leads = None
            if waiting:
                write()
            for f in (*files, *sinks):
                f.close()
            for b in range(len(files)):
                with fs.open_input_stream(f"{own}/{b}") as source:
                    yield from dedup((r for x in pa.ipc.open_stream(source) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)), level + 1)
                fs.delete_file(f"{own}/{b}")
        finally:
            if files:
                fs.delete_dir(own)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in by_bytes(batches, "content") for r in zip(*(b.column(c).to_pylist() for c in SPILL.names), strict=True))
        members = dedup(rows, 0)
        while part := list(islice(members, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names=["rep", "lead", "id", "n"])

    return run


def members(reps: DataFrame, limit: int, hot: int = HOT) -> DataFrame:
    """MEMBER of every representative (rep, id, sha, content, n), with one lead for all of a content."""
    fold = grace(scratch.new_path(reps.sparkSession, "dedup-spill"), limit)
    counts = scratch.write_table(reps.groupBy("sha").agg(F.count("*").alias("reps")).where(F.col("reps") > hot), "dedup-hot")
    n_hot = counts.count()
    if not n_hot:
        return scratch.write_table(reps.repartition("sha").mapInArrow(fold, MEMBER), "dedup-members")
    # a hundredth of a thousandth of the rows at most; beyond 100,000 digests (7 MB) it isn't broadcast
    marked = reps.join(F.broadcast(counts) if n_hot <= 100_000 else counts, "sha", "left")
    many = marked.where("reps is not null")
    share = F.pmod(F.xxhash64("rep"), F.ceil(F.col("reps") / hot))
    first = scratch.write_table(many.withColumn("share", share).repartition("sha", "share").drop("share", "reps").select(*SPILL.names).mapInArrow(fold, MEMBER), "dedup-shares")
    leaders = many.join(first.where("rep = lead").select("rep"), "rep", "left_semi").select(*SPILL.names)
    rest = marked.where("reps is null").select(*SPILL.names)
    second = scratch.write_table(rest.unionByName(leaders).repartition("sha").mapInArrow(fold, MEMBER), "dedup-members")
    led = second.select(F.col("rep").alias("lead"), F.col("lead").alias("top"))
    return second.join(first.select("rep"), "rep", "left_anti").unionByName(first.join(led, "lead").select("rep", F.col("top").alias("lead"), "id", "n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_mb: float = 64, hot: int = HOT) -> DataFrame:
    """Which rows stay when of equal texts only the one with the smallest id does.

    Texts are equal when identical after each run of ASCII white space is replaced by one space. A
    null text counts as empty. Returns one row per input row: the id column, keep_id, group_size,
    kept, text_sha256 (of the normalised text). Of rows that repeat id and text exactly one is kept.
    Null ids come after all others. Other columns of the input aren't carried. An empty table gives an
    empty result. ``memory_mb`` bounds the contents that a task holds, unless one text is larger; a digest
    with more than ``hot`` representatives is folded in shares first.
    """
    limit = int(memory_mb * 2**20)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tagged = scratch.write_table(rows.mapInArrow(tag(limit // 2), TAGGED), "dedup-tagged")
    found = members(tagged.where("is_rep").select(*SPILL.names), limit, hot)
    best = found.groupBy("lead").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rep")).alias("best"), F.sum("n").alias("group_size"))
    verdicts = found.select("rep", "lead").join(best, "lead").select("rep", F.col("best.id").alias("keep_id"), "group_size", (F.col("rep") == F.col("best.rep")).alias("wins"))
    out = tagged.select("id", "rep", "is_rep", "sha").join(verdicts, "rep")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("is_rep") & F.col("wins")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``dedup`` keeps: nulls, empty texts, repeated rows, null ids and an
    empty table as there. Of rows with the same id and the same normalised text any one stays."""
    name = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))
    kept = dedup(docs, id_col, text_col, **options).where("kept").select(name.alias("id"), F.col("text_sha256").alias("own"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    # of rows that repeat both, one; the join then finds the window's partitions, so texts are shuffled once
    repeat = Window.partitionBy("id", "own").orderBy(F.lit(1))
    rows = docs.select(F.struct("*").alias("row"), name.alias("id"), sha.alias("own")).withColumn("n", F.row_number().over(repeat)).where("n = 1")
    return rows.join(kept, ["id", "own"], "left_semi").select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE = {"op1_exact_dedup": SQL}
