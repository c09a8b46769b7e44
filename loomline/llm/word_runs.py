"""Periodic runs of words: stretches that repeat with a period, found by a suffix automaton.

A suffix automaton of the words has a state for each class of stretches that end at the same places.
Its states are taken from the longest to the shortest, and the ordered set of end positions of each is
merged into that of its suffix link, the smaller into the larger. Where two ends become neighbours in a
state of length L and are no further apart than L, the stretch of L words before the first end goes on
with their distance as its period up to the second end: a square, which is extended to a run.

That finds all runs. Let a run have the smallest period q, and take two ends q apart in it whose common
stretch before them has L >= q words. In the state of that stretch they meet for the first time. Were there
another end between them, the stretch would have two periods that add up to q, and so one that divides q.

A run of at least ``times`` periods has each of its words ``times`` times. So a document is first cut, for
all documents of a batch together, at words that it (and then each of the parts) has less often, until no
part changes. Runs never cross such a word and can't be extended by one: the automaton reads the parts that
are left. In prose that is little of it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, end) of each state; end is where a state was made, -1 for copies and the root."""
    steps, length, link, end, last = [{}], [0], [-1], [-1], 0
    for i, c in enumerate(words):
        new = len(length)
        steps.append({})
        length.append(i + 1)
        end.append(i)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link.append(q)
            else:
                copy = new + 1
                link.append(copy)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = copy
        last = new
    return length, link, end


class Ends:
    """An ordered set of positions in blocks, so that a place is found and made in few steps."""

    BLOCK = 1024
    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, x: int):
        self.blocks, self.firsts, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        return (x for b in self.blocks for x in b)

    def add(self, x: int) -> tuple[int, int]:
        """Put ``x`` in; the positions before and after it, -1 where there are none."""
        self.size += 1
        k = max(0, bisect_left(self.firsts, x) - 1)
        b = self.blocks[k]
        i = bisect_left(b, x)
        before = b[i - 1] if i else -1
        after = b[i] if i < len(b) else self.firsts[k + 1] if k + 1 < len(self.blocks) else -1
        b.insert(i, x)
        self.firsts[k] = b[0]
        if len(b) > self.BLOCK:
            half = len(b) // 2
            self.blocks.insert(k + 1, b[half:])
            self.firsts.insert(k + 1, b[half])
            del b[half:]
        return before, after


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of squares, among them the longest one of each run's neighbouring ends."""
    length, link, end = automaton(words)
    ends: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    # a state's length is above its link's: by length, all that merges into a state comes before it
    for s in np.argsort(-np.array(length), kind="stable").tolist():
        p = link[s]
        if p <= 0:  # the empty stretch has no squares
            ends[s] = None
            continue
        small, large, size = ends[s], ends[p], length[p]
        ends[s] = None
        if large is None:
            ends[p] = small
            continue
        if small.size > large.size:
            small, large = large, small
        for x in small:
            before, after = large.add(x)
            if before >= 0 and x - before <= size:
                yield x - before, before - size + 1, x + 1
            if after >= 0 and after - x <= size:
                yield after - x, x - size + 1, after + 1
        ends[p] = large


def runs(words: list[int], shortest: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) by start and period of all runs that have max(shortest, times * period) words.

    ``times`` is 2 or more. A stretch counts once, by its smallest period.
    """
    n, found = len(words), {}
    open_: dict[int, list[tuple[int, int]]] = {}
    for q, start, stop in squares(words):
        known = open_.setdefault(q, [])
        # stretches of one period that can't be extended share fewer words than the period has
        k = bisect_left(known, (start + 1,)) - 1
        if k >= 0 and known[k][1] >= stop:
            continue
        while start and words[start - 1] == words[start - 1 + q]:
            start -= 1
        while stop < n and words[stop] == words[stop - q]:
            stop += 1
        insort(known, (start, stop))
        found[start, stop] = min(q, found.get((start, stop), q))
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(shortest, times * q))


def parts(codes: np.ndarray, group: np.ndarray, shortest: int = 6, times: int = 4) -> list[tuple[int, int]]:
    """(from, to) of what is left of ``codes`` when words that a part has less than ``times`` times cut it.

    Parts don't cross from one ``group`` (a number that doesn't fall) to the next and have ``shortest`` words at least.
    """
    at, part = np.arange(len(codes)), group.astype(np.int64)
    while len(at):
        _, code = np.unique(codes[at], return_inverse=True)
        _, which, count = np.unique(part * (code.max() + 1) + code, return_inverse=True, return_counts=True)
        keep = count[which] >= times
        was, at, part = len(at), at[keep], part[keep]
        if not len(at):
            break
        part = np.cumsum(np.r_[0, (np.diff(at) > 1) | (np.diff(part) != 0)])
        long = np.bincount(part)[part] >= shortest
        at, part = at[long], part[long]
        if len(at) == was:
            break
        part = np.unique(part, return_inverse=True)[1]
    if not len(at):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(part) != 0])
    return list(zip(at[first].tolist(), (at[np.r_[first[1:], len(at)] - 1] + 1).tolist(), strict=True))


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, one after another, and the row of each."""
    cut = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
    words, row = pc.list_flatten(cut), pc.list_parent_indices(cut)
    filled = pc.greater(pc.binary_length(words), 0)
    return words.filter(filled), row.filter(filled).to_numpy(zero_copy_only=False)


def _joined(words: pa.Array, row: np.ndarray, n: int) -> pa.Array:
    lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int64)), words)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


Rearrange = Callable[[object, int], "np.ndarray | None"]
#: A run: its first word's number, from 0, its words, and its smallest period.
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(batch: pa.RecordBatch, id_col: str, text_col: str, shortest: int, times: int, rearrange: Rearrange | None) -> pa.RecordBatch:
    n = batch.num_rows
    words, row = _words(batch.column(text_col))
    first = np.searchsorted(row, np.arange(n + 1))
    if rearrange is not None:
        order = np.arange(len(row))
        for k, key in enumerate(batch.column(id_col).to_pylist()):
            own = rearrange(key, int(first[k + 1] - first[k]))
            if own is not None:
                order[first[k] : first[k + 1]] = first[k] + own
        words = words.take(pa.array(order))
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept, found = np.ones(len(row), bool), [[] for _ in range(n)]
    for start, stop in parts(codes, row, shortest, times):
        k = int(row[start])
        for s, length, q in runs(codes[start:stop].tolist(), shortest, times):
            kept[start + s + q : start + s + length] = False
            found[k].append({"start": start + s - int(first[k]), "length": length, "period": q})
    columns = [batch.column(id_col), pa.array(np.diff(first).astype(np.int64)), pa.array(found, pa.list_(_RUN)), _joined(words.filter(pa.array(kept)), row[kept], n)]
    return pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "runs", "collapsed"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, times: int = 4, rearrange: Rearrange | None = None) -> DataFrame:
    """Runs of each text: the id, n_words, runs (by start and period) and collapsed.

    Words are what ASCII white space parts. A run has at least ``shortest`` words and ``times`` of its smallest
    periods, and no word beside it goes on with that period. ``collapsed`` has the words that no run
    contains after its first period, joined by one space. ``rearrange`` gives, for an id and a number of words, which
    word stands at each place, or None where all stay.

    A null text has no words, as an empty one. Rows count each, whatever ids they repeat; a null id is handed on. An empty table
    gives an empty result, and other columns aren't carried. A text is read whole in one task: its part that words of
    ``times`` and more occurrences make up takes about a kilobyte a word there.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            yield _find(batch, id_col, text_col, shortest, times, rearrange)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, n_words long, runs array<{RUN}>, collapsed string")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text its number of runs, the run of the most periods, and digests of all runs and of what is left."""
    # by exact length / period: of two runs a is ahead if a.length * b.period is larger
    ahead = lambda a, b: F.when(b.isNull() | (a["length"] * b["period"] > b["length"] * a["period"]), True).otherwise((a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    most = F.aggregate("runs", F.lit(None).cast(RUN), lambda best, x: F.when(ahead(x, best), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))), "")
    d = found.withColumn("most", most)
    return d.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period", F.floor(F.lit(1000) * F.col("most.length") / F.col("most.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of every tenth document or so, the words from some place on repeat with a period."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(find(docs, rearrange=planted))


QUERIES = {"op13_word_runs": op13_word_runs}
#: An automaton is no SQL; tests hold it against a search of all places and periods.
ORACLE: dict[str, str] = {}
