"""Language identification by hyperdimensional profiles.

Each letter of any script has a random vector of +1 and -1, drawn from its code point. An n-gram's vector
binds its letters' vectors, permuted by their place, by multiplication. A document's vector bundles its
n-grams' by addition; a language's prototype bundles its training documents' vectors, each scaled to
length one. A document has the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes, values

DIMENSIONS = 1024
N = 3
#: Bits of a letter's code point in an n-gram's code.
BITS = 21
#: N-grams that are bound at a time, and letters whose vectors a process keeps.
CHUNK, KEPT = 4096, 20_000
#: Training rows of a language at most; rows are chosen by a hash of their id.
MOST_TRAINING = 3000
BLOCK = 256
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Code of each code point: 0 for what isn't a letter, else the lower-case letter's code point."""
    chars = (chr(cp) for cp in range(0x110000))
    return np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0 for c in chars), np.uint32, 0x110000)


_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(letter_table())
    return _TABLE[0]


class Letters:
    """The vectors of letters by code point; that of 0, for gaps between words, takes part like a letter."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.known: dict[int, np.ndarray] = {}

    def vector(self, code: int) -> np.ndarray:
        if code not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[code] = np.random.default_rng([7, code]).choice(np.array([-1, 1], np.int8), self.dimensions)
        return self.known[code]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return np.array([self.vector(int(c)) for c in codes], np.int8).reshape(-1, self.dimensions)


def ngram_vectors(codes: np.ndarray, letters: Letters) -> np.ndarray:
    """Bound vectors of n-gram codes (BITS a letter, first letter leading)."""
    out = np.ones((len(codes), letters.dimensions), np.int8)
    for place in range(N):
        own, which = np.unique(codes >> np.uint64(BITS * place) & np.uint64((1 << BITS) - 1), return_inverse=True)
        out *= np.roll(letters.vectors(own), place, axis=1)[which]
    return out.astype(np.float32)


def profiles(texts: list[bytes], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, number of letters) of texts. Whole texts count, a block of them at a time."""
    table, out, n = _table(), np.zeros((len(texts), letters.dimensions), np.float32), np.zeros(len(texts), np.int64)
    rows, codes, counts = [], [], []
    for j, text in enumerate(texts):
        points = table[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)]
        n[j] = np.count_nonzero(points)
        if not n[j]:
            continue
        # a run of other characters is one gap; one stands at either end
        points = np.concatenate([[0], points, [0]]).astype(np.uint64)
        points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
        code, count = np.unique(points[:-2] << np.uint64(2 * BITS) | points[1:-1] << np.uint64(BITS) | points[2:], return_counts=True)
        rows.append(np.full(len(code), j))
        codes.append(code)
        counts.append(count)
    if not rows:
        return out, n
    row, count = np.concatenate(rows), np.concatenate(counts)
    own, column = np.unique(np.concatenate(codes), return_inverse=True)
    order = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[order], np.arange(0, len(own) + CHUNK, CHUNK))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        at = order[lo:hi]
        dense = np.zeros((len(texts), min(CHUNK, len(own) - k * CHUNK)), np.float32)
        dense[row[at], column[at] - k * CHUNK] = count[at]
        out += dense @ ngram_vectors(own[k * CHUNK : (k + 1) * CHUNK], letters)
    return out, n


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 2 << 20):
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST_TRAINING, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language of ``labelled``, of unit length.

    At most about ``most`` rows of a language are used, chosen by a hash of id, so that the choice is the
    same in every run. Null languages and texts without letters are left out. The driver gets one
    vector per language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    share = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(min(1.0, most / n))) for lang, n in sizes.items()], F.lit(0.0))
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)) < share * F.lit(1_000_003)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dimensions), {}
        for batch in _blocks(batches):
            vectors, n = profiles(values(batch.column("text")), letters)
            lang = np.array(batch.column("lang").to_pylist(), object)
            for x in set(lang[n > 0]):
                own = vectors[(lang == x) & (n > 0)]
                sums[x] = sums.get(x, 0) + (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    parts = rows.where(chosen).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    out: dict[str, np.ndarray] = {}
    for lang, v in total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("v")).collect():
        v = np.array(v)
        out[lang] = v / max(np.linalg.norm(v), 1e-9)
    return dict(sorted(out.items()))


def classify(texts: list[bytes], prototypes: dict[str, np.ndarray], letters: Letters) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, scores, whether each is known, number of letters) of texts."""
    vectors, n = profiles(texts, letters)
    names = list(prototypes)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool), n
    cosine = (vectors @ np.array([prototypes[x] for x in names], np.float32).T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    best, known = cosine.argmax(axis=1), n > 0
    score = np.where(known, np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1), 0.0)
    return [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, known, n


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred, score (cosine, 0 to 1) and n_letters of every row's whole text.

    A text that is null or has no letters is ``und`` with score 0, as is every text when there are no
    prototypes. Equal cosines go to the language that is first by name. Rows that repeat are all
    scored. Other columns of the input aren't carried. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(len(next(iter(prototypes.values()))) if prototypes else DIMENSIONS)
        for batch in _blocks(batches):
            lang, score, _, n = classify(values(batch.column("text")), prototypes, letters)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang, pa.string()), pa.array(score), pa.array(n)], names=["key", "lang_pred", "score", "n_letters"])

    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, n_letters long").withColumnRenamed("key", id_col)


def keep_known(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language by ``predict``: those that it calls ``und`` go, and
    those it scores under ``least`` (at 0 none: short texts score as low as texts in no known language).

    Without prototypes nothing can be told of languages, and texts with letters stay. Null and empty texts
    and those without letters go; rows that repeat are judged each; an empty table stays empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(len(next(iter(prototypes.values()))) if prototypes else DIMENSIONS)
        for batch in by_bytes(batches, text_col, 2 << 20):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lang, score, _, n = classify(values(part.column(text_col)), prototypes, letters)
                kept = (np.array(lang, object) != UNKNOWN) & (score >= least) if prototypes else n > 0
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prototypes = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, prototypes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language": op2_language}
ORACLE: dict[str, str] = {}
