"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by id; each partition encodes its documents with the
tokenizers library and writes one shard: an Arrow file whose record batches hold two fixed-size-list
columns, ``input_ids`` (the narrowest unsigned integers that hold the vocabulary) and ``mask`` (bits, unset
where the last sequence is padded), and a second Arrow file with doc_id, start in the shard and n_tokens of each document. Sequences run on across
documents. The files' footers locate every batch, so a reader that maps a file gets any sequence
as a view, without a copy. Names are made anew by each task attempt; the manifest lists those of
the attempts that counted.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .batches import by_bytes
from .byte_bpe import ragged, ragged_of

#: The public vocabulary's name; public_tokenizers.path(name) is its place on each machine.
VOCABULARY = "word_bpe_49k.json"
LENGTH = 1024
#: Words whose ids a process keeps from batch to batch, some 20 MB.
KEPT = 400_000
ROWS = 256
MARK = r"([0-9A-Za-z])([.,;:!?)])(?:[ \t-\r]|$)"
MANIFEST = "shard int, path string, docs_path string, n_docs long, n_ids long, n_rows long"


class WordBPE:
    """Encodes whole texts by encoding each distinct word of a batch once, and words that recur once a process.

    The vocabulary's normaliser and splitter keep nothing across white space, and lower-case, so a
    text's ids are those of its words in turn. Words are encoded many at a time, between separators.
    """

    SEPARATOR = "\x01"

    def __init__(self, path: str = VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path if os.path.exists(path) else public_tokenizers.path(path))
        self.words, self.ids, self.at = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.place = np.zeros(0, np.int64)
        (self.separator,) = self.tokenizer.encode(self.SEPARATOR, add_special_tokens=False).ids

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sep, many = f" {self.SEPARATOR} ", 500
        odd = [j for j, w in enumerate(words) if self.SEPARATOR in w]
        plain = [w if self.SEPARATOR not in w else "" for w in words]
        joined = [sep.join(plain[i : i + many]) + sep for i in range(0, len(plain), many)]
        ids = np.fromiter((i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids), np.uint32)
        ends = np.flatnonzero(ids == self.separator)
        assert len(ends) == len(words), "the separator isn't a token by itself"
        at = np.concatenate([[0], ends - np.arange(len(ends))])
        ids = ids[ids != self.separator]
        if odd:
            rows = [ids[at[j] : at[j + 1]].tolist() for j in range(len(words))]
            for j in odd:
                rows[j] = self.tokenizer.encode(words[j], add_special_tokens=False).ids
            return ragged_of(rows, np.uint32)
        return ids, at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column's texts (null: none), flat, and where each text's begin."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # special tokens are written in lower case, so texts that may hold one keep their case
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        # a mark after a letter or digit is a token by itself: words then recur with and without it
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, MARK, r"\1 \2 "))
        at = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        codes = coded.indices.to_numpy()
        ids, id_at = ragged(*self._table(coded.dictionary, codes), self.place[codes])
        return ids, id_at[at - at[0]]

    def _table(self, words: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words kept and of this batch's other words, and in ``place`` where each of ``words`` is among them."""
        found = pc.index_in(words, value_set=self.words)
        is_new = found.is_null().to_numpy(zero_copy_only=False)
        self.place = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        self.place[is_new] = len(self.words) + np.arange(is_new.sum())
        others = words.filter(pa.array(is_new))
        flat, at = self._encode_words(others.to_pylist())
        ids, ends = np.concatenate([self.ids, flat.astype(np.uint32)]), np.concatenate([self.at, self.at[-1] + at[1:]])
        # words met twice in a batch are likely to come again
        again = np.flatnonzero(np.bincount(codes, minlength=len(words))[is_new] > 1)
        if len(self.words) + len(again) > KEPT:
            self.words, self.ids, self.at = words.slice(0, 0), np.zeros(0, np.uint32), np.zeros(1, np.int64)
        kept, kept_at = ragged(flat, at, again)
        self.words = pa.concat_arrays([self.words, others.take(pa.array(again))])
        self.ids, self.at = np.concatenate([self.ids, kept.astype(np.uint32)]), np.concatenate([self.at, self.at[-1] + kept_at[1:]])
        return ids, ends


@lru_cache(maxsize=2)
def codec(path: str = VOCABULARY) -> WordBPE:
    """The process's own codec: worker processes keep it from task to task."""
    return WordBPE(path)


def sequence_schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences, a batch at a time."""

    def __init__(self, sink, length: int, most: int, rows: int = ROWS):
        """``most``: the largest id."""
        self.dtype = np.uint16 if most < 1 << 16 else np.uint32
        self.schema = sequence_schema(length, pa.from_numpy_dtype(self.dtype))
        self.file = pa.ipc.new_file(sink, self.schema)
        self.length, self.rows = length, rows
        self.held: list[np.ndarray] = []
        self.waiting = self.n_rows = 0

    def put(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.length * self.rows:
            flat, block = np.concatenate(self.held), self.length * self.rows
            whole = len(flat) // block * block
            for i in range(0, whole, block):
                self._write(flat[i : i + block])
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray) -> None:
        pad = -len(flat) % self.length
        mask = np.arange(len(flat) + pad) < len(flat)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (np.pad(flat.astype(self.dtype), (0, pad)), mask)]
        self.n_rows += len(lists[0])
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(np.concatenate(self.held))
        self.file.close()


class Sequences:
    """Random access to one shard's sequences; views of the mapped file where it is local."""

    def __init__(self, uri: str):
        fs, path = scratch.open_fs(uri)
        local = fs.type_name == "local"
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.file.schema.field("input_ids").type.list_size

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(input_ids, mask) of sequence ``i``, both views."""
        ids, mask = (c.values.slice(i % ROWS * self.length, self.length) for c in self.file.get_batch(i // ROWS).columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self) -> Iterator[np.ndarray]:
        """All real ids in order, a batch at a time."""
        for b in range(self.file.num_record_batches):
            ids, mask = (c.values for c in self.file.get_batch(b).columns)
            yield ids.to_numpy(zero_copy_only=True)[: mask.true_count]


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write shards in ascending order of id.

    Returns the manifest: shard, path, docs_path, n_docs, n_ids, n_rows, and ``offset``, the ids in all
    shards before. A null text has only the end id. Null ids come first; rows that repeat an id are
    in order of their text's hash. Other columns aren't written. An empty table writes nothing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, shard = codec(path), TaskContext.get().partitionId()
        own = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        writer = None
        n_docs = n_ids = 0
        for batch in by_bytes(batches, "text", 12 << 20):
            if writer is None:
                fs, top = scratch.open_fs(own)
                fs.create_dir(top.rpartition("/")[0], recursive=True)
                sinks = [fs.open_output_stream(f"{top}{x}.arrow") for x in ("", ".docs")]
                writer, index = SequenceWriter(sinks[0], length, max(end_id, bpe.tokenizer.get_vocab_size() - 1)), pa.ipc.new_file(sinks[1], DOCS)
            ids, at = bpe.encode(batch.column("text"))
            n = np.diff(at) + 1
            writer.put(np.insert(ids, at[1:], np.uint32(end_id)))
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_ids + np.cumsum(n) - n), pa.array(n)], schema=DOCS))
            n_docs, n_ids = n_docs + len(n), n_ids + int(n.sum())
        if writer:
            for x in (writer, index, *sinks):
                x.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{own}.arrow"], "docs_path": [f"{own}.docs.arrow"], "n_docs": [n_docs], "n_ids": [n_ids], "n_rows": [writer.n_rows]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    manifest = scratch.write_table(ordered.mapInArrow(run, MANIFEST), "token-manifest")
    # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the shards back, each in a task of its own: one row per document with doc_id, start (ids before it
    in all shards), n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit integers).

    Null ids, repeated ids and documents of the end id alone come back as they were written; a
    manifest without shards gives an empty result. Other columns of the manifest aren't read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, docs_path, offset in zip(*(batch.column(c).to_pylist() for c in ("path", "docs_path", "offset")), strict=True):
                fs, name = scratch.open_fs(docs_path)
                blocks, block = Sequences(path).ids(), np.zeros(0, np.uint16)
                with fs.open_input_file(name) as source:
                    index = pa.ipc.open_file(source)
                    for b in range(index.num_record_batches):
                        doc, start, n = index.get_batch(b).columns
                        crcs = []
                        for left in n.to_pylist():
                            crc = 0
                            while left:
                                if not len(block):
                                    block = next(blocks)
                                crc = zlib.crc32(block[:left].astype("<u4"), crc)
                                left, block = left - len(block[:left]), block[left:]
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays([doc, pc.add(start, offset), n, pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a given number, as the manifest's few bytes say nothing of the files' size
    shards = manifest.select("shard", "path", "docs_path", "offset")
    return shards.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.new_path(spark, "tokens"))
    return read_documents(manifest)


QUERIES = {"op5_token_files": op5_token_files}
ORACLE: dict[str, str] = {}
