"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file's tokens are byte strings. The library works on characters, so each byte stands for one
printable character, and the ranks become merge rules: every way to split a token into two tokens
merges at that token's rank. The split pattern is applied first and each match is encoded by itself.

Most words recur, so a batch's texts are cut where a space precedes a character that isn't white space,
which is always a boundary of the pattern; Arrow finds the distinct pieces, each is split and encoded
once, and the texts' ids are gathered from the pieces'.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes, values

#: The public vocabulary's name; public_tokenizers.path(name) is its place on each machine.
RANKS = "byte_bpe_multi_50k.tiktoken"
CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" (?:\s|\Z)")
#: Fixed values. Code points that became letters or numbers after version 16 of Unicode, whose classes the
#: ranks' own library has: to the pattern they are neither, whatever version ``regex`` has.
LATER = re.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: A code point without a class, of which runs match as LATER's have to.
UNASSIGNED = "\u0378"
#: Marks that, after letters, are a match of the pattern by themselves at a piece's end.
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[]^_{|}~")


def ragged_of(rows: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers or bytes, flat, and where each begins (with the end)."""
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=at[1:])
    flat = np.frombuffer(b"".join(rows), dtype) if rows and isinstance(rows[0], bytes) else np.fromiter(chain.from_iterable(rows), dtype, int(at[-1]))
    return flat, at


def ragged(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The named rows of a flat table, flat again, and where each begins."""
    starts = at[rows]
    lens = at[rows + 1] - starts
    to = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lens, out=to[1:])
    narrow = np.int32 if max(to[-1], at[-1]) < 1 << 31 else np.int64
    source = np.repeat((starts - to[:-1]).astype(narrow), lens)
    source += np.arange(to[-1], dtype=narrow)
    return flat[source], to


def byte_chars() -> list[str]:
    """The printable character of each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one rank file; ``path`` is a file name or a public vocabulary's name."""

    def __init__(self, path: str = RANKS, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, models

        import public_tokenizers

        with open(path if os.path.exists(path) else public_tokenizers.path(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        chars = byte_chars()
        self.to_chars = {b: c for b, c in enumerate(chars)}
        text = lambda b: "".join(chars[x] for x in b)
        merges = [(text(t[:i]), text(t[i:])) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        #: The reverse byte table: id -> bytes.
        back = {c: b for b, c in enumerate(chars)}
        self.table = {i: bytes(back[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        size = max(self.table) + 1
        #: The same flat, and each id's decimal digits and a comma, padded to one width.
        self.bytes = ragged_of([self.table.get(i, b"") for i in range(size)], np.uint8)
        digits = [f"{i},".encode() for i in range(size)]
        self.digits = np.frombuffer(b"".join(d.ljust(8, b"\0") for d in digits), np.uint8).reshape(size, 8)[:, : max(map(len, digits))]

    def find(self, text: str) -> list[str]:
        """The pattern's matches in a text."""
        if text.isascii() or not LATER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(LATER.sub(UNASSIGNED, text))]

    def _encode_pieces(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are cut in pieces, flat, and where each text's begin."""
        at = cut.offsets.to_numpy().astype(np.int64)
        flat = cut.values.slice(at[0], at[-1] - at[0])
        at = at - at[0]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        later = coded.dictionary.to_pylist()
        # the piece at a text's start has no space before it
        first = flat.take(pa.array(at[:-1])).to_pylist()
        codes[at[:-1]] = len(later) + np.arange(len(first))
        known: dict[str, int] = {}
        matches, ends = [], [0]
        for lead, pieces in ((" ", later), ("", first)):
            for p in pieces:
                if p.isalpha() and (p.isascii() or not LATER.search(p)):  # one match of the pattern
                    matches.append(known.setdefault(lead + p, len(known)))
                elif p[-1:] in MARKS and p[:-1].isalpha() and (p.isascii() or not LATER.search(p)):
                    matches.append(known.setdefault(lead + p[:-1], len(known)))
                    matches.append(known.setdefault(p[-1], len(known)))
                else:
                    matches += [known.setdefault(m, len(known)) for m in self.find(lead + p)]
                ends.append(len(matches))
        done = self.tokenizer.encode_batch_fast([m.encode().decode("latin-1").translate(self.to_chars) for m in known], add_special_tokens=False)
        of_match = ragged_of([e.ids for e in done], np.int32)
        ids, id_at = ragged(*of_match, np.array(matches, np.int64))
        of_piece = ids, id_at[np.array(ends)]
        ids, id_at = ragged(*of_piece, codes)
        return ids, id_at[at]

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        odd = np.array([bool(ODD.search(t)) for t in texts], bool)
        groups = []
        for want in (False, True):
            own = [t for t, o in zip(texts, odd, strict=True) if o == want]
            if own:
                cut = pa.array([CUT.split(t) for t in own], pa.list_(pa.string())) if want else pc.split_pattern(pa.array(own, pa.string()), " ")
                groups.append(zip(*(lambda ids, at: (at[:-1], at[1:], [ids] * len(own)))(*self._encode_pieces(cut)), strict=True))
            else:
                groups.append(iter(()))
        for o in odd:
            lo, hi, ids = next(groups[int(o)])
            yield ids[lo:hi]

    def decimal(self, ids: np.ndarray) -> bytes:
        """Ids in decimal, joined by commas."""
        digits = self.digits[ids].ravel()
        return digits[digits != 0][:-1].tobytes()

    def decode_ids(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; characters that tokens split are whole again here."""
        return ragged(*self.bytes, np.asarray(ids, np.int64))[0].tobytes()

    def offsets(self, data: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters [start, end) that each id's bytes touch; ids that share a character overlap in it."""
        ends = np.cumsum([len(self.table[i]) for i in ids.tolist()]) if len(ids) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends
        leads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        return leads[starts] - 1, leads[ends - 1]


@lru_cache(maxsize=2)
def codec(path: str = RANKS) -> ByteBPE:
    """The process's own codec: worker processes keep it from task to task."""
    return ByteBPE(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, offsets: bool = False) -> DataFrame:
    """ids (array of int) of each row's whole text; with ``offsets`` also starts and ends in characters.

    A null or empty text has no ids. Rows that repeat are encoded each. Other columns of the input
    aren't carried. An empty table gives an empty result.
    """
    types = [("key", docs.schema[id_col].dataType.simpleString()), ("ids", "array<int>"), *([("starts", "array<int>"), ("ends", "array<int>")] if offsets else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in by_bytes(batches, "text", 16 << 20):
            data = values(batch.column("text"))
            ids = list(bpe.encode_texts([d.decode() for d in data]))
            cols = [batch.column("key"), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                cols += [pa.array(x, pa.list_(pa.int32())) for x in zip(*(bpe.offsets(d, i) for d, i in zip(data, ids, strict=True)), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in types])

    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in types))
    return out.withColumnRenamed("key", id_col)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = RANKS) -> DataFrame:
    """data (bytes) and text of each row's ids. Null ids give empty data; bytes that aren't UTF-8, as of
    a cut sequence, appear as the replacement character in text only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            data = [bpe.decode_ids(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(data, pa.binary()), pa.array([d.decode(errors="replace") for d in data], pa.string())], names=["key", "data", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("key"), F.col(ids_col).alias("ids")).mapInArrow(run, f"key {kind}, data binary, text string").withColumnRenamed("key", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both.

    Returns per row: the id column, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes), and with ``with_ids`` the ids themselves. Nulls, repeats and other columns are as in ``encode``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in by_bytes(batches, "text", 8 << 20):
            rows, coded = [], []
            for ids in bpe.encode_texts([d.decode() for d in values(batch.column("text"))]):
                coded.append(ids)
                rows.append((len(ids), hashlib.sha256(bpe.decimal(ids)).hexdigest(), hashlib.sha256(bpe.decode_ids(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            cols = [batch.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *([pa.array(coded, pa.list_(pa.int32()))] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("key", id_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLE: dict[str, str] = {}
