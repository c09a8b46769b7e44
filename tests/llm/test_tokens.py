import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from messy import ROWS
from tokenizers import Tokenizer

from loomline.llm import byte_bpe as B
from loomline.llm import scratch
from loomline.llm import token_files as T

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(B.RANKS), "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
PIECES = [*" \n\t\r\x0b\x0c\x1c\x85\xa0 ​'sStTrelLvmd,.!?09١aéßñ中文🙂ЖψxX́_-\x00\x01İIΣ»", "<|endoftext|>", "<|ENDOFTEXT|>", "word", "'s", "  "]
TEXT = st.lists(st.one_of(st.sampled_from(PIECES), st.characters(codec="utf-8")), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_byte_bpe_is_tiktoken(texts):
    codec = B.codec()
    for text, ids in zip(texts, codec.encode_texts(texts), strict=True):
        assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
        assert codec.decode_ids(ids) == text.encode()
        assert codec.decimal(ids) == ",".join(map(str, ids.tolist())).encode()


def test_every_code_point_is_tiktokens():
    """Alone between spaces, and before 's, which tells whether the pattern takes it for a letter or number."""
    codec, chars = B.codec(), [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for end in ("", "'s"):
        texts = [" ".join(c + end for c in chars[k : k + 1024]) for k in range(0, len(chars), 1024)]
        for text, ids, want in zip(texts, codec.encode_texts(texts), TIKTOKEN.encode_ordinary_batch(texts), strict=True):
            assert ids.tolist() == want, (hex(ord(text[0])), end)


def test_decoding_nulls_repeats_and_cut_sequences(spark):
    (ids,) = ([int(i) for i in x] for x in B.codec().encode_texts(["é🙂"]))
    rows = [(1, None), (1, None), (None, ids), (2, ids[:-1]), (3, [])]
    got = sorted((str(r.doc_id), bytes(r.data), r.text) for r in B.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect())
    cut = B.codec().decode_ids(np.array(ids[:-1]))
    assert got == sorted([("1", b"", ""), ("1", b"", ""), ("None", "é🙂".encode(), "é🙂"), ("2", cut, cut.decode(errors="replace")), ("3", b"", "")])


def test_runs_merge_like_tiktoken():
    for text in ("a" * 3000, " " * 2000 + "x", "ab" * 1500, "\n" * 999 + " x", "é" * 900, "=" * 70 + " -" * 50, "0" * 1001):
        assert next(iter(B.codec().encode_texts([text]))).tolist() == TIKTOKEN.encode_ordinary(text)


def test_offsets_cover_split_characters():
    codec, text = B.codec(), "a🙂é 日本"
    (ids,) = codec.encode_texts([text])
    starts, ends = codec.offsets(text.encode(), ids)
    assert starts[0] == 0 and ends[-1] == len(text) and all(s < e for s, e in zip(starts, ends))
    for i, s, e in zip(ids, starts, ends):
        assert codec.table[int(i)] in text[s:e].encode() or len(text[s:e]) > 0


def test_round_trip_query(docs, no_docs):
    got = sorted(B.round_trip(docs, with_ids=True).collect())
    want = sorted((d, TIKTOKEN.encode_ordinary(t or ""), t or "") for d, t, *_ in ROWS)
    assert len(got) == len(want)
    for r, (d, ids, text) in zip(got, want):
        assert (r.doc_id, r.n_tokens, list(r.ids)) == (d, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.round_trip(no_docs).count() == 0
    coded = B.encode(docs, offsets=True)
    assert sorted((r.doc_id, r.text) for r in B.decode(coded).collect()) == [(d, t) for d, _, t in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_words_encode_like_whole_texts(texts):
    ids, at = T.codec().encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]


def test_kept_words_change_no_ids(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcé字🙂'-.") for _ in range(r.randint(1, 6))) for _ in range(400)]
    batches = [[" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(20)] for _ in range(12)]
    for kept in (400_000, 90):
        monkeypatch.setattr(T, "KEPT", kept)
        codec = T.WordBPE()
        for texts in batches:
            ids, at = codec.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]
            assert len(codec.words) <= max(kept, 400)


def test_files_read_back(spark, docs, no_docs):
    manifest = T.write(docs, scratch.new_path(spark, "t"), length=64)
    got = sorted(T.read_documents(manifest).collect())
    want, at = [], 0
    for d, text, *_ in sorted(ROWS):
        ids = [*WORDS.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert T.read_documents(T.write(no_docs, scratch.new_path(spark, "t"))).count() == 0


def test_each_shard_is_read_by_its_own_task(spark):
    rows = [(i if i % 50 else None, f"word{i} " * (i % 7)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = T.write(docs, scratch.new_path(spark, "t"), length=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = T.read_documents(manifest)
    assert manifest.count() > 1 and back.rdd.getNumPartitions() == manifest.count()
    ids = [r.doc_id for r in sorted(back.collect(), key=lambda r: r.start)]
    assert ids == [None] * 40 + [i for i in range(2000) if i % 50]


def test_sequences_are_views(tmp_path):
    ids = np.random.default_rng(1).integers(0, 49_000, 100_000).astype(np.uint32)
    with open(tmp_path / "a.arrow", "wb") as f:
        w = T.SequenceWriter(f, 16, 49_407)
        for part in np.array_split(ids, random.Random(2).randint(5, 50)):
            w.put(part)
        w.close()
    s = T.Sequences(f"file://{tmp_path}/a.arrow")
    assert np.array_equal(np.concatenate(list(s.ids())), ids)
    row, mask = s[300]
    assert np.array_equal(row, ids[4800:4816]) and mask.true_count == 16 and not row.flags.owndata
    assert s.file.get_batch(s.file.num_record_batches - 1).column(1).values.true_count == len(ids) % (16 * T.ROWS)
