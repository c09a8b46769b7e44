"""Runs of words against a search of all places and periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from messy import REST, ROWS

from loomline.llm import word_runs as W


def plain_runs(w, shortest=6, times=4):
    """All maximal stretches by period, those of smaller periods first."""
    n, out, seen = len(w), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            # a longer period of the same stretch isn't its smallest
            if i + q - s >= 2 * q and (s, i + q) not in seen:
                seen.add((s, i + q))
                if i + q - s >= max(shortest, times * q):
                    out.append((s, i + q - s, q))
    return sorted(out)


def periodic(r, n=60):
    out = []
    while len(out) < n:
        unit = [r.randrange(3) for _ in range(r.randint(1, 5))]
        out += unit * r.randint(1, 6) + [r.randrange(4) for _ in range(r.randint(0, 4))]
    return out


def test_runs_of_random_words():
    r = random.Random(3)
    for k in range(600):
        w = [r.randrange(1 + k % 4) for _ in range(r.randint(0, 60))] if k % 2 else periodic(r)
        for shortest, times in ((6, 4), (1, 2), (4, 3)):
            assert W.runs(w, shortest, times) == plain_runs(w, shortest, times), w


def test_parts_lose_no_run():
    r = random.Random(4)
    for k in range(300):
        docs = [[r.randrange(2 + k % 9) for _ in range(r.randint(0, 50))] if r.random() < 0.5 else periodic(r) for _ in range(5)]
        codes, group = np.array([x for d in docs for x in d]), np.array([i for i, d in enumerate(docs) for _ in d])
        starts = np.cumsum([0, *map(len, docs)])
        got = [[] for _ in docs]
        for a, b in W.parts(codes, group):
            assert group[a] == group[b - 1]
            got[group[a]] += [(a - starts[group[a]] + s, length, q) for s, length, q in W.runs(codes[a:b].tolist())]
        assert [sorted(g) for g in got] == [plain_runs(d) for d in docs]
    assert W.parts(np.array([], int), np.array([], int)) == []


def test_ends_keep_their_order():
    r = random.Random(5)
    xs = r.sample(range(20_000), 6000)
    ends, there = W.Ends(xs[0]), {xs[0]}
    for i, x in enumerate(xs[1:]):
        got = ends.add(x)
        if i % 50 == 0:
            assert got == (max((y for y in there if y < x), default=-1), min((y for y in there if y > x), default=-1))
        there.add(x)
    assert list(ends) == sorted(xs) and ends.size == len(xs)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    code = {x: k for k, x in enumerate(dict.fromkeys(w))}
    runs = plain_runs([code[x] for x in w])
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda x: (x[0], x[2])))
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    space = lambda: r.choice([" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"])
    no_space = ["\x1c", "\x85", "\xa0", " ", "日本", "🙂"]
    text = lambda: space() + "".join(x + space() for x in (str(c) if c < 2 else r.choice(["x", *no_space]) for c in periodic(r, r.choice([0, 8, 40, 90]))))
    # every tenth checksum or so is planted
    return [(1000 + k, text().strip(" ") if k % 3 else text()) for k in range(150)] + [(2000 + k, " ".join(f"w{r.randrange(500)}" for _ in range(200))) for k in range(60)]


def test_query_against_plain_search(spark, tmp_path, rows):
    short = [r for r in ROWS if len(r[1] or "") < 1000]
    every = [(i, t, None, None, 0, *REST) for i, t in rows] + [(*r, 0, *REST) for r in short]
    from messy import SCHEMA

    spark.createDataFrame(every, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = W.op13_word_runs(spark, str(tmp_path))
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted((expected(r[0], r[1]) for r in every), key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in every) > 10


def test_long_texts_other_columns_and_empty_tables(spark, docs, no_docs):
    got = {(r.doc_id, r.n_words): r for r in W.find(docs).collect()}
    assert [tuple(x) for x in got[8, 60_000].runs] == [(0, 60_000, 1)] and got[8, 60_000].collapsed == "word"
    assert [tuple(x) for x in got[9, 60_001].runs] == [(0, 60_000, 1)] and got[9, 60_001].collapsed == "word end"
    assert W.find(docs).count() == len(ROWS) and got[4, 0].collapsed == "" and got[4, 0].runs == []
    assert W.digests(W.find(no_docs)).count() == 0
    ids = spark.createDataFrame([(None, "a a a a a a"), ("k", None)], "`doc_id` string, text string")
    assert sorted((str(r.doc_id), r.n_runs) for r in W.digests(W.find(ids)).collect()) == [("None", 1), ("k", 0)]
    with pytest.raises(ValueError):
        W.find(docs, times=1)
