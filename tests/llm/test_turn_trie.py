"""The trie of conversations against one that is built turn by turn."""

import hashlib
import random
import zlib

import pytest

from loomline.llm import turn_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, id long, turns int, depth string, rep int"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(rows, rebuild=True):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(x[1], x[3]) for x in sorted(ts)] for c, ts in own.items()}
    convs = dict(own)
    if rebuild:
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            convs[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members, ends = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = sum(saved[x] for x in below) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        up = min(members[k[:-1]]) if k else None
        out.append((min(members[k]), len(k), up, len(members[k]), len(below), leaves[k], saved[k], sha(",".join(map(str, sorted(ends.get(k, [])))))))
    return sorted(out, key=repr)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


def random_rows(seed=1):
    r, out = random.Random(seed), []
    for c in [*range(95, 130), *range(198, 240), 305, 307, 400, 1_000_000_007]:
        for t in range(r.choice([1, 2, 3, 5, 9])):
            out.append((c, r.choice([None, t, t]), r.choice(["user", "assistant", None, ""]), r.choice(["a", "a", "b", "日本", None, "", "ab"]), 7, 8, "x", 9))
    # one conversation very often, a long one, one with a very long text, repeated rows, and rows without an id
    out += [(c, t, "user", f"t{t}", None, None, None, None) for c in range(500, 560) for t in range(4)]
    out += [(c, t, "user", "x" * (t % 3), None, None, None, None) for c in (600, 601, 602) for t in range(120 - c % 3 * 20)]
    out += [(700, 0, "user", "word " * 60_000, None, None, None, None), (701, 3, "user", "a", 1, 1, "", 1), (701, 3, "user", "a", 1, 1, "", 1), (None, 0, "user", "lost", None, None, None, None)]
    return out


@pytest.mark.parametrize("ids_in_a_range", [4096, 7])
def test_query_against_plain_trie(spark, tmp_path, monkeypatch, ids_in_a_range):
    monkeypatch.setattr(T, "RANGE", ids_in_a_range)
    rows = random_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(T.op12_turn_trie(spark, str(tmp_path))) == plain(rows)


def test_without_rebuilding_and_negative_ids(spark):
    rows = [(c, t, "user", "abc"[(c * 7 + t) % 3 if t > 1 else 0]) for c in range(-30, 30) for t in range(1 + c % 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(T.trie(T.conversations(df))) == plain(rows, rebuild=False)


def test_empty_table_and_conversations_without_turns(spark):
    assert T.trie(T.conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    none = spark.createDataFrame([(1, []), (3, [])], "id long, turns array<struct<key:binary,chars:bigint>>")
    assert rows_of(T.trie(none)) == [(1, 0, None, 2, 0, 1, 0, sha("1,3"))]


def test_rounds_follow_the_paths_not_the_turns(spark):
    # conversation c leaves the common thread after c turns: the trie is as deep as there are conversations
    n = 200
    rows = [(c, t, "user", "x" if t < c else "own") for c in range(n) for t in range(c + 1)]
    df = T.trie(T.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert rows_of(df) == plain(rows, rebuild=False)


def test_peeling(spark):
    # 0 <- 1 <- 2 and 0 <- 3
    paths = spark.createDataFrame([(0, None, -1, 1, 5, 2), (1, 0, 2, 1, 1, 1), (2, 1, 4, 1, 2, 0), (3, 0, 1, 1, 0, 0)], "path long, to long, depth long, leaves long, saved long, pending long")
    got = {r.path: (r.leaves, r.saved, r.round) for r in T.peel(paths).collect()}
    assert got == {2: (1, 2, 0), 3: (1, 0, 0), 1: (2, 3, 1), 0: (4, 8, 2)}
    with pytest.raises(ValueError):
        T.peel(paths.where("path > 0").withColumn("pending", paths.pending + 1))
