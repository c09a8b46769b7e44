import hashlib
import re

import pyarrow as pa
from messy import ROWS

from loomline.llm import exact_dedup as X
from loomline.llm.exact_dedup import ContentTable, dedup, grace, keep_first, normalise


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check(rows, got):
    by_text = {}
    for doc, text, *_ in rows:
        by_text.setdefault(plain(text), []).append(doc)
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        group = next(v for t, v in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(group), len(group)) and r.doc_id in group
        kept.setdefault(r.text_sha256, []).append(r.kept) if r.kept else None
    assert all(len(v) == 1 for v in kept.values()) and len(kept) == len(by_text)


def test_matches_brute_force(docs):
    check(ROWS, dedup(docs).collect())


def test_empty_table(no_docs):
    assert dedup(no_docs).count() == 0


def test_keep_first_keeps_rows_whole(docs):
    out = keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == [1, 3, 4, 6, 7, 8, 9, 10, 11]


def test_normalise():
    for text in ("", " ", "a", " a", "a ", " a \n b\x0b\x0c ", "\x1c a\x85"):
        assert normalise(text.encode()).decode() == plain(text)


def test_table_compares_contents_whatever_the_hash():
    table = ContentTable(2)
    got = [table.put(5, b"%d" % (i % 40)) for i in range(100)]
    assert [k for k, _ in got] == [i % 40 for i in range(100)] and sum(new for _, new in got) == 40


def test_spills_and_recursion_give_the_same(tmp_path):
    rows = [(i, i % 7, hashlib.sha256(b"%d" % (i % 50)).hexdigest(), b"%d" % (i % 50) * 20, 1) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), X.SPILL.types)], schema=X.SPILL)
    for limit in (1 << 30, 2000, 1):
        got = [r for b in grace(f"file://{tmp_path}", limit)([batch]) for r in b.to_pylist()]
        assert sorted((r["rep"], r["lead"], r["id"], r["n"]) for r in got) == [(i, i % 50, i % 7, 1) for i in range(300)]
        assert list(tmp_path.iterdir()) == []


def test_digests_that_collide_stay_apart(tmp_path):
    sha = hashlib.sha256(b"").hexdigest()
    rows = [(i, i, sha, b"%d" % (i % 30), 1) for i in range(90)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), X.SPILL.types)], schema=X.SPILL)
    got = [r for b in grace(f"file://{tmp_path}", 70)([batch]) for r in b.to_pylist()]
    assert sorted((r["rep"], r["lead"]) for r in got) == [(i, i % 30) for i in range(90)]


def test_hot_contents_go_in_shares(spark):
    """Null ids, many windows and a content with more representatives than one task folds."""
    rows = [(i if i % 9 else None, "same  text" if i % 3 else f"own {i % 50}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = dedup(docs, memory_mb=0.005, hot=3).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(plain(t).encode()).hexdigest(), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    assert len(got) == len(rows) and sorted(x.text_sha256 for x in got if x.kept) == sorted(groups)
    for x in got:
        assert (x.keep_id, x.group_size) == (least[x.text_sha256], len(groups[x.text_sha256]))
        assert not x.kept or x.doc_id == x.keep_id


def test_small_windows(docs):
    tagged = docs.select("doc_id", "text").toDF("id", "text").mapInArrow(X.tag(64), X.TAGGED)
    assert tagged.count() == len(ROWS)
