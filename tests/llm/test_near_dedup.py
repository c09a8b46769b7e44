import random
import re

import numpy as np
import pyarrow as pa
import pytest
from messy import ROWS

from loomline.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=2):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    n = min(k, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def brute(rows, k=2):
    sets, parent = {}, {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(shingles(text, k))
        parent[doc] = doc

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = list(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {doc: find(doc) for doc in docs}


def families():
    """Copies, near copies of one original that aren't near each other, chains, and texts that share a passage."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, doc = [], 100
    passage = [word() for _ in range(60)]
    for f in range(6):
        original = [word() for _ in range(120)]
        for k in range(12):
            w = list(original)
            for j in r.sample(range(120), [0, 2, 5, 6][k % 4]):
                w[j] = word()
            rows.append((doc, " ".join(w)))
            doc -= 1
        rows.append((1000 + f, " ".join(passage + [word() for _ in range(r.randint(20, 60))])))
    chain = [word() for _ in range(100)]
    for k in range(8):
        for j in range(k * 5, k * 5 + 5):
            chain[j] = word()
        rows.append((2000 + k, " ".join(chain)))
    return rows + [(3000 + k, "same words here again") for k in range(30)]


@pytest.mark.parametrize("k", [2, 5])
def test_matches_brute_force(spark, k):
    rows = families()
    got = {r.doc_id: r for r in N.cluster(spark.createDataFrame(rows, "doc_id long, text string"), words=k).collect()}
    want = brute(rows, k)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[d].n_shingles == len(shingles(t, k)) and got[d].kept == (want[d] == d) for d, t in rows)


def test_odd_rows(docs, no_docs, spark):
    got = N.cluster(docs, words=2).collect()
    want = brute([r[:2] for r in ROWS])
    assert len(got) == len(ROWS) and all(r.component_id == want[r.doc_id] for r in got)
    assert N.cluster(no_docs).count() == 0
    keep = N.keep_one(docs, words=2)
    assert keep.columns == docs.columns
    nulls = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in N.cluster(nulls, words=2).collect()) == [(0, 0, True), (0, 0, True), (1, 1, True)]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(500, 200), (500, 300), (300, 7)]
    got = {r.id: r.comp for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(1, 41), 500, 200, 300]}, **{100 + i: 100 for i in range(20)}}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    a = np.sort(r.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    for size in (3, 30, 400):
        x, y = a[:size], np.unique(np.concatenate([a[: size - size // 5], r.integers(0, 2**63, 1).astype(np.uint64)]))
        s = N.signatures([np.sort(x), y], 2520)
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((s[0] == s[1]).mean() - truth) < 0.2


def test_shingle_sets_count_words():
    texts = ["A b  c\na b", " lone ", "", None, "x x x x"]
    assert [len(s) for s in N.shingle_sets(pa.array(texts), 2)] == [len(shingles(t)) for t in texts]


def templates(n=240):
    """Texts that share a template and aren't near each other, a few that are, and some whose own words are few."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    template, few = [word() for _ in range(102)], [word() for _ in range(9)]
    rows = [(k, " ".join(template + [word() for _ in range(18)])) for k in range(n)]
    rows += [(1000 + k, rows[k][1].rsplit(" ", r.randint(1, 6))[0]) for k in range(0, n, 8)]
    return rows + [(2000 + k, " ".join(template + [r.choice(few) for _ in range(30)])) for k in range(n // 4)]


def test_no_task_holds_a_whole_template(spark, monkeypatch):
    """All but a few of the texts stay apart and share buckets: pairs are found in blocks of bounded size."""
    block, likely = 16, N.likely

    def counted(*args):
        run = likely(*args)

        def checked(batches):
            sizes = {}

            def seen():
                for batch in batches:
                    for key in zip(batch.column("key").to_pylist(), batch.column("inside").to_pylist(), strict=True):
                        sizes[key] = sizes.get(key, 0) + 1
                        if sizes[key] > 3 * block:
                            raise ValueError("a block of too many nodes")
                    yield batch

            return run(seen())

        return checked

    monkeypatch.setattr(N, "likely", counted)
    monkeypatch.setattr(N, "BLOCK", block, raising=False)
    rows = templates()
    got = {r.doc_id: r.component_id for r in N.cluster(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) > 200 and any(want[d] != d for d in want)


def test_similar_sets_share_a_lead():
    r = np.random.default_rng(4)
    words = r.integers(0, 2**63, 60).astype(np.uint64)
    common = np.sort(words[:30])
    counts = np.arange(2, 32)
    for _ in range(3000):
        a = np.sort(r.choice(words, r.integers(1, 40), replace=False))
        b = np.unique(np.concatenate([r.choice(a, max(1, len(a) - r.integers(0, 3)), replace=False), r.choice(words, r.integers(0, 3))]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            small, large = sorted([a, b], key=len)
            own, leads = N.prefix(small, 80, common, counts)
            assert np.isin(own[:leads], N.prefix(large, 80, common, counts)[0]).any()
