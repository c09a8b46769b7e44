import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, cell string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) if x is not None else None for x in v], 0, None, None, None) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)], SCHEMA)


def brute(vectors, ids, queries, k=5):
    v = np.array(vectors, np.float32).astype(float)
    n = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in queries:
        j = list(ids).index(q)
        s = (v * v[j]).sum(axis=1) / (n * n[j])
        order = [i for i in np.lexsort((ids, -s)) if i != j][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("cell", [16_384, 100])
def test_recall_against_brute_force(spark, cell):
    r = np.random.default_rng(0)
    vectors = np.concatenate([r.standard_normal((800, 32)), np.repeat(r.standard_normal((1, 32)), 300, axis=0)])
    ids = np.arange(len(vectors))
    got = by_query(ann.nearest(table(spark, vectors), F.col("vec_id") % 20 == 0, cell=cell))
    want = brute(vectors, ids, ids[ids % 20 == 0])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits / sum(map(len, want.values())) >= 0.95
    # ties of equal vectors go to the smaller ids
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if q >= 800)
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q][i]) < 1e-12 for q, v in got.items() for i, s in v if i in scores[q])


def test_odd_vectors(spark):
    rows = [[1, 0], [0, 0], None, [float("nan"), 1], [None, 1], [float("inf"), 0], [1, 1], [1, 2, 3], [], [1e-30, 1e-30], [3e37, 0]]
    got = by_query(ann.nearest(table(spark, rows), F.lit(True)))
    assert set(got) == {0, 6, 9, 10} and got[0][0][0] == 10 and {i for i, _ in got[0][1:]} == {6, 9}
    assert got[6][0][0] == 9 and math.isclose(got[6][0][1], 1.0, abs_tol=1e-12)
    assert ann.nearest(table(spark, []), F.lit(True)).count() == 0
    assert ann.nearest(table(spark, rows), F.lit(False)).count() == 0
    assert ann.nearest(table(spark, [[1, 0], [1, 0], [0, 1]], [7, 7, 8]), F.lit(True)).count() == 2


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(ann.chi_square_quantile(0.99, 2) - 9.2103) < 1e-3


def test_test_stops_the_search_where_vectors_have_structure():
    """On vectors of five intrinsic dimensions few rows are verified, and ever fewer of more; the neighbours are those of all."""
    share = []
    for n in (2000, 8000):
        r = np.random.default_rng(5)
        v = r.standard_normal((n, 5)) @ r.standard_normal((5, 64)) + 0.01 * r.standard_normal((n, 64))
        piece, hits = ann.Piece(np.arange(n), v, ann.M), 0
        points = ann.unit(v) @ ann.directions(64, ann.M)
        for q in range(0, n, n // 50):
            got = piece.search(q, v[q], points[q], 5, 4.0, ann.chi_square_quantile(ann.CONFIDENCE, ann.M))
            hits += len({i for _, i in got} & {i for i, _ in brute(v, np.arange(n), [q])[q]})
        share.append(piece.verified / 50 / n)
        assert hits >= 0.95 * 250
    assert share[1] < 0.6 * share[0] < 0.15


def test_repeated_ids_are_one_row(spark):
    # the smallest vector of an id stands: of 1 that is [0.9, 0.5]
    d = table(spark, [[1, 0], [0.99, 0.1], [0.9, 0.5], [0, 1], [1, 0.05], [1, 0.05]], [0, 1, 1, 3, 4, 4])
    got = by_query(ann.nearest(d, F.col("vec_id") == 0, k=3))
    assert [i for i, _ in got[0]] == [4, 1, 3] and math.isclose(got[0][1][1], 0.9 / math.hypot(0.9, 0.5), rel_tol=1e-6)
    r = np.random.default_rng(3)
    ids = np.concatenate([np.arange(300), np.full(150, 7), np.arange(0, 300, 3)])
    vectors = r.standard_normal((len(ids), 12))
    one = {}
    for i, v in zip(ids.tolist(), vectors.astype(np.float32)):
        one[i] = min(one.get(i, tuple(v)), tuple(v))
    got = by_query(ann.nearest(table(spark, vectors, ids), F.col("vec_id") % 20 == 7, cell=60))
    want = brute(np.array([one[i] for i in range(300)]), np.arange(300), range(7, 300, 20))
    assert set(got) == set(want) and all(len({i for i, _ in v}) == 5 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
