"""Approximate nearest neighbours by stable projections and kd-trees.

Unit vectors are projected on a few random Gaussian directions: the squared projected distance of two
points at distance d is d^2 times a chi-square variable. Top-level splits, fitted on a bounded sample of
the projected points, cut the index into cells; a cell is split further by hash where it is too
full. In each piece a kd-tree yields projected neighbours, nearest leaves first, which are verified on the
original vectors, until the chi-square test says that a neighbour nearer than the k-th best by the factor
``ratio`` is unlikely to be left: the next projected distance squared is beyond the ``confidence`` quantile
times the k-th best distance squared over ratio squared. A point is verified only if its own projected
distance is within that. A query first searches its own cell, which bounds its k-th distance, and then
the cells within the test's radius. Every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

M = 24
CONFIDENCE = 0.9
SAMPLE = 20_000
#: Vectors of a piece, points of a leaf, and the sample's points that a cell has at least: there are at most SAMPLE / LEAST cells.
CELL = 8_192
LEAF = 64
LEAST = 16
#: Squared distance that rounding may put between projections of equal vectors.
SLACK = 1e-12


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(3).standard_normal((dim, m))


def unit(x: np.ndarray) -> np.ndarray:
    # a power of two first, so that squares neither overflow nor vanish
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class KDTree:
    """Median splits on the widest side, leaves of at most ``leaf`` points, tight boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        work = [(0, len(points), -1, 0)]
        while work:
            lo, hi, parent, side = work.pop()
            own = points[self.order[lo:hi]]
            me = len(self.nodes)
            self.nodes.append((lo, hi, 0, 0))
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, me, right) if side == 0 else (a, b, left, me)
            if hi - lo > leaf:
                at = int(np.argmax(self.high[-1] - self.low[-1]))
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, at], mid)]
                work += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        at = [j for j, n in enumerate(self.nodes) if not n[2]]
        at.sort(key=lambda j: self.nodes[j][0])
        #: Boxes of leaves in order of their points, and where each leaf's begin (with the end).
        self.low, self.high = np.array([self.low[j] for j in at]), np.array([self.high[j] for j in at])
        self.starts = np.array([self.nodes[j][0] for j in at] + [len(points)])

    def groups(self, q: np.ndarray, radius: Callable[[], float], first: int = 4) -> Iterator[np.ndarray]:
        """Points (places in ``order``) of leaves within the radius, nearest leaves first, in growing groups."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        far = (gap * gap).sum(axis=1)
        order, at, step = np.argsort(far, kind="stable"), 0, first
        while at < len(order):
            take = order[at : at + step]
            take = take[far[take] <= radius()]
            if not len(take):
                return
            yield np.concatenate([np.arange(self.starts[j], self.starts[j + 1]) for j in np.sort(take)])
            at, step = at + step, 4 * step


class Piece:
    """The vectors of one piece of a cell, with their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int):
        points = unit(vectors) @ directions(vectors.shape[1], m)
        self.tree = KDTree(points)
        self.ids, self.vectors, self.points = (x[self.tree.order] for x in (ids, vectors, points))
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        #: Rows whose vectors were compared with a query.
        self.verified = 0

    def search(self, qid: int, q: np.ndarray, q_point: np.ndarray, k: int, bound: float, quantile: float) -> list[tuple[float, int]]:
        """The best (score, id) found; ``bound``: squared distance of the k-th best known so far, ``quantile``: the
        test's, over ratio squared."""
        best: list[tuple[float, int]] = []
        q_norm = math.sqrt((q * q).sum())
        radius = lambda: quantile * bound + SLACK
        for rows in self.tree.groups(q_point, radius):
            away = self.points[rows] - q_point
            rows = rows[(np.einsum("ij,ij->i", away, away) <= radius()) & (self.ids[rows] != qid)]
            self.verified += len(rows)
            if not len(rows):
                continue
            close = self.vectors[rows] @ q / (self.norms[rows] * q_norm)
            least = np.partition(close, -k)[-k] if len(rows) > k else -np.inf
            rows = rows[close >= max(least, best[-1][0] if len(best) == k else -np.inf) - 1e-9]
            # row sums, which don't depend on a row's place, so that equal vectors have equal scores
            score = (self.vectors[rows] * q).sum(axis=1) / (self.norms[rows] * q_norm)
            order = np.lexsort((self.ids[rows], -score))
            nearest = dict.fromkeys(zip(score[order].tolist(), self.ids[rows][order].tolist(), strict=True))
            best = sorted({*best, *islice(nearest, k)}, key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                bound = min(bound, max(0.0, 2 - 2 * best[-1][0]))
        return best


def splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, value) of the inner nodes of a full tree, in heap order."""
    out, level = [], [points]
    for _ in range(depth):
        nxt = []
        for own in level:
            at = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            value = float(np.median(own[:, at])) if len(own) else 0.0
            out.append((at, value))
            nxt += [own[own[:, at] < value], own[own[:, at] >= value]]
        level = nxt
    return out


def cell_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if tree:
        at, value = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        while node.min() < len(tree):
            node = 2 * node + 1 + (points[np.arange(len(points)), at[node]] >= value[node])
    return node - len(tree)


def usable(v: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    d = v.cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(d, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


FOUND = "query_id long, vec_id long, score double"


def _search(k: int, m: int, quantile: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, piece = None, [], [], None
        for batch in batches:
            cells, chunks, queries, keys, bounds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "chunk", "query", "id", "bound"))
            vectors = _matrix(batch.column("v"))
            points = unit(vectors) @ directions(vectors.shape[1], m)
            out = []
            change = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (chunks[1:] != chunks[:-1]) | (queries[1:] != queries[:-1])]))
            for lo, hi in zip(change, [*change[1:], len(cells)], strict=True):
                if (cells[lo], chunks[lo]) != now:
                    now, ids, rows, piece = (cells[lo], chunks[lo]), [], [], None
                if not queries[lo]:
                    ids.append(keys[lo:hi])
                    rows.append(vectors[lo:hi])
                    continue
                if piece is None and ids:
                    piece = Piece(np.concatenate(ids), np.concatenate(rows), m)
                if piece is not None:
                    for j in range(lo, hi):
                        out += [(int(keys[j]), i, s) for s, i in piece.search(int(keys[j]), vectors[j], points[j], k, float(bounds[j]), quantile)]
            if out:
                q, i, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", m: int = M, confidence: float = CONFIDENCE, ratio: float = 1.0, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """The ``k`` rows nearest by cosine to each row where ``is_query`` holds, its own id apart.

    Returns query_id, rank (from 1), vec_id, score (cosine in double precision of the original vectors),
    ties in order of vec_id. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those of another length than most have. Of rows that repeat an id the one with the smallest
    vector, component by component, stands. Other columns aren't carried. An empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = sorted(((r[1], r[0]) for r in own.groupBy(F.size("v")).count().collect()), reverse=True)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dim = lengths[0]
    own = own.where(F.size("v") == dim)
    quantile = chi_square_quantile(confidence, m) / ratio**2

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = unit(_matrix(batch.column("v"))) @ directions(dim, m)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), m).cast(pa.list_(pa.float64()))], names=["p"])

    some = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(min(1.0, sample / n) * 1_000_003))
    points = np.array([r[0] for r in some.select("v").mapInArrow(project, "p array<double>").collect()]).reshape(-1, m)
    tree = splits(points, max(0, min(math.ceil(math.log2(n / cell)), math.floor(math.log2(max(1, len(points)) / LEAST)))))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = unit(_matrix(batch.column("v"))) @ directions(dim, m)
                box = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), m).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "asks")), box, pa.array(cell_of(p, tree))], names=["id", "v", "asks", "p", "cell"])

    index = scratch.write_table(own.mapInArrow(place, "id long, v array<double>, asks boolean, p array<double>, cell long"), "ann-index")
    repeated = scratch.write_table(index.groupBy("id").count().where("count > 1").select("id"), "ann-repeated")
    if not repeated.isEmpty():
        least = F.min(F.struct("v", "asks", "p", "cell")).alias("r")
        once = index.join(repeated, "id", "left_semi").groupBy("id").agg(least).select("id", "r.*")
        index = scratch.write_table(index.join(repeated, "id", "left_anti").unionByName(once), "ann-index")
    sides = [f(F.get("p", F.lit(j))).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(m)]
    # one row per cell, of which there are at most sample / LEAST
    boxes = {r["cell"]: r for r in index.groupBy("cell").agg(F.count("*").alias("n"), *sides).collect()}
    names = np.array(sorted(boxes), np.int64)
    low, high = (np.array([[boxes[c][f"{f}{j}"] for j in range(m)] for c in names]) for f in ("min", "max"))
    chunks = np.array([-(-boxes[c]["n"] // (2 * cell)) for c in names], np.int64)
    # cells follow the sample's medians, so few hold more than twice their share: those of many copies
    crowded = [F.lit(int(x)) for pair in zip(names, chunks, strict=True) if pair[1] > 1 for x in pair]
    pieces = (F.coalesce(F.create_map(*crowded)[F.col("cell")], F.lit(1)) if crowded else F.lit(1)).cast("long")

    rows = index.select("cell", F.pmod(F.xxhash64("id"), pieces).alias("chunk"), F.lit(False).alias("query"), "id", "v", F.lit(0.0).alias("bound"))
    queries = index.where("asks").select("id", "v", "p", "cell")

    def search(asked: DataFrame) -> DataFrame:
        both = rows.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi").unionByName(asked)
        return scratch.write_table(both.repartition(int(chunks.sum()) * 2, "cell", "chunk").sortWithinPartitions("cell", "chunk", "query").mapInArrow(_search(k, m, quantile), FOUND), "ann-found")

    every = F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("chunk")
    first = search(queries.select("cell", every, F.lit(True).alias("query"), "id", "v", F.lit(4.0).alias("bound")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("bound"))

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, bound, home = _matrix(batch.column("p")), batch.column("bound").to_numpy(), batch.column("cell").to_numpy()
            who, where = [], []
            for j in range(len(p)):
                gap = np.maximum(0, np.maximum(low - p[j], p[j] - high))
                go = names[((gap * gap).sum(axis=1) <= quantile * bound[j] + SLACK) & (names != home[j])]
                who += [j] * len(go)
                where += go.tolist()
            if who:
                out = batch.select(["id", "v", "bound"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), *out.columns], names=["cell", "id", "v", "bound"])

    found = first
    if len(names) > 1:
        asked = queries.join(kth, "id", "left").select("id", "v", "p", "cell", F.coalesce("bound", F.lit(4.0)).alias("bound"))
        second = search(asked.mapInArrow(visit, "cell long, id long, v array<double>, bound double").select("cell", every, F.lit(True).alias("query"), "id", "v", "bound"))
        found = first.union(second)
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op6_nearest": op6_nearest}
ORACLE: dict[str, str] = {}
