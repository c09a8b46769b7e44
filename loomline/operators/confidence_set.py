"""The set of models that hold the best one with a given confidence, by resampling blocks of dates.

A replicate is a table of (replicate, place, date taken), made by a hash and a window, the same for all models. Mean
losses are one aggregation by replicate after a join on the date's number; the elimination of the worst model,
again and again, works on those means: replicates times models numbers a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest of the parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def stationary_blocks(sizes: DataFrame, by: list[str], replicates: int, block: Column, seed: int = 0) -> DataFrame:
    """by, replicate, place, taken: of ``sizes`` (by, n), numbers from 1 to n in blocks of mean length ``block`` that wrap around.

    At each place, and at the first, a new block begins with probability 1 / block at a random number.
    """
    d = sizes.withColumn("start", 1 / F.greatest(block, F.lit(1.0))).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("place", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    key = [F.lit(seed), *[F.col(c) for c in by], F.col("replicate"), F.col("place")]
    new = (F.col("place") == 1) | (uniform(F.lit("new"), *key) < F.col("start"))
    d = d.withColumn("origin", F.when(new, F.struct(F.floor(uniform(F.lit("at"), *key) * F.col("n")).alias("at"), F.col("place").alias("since"))))
    w = Window.partitionBy(*by, "replicate").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    o = F.last("origin", ignorenulls=True).over(w)
    return d.withColumn("o", o).select(*by, "replicate", "place", ((F.col("o.at") + F.col("place") - F.col("o.since")) % F.col("n") + 1).alias("taken"))


def eliminate(mean: np.ndarray, drawn: np.ndarray, kind: str = "max") -> tuple[np.ndarray, np.ndarray]:
    """(p-value, turn of elimination from 1, the last model's is the number of models) from mean losses and replicates' ones."""
    ratio = lambda a, s: np.divide(a, s, out=np.zeros(np.broadcast_shapes(a.shape, s.shape)), where=np.broadcast_to(s > 1e-12, np.broadcast_shapes(a.shape, s.shape)))
    left, p, turn, so_far = list(range(len(mean))), np.ones(len(mean)), np.full(len(mean), len(mean)), 0.0
    for k in range(1, len(mean)):
        m, d = mean[left], drawn[:, left]
        excess, moved = m - m.mean(), (d - d.mean(axis=1, keepdims=True)) - (m - m.mean())
        sd = np.sqrt((moved**2).mean(axis=0))
        t, ts = ratio(excess, sd), ratio(moved, sd)
        if kind == "max":
            seen, resampled = t.max(), ts.max(axis=1)
        else:
            i, j = np.triu_indices(len(left), 1)
            pair, moved = m[i] - m[j], (d[:, i] - d[:, j]) - (m[i] - m[j])
            sd = np.sqrt((moved**2).mean(axis=0))
            a, b = np.abs(ratio(pair, sd)), np.abs(ratio(moved, sd))
            seen, resampled = (a.max(), b.max(axis=1)) if kind == "range" else ((a**2).sum(), (b**2).sum(axis=1))
        worst = left[int(np.argmax(t))]
        so_far = max(so_far, float((resampled >= seen - 1e-9).mean()))  # equal up to rounding is equal
        p[worst], turn[worst] = so_far, k
        left.remove(worst)
    return p, turn


def confidence_set(losses: DataFrame, by: list[str], order: str, models: list[str], alpha: float = 0.10, kind: str = "max", replicates: int = 1000, block: float | None = None, seed: int = 0) -> DataFrame:
    """by, model, mean_loss, p_value, turn, included: which models, columns of losses by date, can't be told from the best.

    The worst model by standardised excess loss goes first; a model's p-value is the largest of the tests up to its turn, and
    the set has those of ``alpha`` or more. ``kind`` is the tests' statistic: max of the excess losses, range or squares of the pairwise
    ones. Blocks have the cube root of the number of dates, 2 at least, unless ``block`` is given. Rows with a null loss or date
    go; of repeated dates each counts, in order of their losses. Groups of no row give none.
    """
    if kind not in ("max", "range", "squares") or len(models) < 2:
        raise ValueError("two models or more, and max, range or squares")
    d = losses.select(*by, order, *[F.col(m).cast("double").alias(m) for m in models]).dropna(subset=[order, *models])
    d = d.withColumn("taken", F.row_number().over(Window.partitionBy(*by).orderBy(order, *models)).cast("long"))
    means = d.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(m) for m in models]).alias("mean"))
    length = F.lit(float(block)) if block else F.greatest(F.lit(2.0), F.round(F.cbrt("n")))
    drawn = stationary_blocks(means.select(*by, "n"), by, replicates, length, seed)
    # a replicate takes a date some times: counts go into the join instead of places
    counts = drawn.groupBy(*by, "replicate", "taken").agg(F.count("*").alias("times"))
    resampled = counts.join(d, [*by, "taken"]).groupBy(*by, "replicate").agg(F.array(*[F.sum(F.col(m) * F.col("times")) / F.sum("times") for m in models]).alias("drawn"))

    @F.pandas_udf("array<struct<p:double,turn:int>>")
    def each(mean: pd.Series, all_: pd.Series) -> pd.Series:
        return pd.Series([[{"p": float(p), "turn": int(t)} for p, t in zip(*eliminate(np.asarray(m), np.stack(x), kind), strict=True)] for m, x in zip(mean, all_, strict=True)])

    tests = resampled.groupBy(*by).agg(F.collect_list("drawn").alias("all"))
    joined = tests.join(means, by) if by else tests.join(F.broadcast(means))  # without groups, one row
    out = joined.select(*by, "mean", each("mean", "all").alias("tests")).select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(m) for m in models]).alias("model"), "mean", "tests")).alias("r"))
    return out.select(*by, F.col("r.model").alias("model"), F.col("r.mean").alias("mean_loss"), F.col("r.tests.p").alias("p_value"), F.col("r.tests.turn").alias("turn"), (F.col("r.tests.p") >= alpha).alias("included"))
