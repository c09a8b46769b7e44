"""Weights on a simplex for any number of donors, from moments of a path's length.

The least of |A w - b|^2 / 2 + ridge |w|^2 / 2 over w >= 0 with sum 1 has one column of A for each donor. Its dual has a
number for each date and one for the sum, so Newton's steps there need sums over donors of at most (dates + 1)^2
numbers: no donor reaches the driver, and none meets another. Without a ridge the same steps solve proximal problems,
each around the weights of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

#: Shares of a Newton step that one pass tries together.
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 3e-3, 1e-3, 1e-4)


def paths(df: DataFrame, unit: str, time: str, y: str, keep: list[Column] = ()) -> tuple[DataFrame, list]:
    """(unit, a: values in order of time, and ``keep``'s aggregates) of units that have every date, and the dates.

    A unit's row is as long as there are dates; the dates go to the driver. Rows must be one a unit and date.
    """
    dates = [r[0] for r in df.select(time).distinct().orderBy(time).collect()]
    pair = F.array_sort(F.collect_list(F.when(F.col(y).isNotNull(), F.struct(F.col(time), F.col(y).cast("double").alias("v")))))
    rows = df.groupBy(unit).agg(pair.alias("p"), *keep).where(F.size("p") == len(dates))
    return rows.withColumn("p", F.transform("p", lambda x: x["v"])).withColumnRenamed("p", "a"), dates


def summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sum over tasks of the vectors that ``run`` makes of each task's batches of ``a``."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += run(np.vstack(pdf["a"].to_numpy()))
        yield pd.DataFrame({"k": np.arange(size), "s": total})

    out = np.zeros(size)
    for r in rows.select("a").mapInPandas(task, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        out[r["k"]] = r["s"]
    return out


def cross(rows: DataFrame, size: int) -> np.ndarray:
    """Cross-moments of (1, a), a square of the paths' length."""

    def run(a: np.ndarray) -> np.ndarray:
        e = np.c_[np.ones(len(a)), a]
        return (e.T @ e).ravel()

    return summed(rows, run, (size + 1) ** 2).reshape(size + 1, size + 1)


def weights_after(a: np.ndarray, scale: float, start: float, history: list[tuple[np.ndarray, float]], ridge: bool) -> np.ndarray:
    """Donors' weights after the proximal steps so far: points of the dual and their rho."""
    e = np.c_[a / scale, np.ones(len(a))]
    w = np.full(len(a), 0.0 if ridge else start)
    for point, rho in history:
        w = np.maximum(0, (0.0 if ridge else w) - e @ point / rho)
    return w


def simplex_weights(rows: DataFrame, target: np.ndarray, ridge: float = 0.0, rounds: int = 40) -> DataFrame:
    """The rows of ``paths`` with ``weight``: at least 0, sum 1, and the mix closest to ``target`` (with the ridge).

    Without a ridge, where several mixes are as close, it is one near equal weights. An empty table gives no rows.
    """
    rows = checkpointed(rows)
    size = len(target)
    first = summed(rows, lambda a: np.r_[len(a), (a * a).sum(), a.sum(axis=0)], size + 2)
    n = first[0]
    if not n:
        return rows.withColumn("weight", F.lit(None).cast("double"))
    scale = float(np.sqrt(first[1] / n)) or 1.0
    b = np.asarray(target, float) / scale
    floor, held = (ridge / scale**2, True) if ridge > 0 else (1e-4, False)
    history: list[tuple[np.ndarray, float]] = []
    dim = size + 1

    def visit(points: list[np.ndarray], rho: float) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
        """The dual's value, slope and curvature at each point, and how far weights move from those before."""
        block, past = 2 + dim + dim * dim, list(history)

        def run(a: np.ndarray) -> np.ndarray:
            e, before = np.c_[a / scale, np.ones(len(a))], np.zeros(len(a)) if held else weights_after(a, scale, 1 / n, past, held)
            out = []
            for p in points:
                at = e @ p
                w = np.maximum(0, before - at / rho)
                on = e[w > 0]
                out += [[0.5 * rho * ((w - before) ** 2).sum() + w @ at, ((w - before) ** 2).sum()], e.T @ w, (on.T @ on).ravel()]
            return np.concatenate(out)

        sums, out = summed(rows, run, block * len(points)).reshape(len(points), block), []
        for p, s in zip(points, sums, strict=True):
            value = s[0] - p[:size] @ b - 0.5 * p[:size] @ p[:size] - p[size]
            slope = s[2 : 2 + dim] - np.r_[b + p[:size], 1.0]
            out.append((float(value), slope, s[2 + dim :].reshape(dim, dim) / rho + np.diag(np.r_[np.ones(size), 0.0]), float(s[1])))
        return out

    start = first[2:] / n / scale - b
    reach = np.sqrt(first[1]) / scale * np.linalg.norm(start)  # no donor's product with the start is larger
    rho, point = max(floor, 1.0), np.r_[start, -reach]
    for _ in range(rounds):
        now = visit([point], rho)[0]
        for _ in range(60):
            value, slope, curve, _ = now
            if np.abs(slope).max() < 1e-10:
                break
            step = np.linalg.solve(curve + 1e-12 * np.trace(curve) / dim * np.eye(dim), slope)
            tried = [point + s * step for s in STEPS]
            best = max(zip(tried, visit(tried, rho), strict=True), key=lambda x: x[1][0])
            if best[1][0] <= value and np.abs(best[1][1]).max() >= np.abs(slope).max():
                break
            point, now = best
        if not held:
            history.append((point, rho))
        if rho <= floor and (held or now[3] < 1e-20):
            break
        rho = max(floor, rho / 10)
    if held:
        history.append((point, rho))

    @F.pandas_udf("double")
    def weight(a: pd.Series) -> pd.Series:
        return pd.Series(weights_after(np.vstack(a.to_numpy()), scale, 1 / n, history, held) if len(a) else [], dtype=float)

    return rows.withColumn("weight", weight("a"))
