"""Recursions over streams: a state per series, rows put in order, results equal to those of a batch.

A row waits until the watermark has passed it, so rows that come out of order, but not later than the watermark allows,
are taken in order. Timers of the event time wake a series up. State is kept by Spark's state store and survives a restart
from the query's checkpoint. The session's state store must be the one on RocksDB::

    spark.sql.streaming.stateStore.providerClass =
        org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state_space import Model, State

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    def __init__(self, keys: list[str], columns: list[str], added: list[str], begin: Callable, step: Callable, pack: Callable, unpack: Callable):
        self.keys, self.columns, self.added, self.begin, self.step, self.pack, self.unpack = keys, columns, added, begin, step, pack, unpack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, x array<double>")
        self.state = handle.getValueState("state", "x array<double>")
        self.done = handle.getValueState("done", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, first = self.done.get()[0] if self.done.exists() else None, None
        for batch in rows:
            new = [(int(us), [None if v is None or np.isnan(v) else float(v) for v in x]) for us, *x in batch[["us", *self.columns]].itertuples(index=False, name=None) if done is None or us > done]
            if new:
                self.waiting.appendList(new)  # one call of the state server a batch, not one a row
                first = min([us for us, _ in new] + ([] if first is None else [first]))
        self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(((us, list(x)) for us, x in self.waiting.get()), key=lambda r: (r[0], [(v is not None, v or 0.0) for v in r[1]])) if self.waiting.exists() else []
        due, left = [r for r in waiting if r[0] < now], [r for r in waiting if r[0] >= now]
        if not due:
            self._wake(left[0][0] if left else None)
            return
        state, out = self.unpack(list(self.state.get()[0])) if self.state.exists() else self.begin(), []
        for us, x in due:
            state, new = self.step(state, dict(zip(self.columns, x, strict=True)))
            out.append((*key, us, *x, *new))
        self.state.update((self.pack(state),))
        self.done.update((due[-1][0],))
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self._wake(left[0][0])
        yield pd.DataFrame(out, columns=[*self.keys, "us", *self.columns, *self.added])

    def _wake(self, us: int | None) -> None:
        if us is not None:
            self.handle.registerTimer(int(us) // 1000 + 1)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, by: list[str], time: str, columns: list[str], schema: str, late: str, begin: Callable, step: Callable, pack: Callable, unpack: Callable) -> DataFrame:
    """by, time, columns (as doubles) and what ``step`` adds, for each row once the watermark, ``late`` behind, has passed it.

    ``begin`` makes a series' first state, ``step`` takes (state, values by column) to (state, added values), and ``pack`` and ``unpack``
    turn a state into numbers and back. Rows of one time go by their values, null first. Rows behind the watermark, and rows without a
    time, are left out; so is what the watermark hasn't passed when a query ends, until more comes.
    """
    types = dict(stream.dtypes)
    added = [c.split()[0] for c in schema.split(", ")]
    d = stream.where(F.col(time).isNotNull()).withWatermark(time, late).select(*by, time, F.unix_micros(F.col(time).cast("timestamp")).alias("us"), *[F.col(c).cast("double").alias(c) for c in columns])
    out = ", ".join([*(f"`{c}` {types[c]}" for c in by), "us long", *(f"`{c}` double" for c in columns), schema])
    processor = _InOrder(by, columns, added, begin, step, pack, unpack)
    found = d.groupBy(*by).transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.select(*by, F.timestamp_micros("us").alias(time), *columns, *added)


def kalman(stream: DataFrame, by: list[str], time: str, ys: list[str], model: Model, late: str) -> DataFrame:
    """``operators.state_space.kalman_filter`` of a stream: by, time, ys, mean, cov, diffuse, loglik, row by row."""
    m = len(model.T)

    def step(s: State, r: dict) -> tuple[State, tuple]:
        s, loglik = model.update(s, np.array([np.nan if r[y] is None else r[y] for y in ys], float))
        return model.predict(s), (s.mean, s.cov.ravel(), s.diffuse.ravel(), loglik)

    pack = lambda s: [float(v) for v in np.concatenate([s.mean, s.cov.ravel(), s.diffuse.ravel()])]
    unpack = lambda x: State(np.array(x[:m]), np.array(x[m : m + m * m]).reshape(m, m), np.array(x[m + m * m :]).reshape(m, m))
    return in_order(stream, by, time, ys, "mean array<double>, cov array<double>, diffuse array<double>, loglik double", late, model.start, step, pack, unpack)


def garch(stream: DataFrame, by: list[str], time: str, r: str, omega: float, alpha: float, beta: float, late: str) -> DataFrame:
    """by, time, r, sigma2: the variance of each value given those before it, by GARCH(1,1) at given parameters.

    It begins at omega / (1 - alpha - beta); a missing value counts as its expected square.
    """
    if not (omega > 0 and alpha >= 0 and beta >= 0 and alpha + beta < 1):
        raise ValueError("omega must be positive, alpha and beta not negative and below 1 together")

    def step(s: float, x: dict) -> tuple[float, tuple]:
        return omega + alpha * (s if x[r] is None else x[r] * x[r]) + beta * s, (s,)

    return in_order(stream, by, time, [r], "sigma2 double", late, lambda: omega / (1 - alpha - beta), step, lambda s: [float(s)], lambda x: x[0])
