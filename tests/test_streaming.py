"""Streams with a state per series: equal to the batch, whatever the order, the files and the restarts."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from loomline.operators import state_space as S
from loomline.streaming import ordered as O

SCHEMA = "k string, ts timestamp, y double, id long"
START = dt.datetime(2024, 1, 1)
MODEL = S.Model([[1.0, 1.0], [0, 1]], [[1.0, 0]], np.diag([0.2, 0.05]), [[0.5]], diffuse=(0, 1))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, O.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def data(seed=1, n=240):
    """Rows of three series over ten days, some missing, some of one time, up to six hours out of order."""
    r = random.Random(seed)
    rows = [("abc"[i % 3], START + dt.timedelta(hours=i, microseconds=i), None if r.random() < 0.1 else r.gauss(0, 1), i) for i in range(n)]
    rows += [("a", rows[30][1], 0.5, n), ("a", rows[30][1], None, n + 1)]
    return sorted(rows, key=lambda x: x[1] + dt.timedelta(hours=r.uniform(0, 6)))


def put(spark, rows, path):
    spark.createDataFrame(pd.DataFrame(rows, columns=["k", "ts", "y", "id"]).astype({"y": object}).where(lambda d: d.notna(), None), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, f, tmp, rows=None):
    """Take what is there, one file after another, and stop; the sink's rows so far."""
    if rows is not None:
        put(spark, rows, f"{tmp}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    f(stream).writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp}/out")


def ordered(rows, before=None):
    return [x for x in sorted(rows, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0.0)) if before is None or x[1] < before]


def test_kalman_stream_equals_batch_after_restarts(rocks, tmp_path):
    rows = data()
    f = lambda s: O.kalman(s, ["k"], "ts", ["y"], MODEL, "8 hours")
    for i in range(4):
        got = run(rocks, f, tmp_path, rows[i * 61 : (i + 1) * 61]).collect()
    end = max(x[1] for x in rows) - dt.timedelta(hours=8)
    end = end.replace(microsecond=end.microsecond // 1000 * 1000)  # the watermark has milliseconds
    series = pd.DataFrame([(k, i, y) for i, (k, _, y, _) in enumerate(ordered(rows, end))], columns=["k", "i", "y"]).astype({"y": object})
    batch = S.kalman_filter(rocks.createDataFrame(series.where(series.notna(), None), "k string, i long, y double"), ["k"], "i", ["y"], MODEL).orderBy("i").collect()
    want = [(x[0], x[1]) for x in ordered(rows, end)]
    got = sorted(got, key=lambda r: (r.k, r.ts, r.y is not None, r.y or 0.0))
    assert [(r.k, r.ts) for r in got] == want and len(batch) == len(got)
    for g, b in zip(got, batch, strict=True):
        assert np.allclose(g.mean, b.mean) and np.allclose(g.cov, b.cov) and np.allclose(g.diffuse, b.diffuse) and np.isclose(g.loglik, b.loglik) and g.y == b.y


def test_garch_stream_and_late_rows(rocks, tmp_path):
    rows = data(2, 150)
    f = lambda s: O.garch(s, ["k"], "ts", "y", 0.1, 0.2, 0.7, "8 hours")
    run(rocks, f, tmp_path, rows[:100])
    run(rocks, f, tmp_path, rows[100:])
    # a day too late, so left out; without a time; and far ahead, so that all before it is due
    got = run(rocks, f, tmp_path, [("a", START + dt.timedelta(hours=1, minutes=30), 9.0, 900), ("a", None, 1.0, 901), ("z", START + dt.timedelta(days=40), 1.0, 902)]).collect()
    want, s, at = [], None, None
    for k, ts, y, _ in ordered(rows):
        s = 0.1 / (1 - 0.9) if k != at else s
        want.append((k, ts, y, s))
        at, s = k, 0.1 + 0.2 * (s if y is None else y * y) + 0.7 * s
    got = sorted(got, key=lambda r: (r.k, r.ts, r.y is not None, r.y or 0.0))
    assert [(r.k, r.ts, r.y) for r in got] == [w[:3] for w in want] and np.allclose([r.sigma2 for r in got], [w[3] for w in want])
    with pytest.raises(ValueError):
        O.garch(None, ["k"], "ts", "y", 0.1, 0.5, 0.6, "1 hour")


def test_rows_of_a_batch_wait_in_one_call():
    """A call of the state server costs more than a row."""
    calls, timers = [], []

    class Waiting:
        def appendList(self, rows):
            calls.append(rows)

        def appendValue(self, row):
            raise AssertionError("a call a row")

    class Done:
        def exists(self):
            return True

        def get(self):
            return (5_000,)

    p = O._InOrder(["k"], ["y"], [], None, None, None, None)
    p.waiting, p.done, p.handle = Waiting(), Done(), type("Handle", (), {"registerTimer": lambda self, ms: timers.append(ms)})()
    batches = [pd.DataFrame({"us": [9_000, 5_000, 7_000], "y": [1.0, 2.0, np.nan]}), pd.DataFrame({"us": [8_000], "y": [3.0]}), pd.DataFrame({"us": [1], "y": [4.0]})]
    assert list(p.handleInputRows(("a",), iter(batches), None)) == []
    assert calls == [[(9_000, [1.0]), (7_000, [None])], [(8_000, [3.0])]] and timers == [8]
