"""Table functions for SQL: estimators over the partitions of a table argument.

    SELECT * FROM lp_hac(TABLE(SELECT code, date, y, x FROM panel) PARTITION BY code ORDER BY (date), 'code', 'date', 'y', 'x', 4)

``register`` names them in a session. A partition is one series: its rows come in the order that SQL asks for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class LpHac:
    """Responses of y to x at horizons 0 to ``most``, as ``operators.regression.lp_hac`` has them: the key, h, beta, se, t, n.

    Arguments: the table, names of its key, order, y and x columns, the largest horizon, and the number of lags (2). The result's first column has the key's
    name and type. Rows with missing values stay where they are, and the regression goes without them. A partition is held by one task, as its
    horizons need rows ahead: a series' dates.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, y: AnalyzeArgument, x: AnalyzeArgument, most: AnalyzeArgument, lags: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise Exception("the first argument is a table")
        fields = {f.name: f.dataType for f in table.dataType}
        for what, given in (("key", key), ("order", order), ("y", y), ("x", x)):
            if given.value not in fields:
                raise Exception(f"the table has no column {given.value!r} for {what}")
        if most.value is None or most.value < 0 or (lags is not None and (lags.value is None or lags.value < 0)):
            raise Exception("horizons and lags are whole numbers from 0 on")
        double = [StructField(c, DoubleType()) for c in ("beta", "se", "t")]
        return AnalyzeResult(StructType([StructField(key.value, fields[key.value]), StructField("h", IntegerType()), *double, StructField("n", LongType())]))

    def __init__(self):
        self.rows, self.key, self.most, self.lags = [], None, 0, 2

    def eval(self, row, key, order, y, x, most, lags=2):
        self.key, self.most, self.lags = row[key], most, lags
        if row[order] is not None:
            self.rows.append((np.nan if row[y] is None else float(row[y]), np.nan if row[x] is None else float(row[x])))

    def terminate(self):
        if not self.rows:
            return
        d = np.array(self.rows)
        y, x = d[:, 0], d[:, 1]
        lag = lambda v, k: np.concatenate([np.full(min(k, len(v)), np.nan), v[: max(len(v) - k, 0)]])
        lead = lambda v, k: np.concatenate([v[k:], np.full(min(k, len(v)), np.nan)])
        z = np.column_stack([np.ones(len(d)), x, *[v for k in range(1, self.lags + 1) for v in (lag(x, k), lag(y, k))]])
        for h in range(self.most + 1):
            dy = lead(y, h) - lag(y, 1)
            there = np.isfinite(dy) & np.isfinite(z).all(axis=1)
            a, b = z[there], dy[there]
            if len(b) <= a.shape[1]:
                continue
            inv = np.linalg.pinv(a.T @ a, hermitian=True)
            beta = inv @ a.T @ b
            q = (a @ inv[1]) * (b - a @ beta)
            width = h + 1
            v = q @ q + sum(2 * (1 - k / (width + 1)) * (q[k:] @ q[:-k]) for k in range(1, min(width, len(q) - 1) + 1))
            se = float(np.sqrt(max(v, 0)))
            yield self.key, h, float(beta[1]), se, float(beta[1] / se) if se else None, int(there.sum())


def register(spark: SparkSession) -> None:
    """Name the functions in the session's SQL: lp_hac."""
    spark.udtf.register("lp_hac", udtf(LpHac))
