"""Estimates over sliding windows from running sums: rows are read once, not once a window.

The cross-moments of a window are the difference of two running sums; a row with them is solved by itself. Columns are
taken from their mean first, so that little is lost in the difference. A window slides over the dates of a group; without
groups over one row a date in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .regression import square
from .series import fevd, gfevd, moving_average, spillover


def sliding_sums(df: DataFrame, by: list[str], order: str, columns: dict[str, Column], rows: int) -> DataFrame:
    """``df`` with sums of ``columns`` over the last ``rows`` rows (null before there are so many), as differences of running sums."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({"run_" + name: F.sum(F.coalesce(c, F.lit(0.0))).over(upto) for name, c in columns.items()} | {"row_": F.row_number().over(w)})
    before = lambda name: F.coalesce(F.lag("run_" + name, rows).over(w), F.lit(0.0))
    sums = {name: F.when(F.col("row_") >= rows, F.col("run_" + name) - before(name)) for name in columns}
    return d.withColumns(sums).drop(*["run_" + name for name in columns], "row_")


def _centred(df: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    everything = Window.partitionBy(*by)
    names = {f"c{i}": F.col(c).cast("double") for i, c in enumerate(cols)}
    d = df.select(*by, order, *[F.when(~F.isnan(c), c).alias(n) for n, c in names.items()])
    return d.select(*by, order, *[(F.col(n) - F.avg(n).over(everything)).alias(n) for n in names])


def _spread(d: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of all windows dealt out again: those of a group were in one task."""
    return d.repartition(*by, order)


def rolling_spillover(df: DataFrame, by: list[str], order: str, cols: list[str], window: int, p: int = 1, horizon: int = 10, orthogonal: bool = False) -> DataFrame:
    """by, order (of the window's last date), total, and net and from (arrays by column), in per cent, of a VAR in each window.

    A window has ``window`` dates, so ``window`` - p rows with all lags. Shares of the forecast error variance are generalised, or
    of orthogonal shocks in the columns' order. Rows with a null go before windows are drawn. Windows whose moments have no inverse give null.
    """
    n, k = len(cols), 1 + len(cols) * p
    if window - p <= k:
        raise ValueError(f"{window} dates are too few for {k} coefficients")
    d = df.dropna(subset=cols)
    w = Window.partitionBy(*by).orderBy(order)
    c = _centred(d, by, order, cols)
    z = c.select("*", F.lit(1.0).alias("one"), *[F.lag(f"c{i}", lag).over(w).alias(f"c{i}_{lag}") for lag in range(1, p + 1) for i in range(n)])
    terms = ["one", *[f"c{i}_{lag}" for lag in range(1, p + 1) for i in range(n)], *[f"c{i}" for i in range(n)]]
    # rows without all lags have null products, which count as zero; only windows after them are complete
    products = {f"m{i}_{j}": F.when(F.col(terms[k - 1]).isNotNull(), F.col(terms[i]) * F.col(terms[j])) for i in range(len(terms)) for j in range(i, len(terms))}
    s = sliding_sums(z.withColumn("nth", F.row_number().over(w)), by, order, products, window - p).where(F.col("nth") >= window)
    moments = F.array(*products).alias("m")

    @F.pandas_udf("struct<total:double,net:array<double>,from:array<double>>")
    def solve(m: pd.Series) -> pd.DataFrame:
        out = []
        for v in m:
            a = square(v, k + n)
            try:
                beta = np.linalg.solve(a[:k, :k], a[:k, k:])
                sigma = (a[k:, k:] - beta.T @ a[:k, k:]) / (window - p - k)
                psi = moving_average(np.array([beta[1 + i * n : 1 + (i + 1) * n].T for i in range(p)]), horizon)
                shares = fevd(psi @ np.linalg.cholesky(sigma)) if orthogonal else gfevd(psi, sigma)
                total, to, frm = spillover(shares[-1])
                out.append((float(total), (to - frm).tolist(), frm.tolist()))
            except np.linalg.LinAlgError:
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["total", "net", "from"])

    return _spread(s.select(*by, order, moments), by, order).select(*by, order, solve("m").alias("s")).select(*by, order, "s.*")


def rolling_conditions(df: DataFrame, by: list[str], order: str, cols: list[str], window: int, tightening: list[str] | None = None) -> DataFrame:
    """by, order, fci, share: in each window of dates the first principal component of standardised columns, at the window's last date.

    Columns are standardised by what the window has of them (population deviation); what is missing counts as their mean. The index has unit variance
    in its window. Its sign makes the loadings of ``tightening`` add up to no less than zero, else the largest loading positive (the first of equal ones). ``share`` is the
    component's part of the variance. A column that is missing or constant in a window counts as zero there.
    """
    n = len(cols)
    signs = [cols.index(c) for c in tightening or []]
    d = _centred(df, by, order, cols)
    there = [F.col(f"c{i}").isNotNull() for i in range(n)]
    sums = {}
    for i in range(n):
        for j in range(i, n):
            both = there[i] & there[j]
            sums |= {f"n{i}_{j}": F.when(both, 1.0), f"s{i}_{j}": F.when(both, F.col(f"c{i}") * F.col(f"c{j}")), f"a{i}_{j}": F.when(both, F.col(f"c{i}")), f"b{i}_{j}": F.when(both, F.col(f"c{j}"))}
    s = sliding_sums(d, by, order, sums, window).where(F.col("n0_0").isNotNull())
    table = lambda p: F.array(*[f"{p}{i}_{j}" for i in range(n) for j in range(i, n)]).alias(p)

    @F.pandas_udf("struct<fci:double,share:double>")
    def solve(x: pd.Series, cnt: pd.Series, prod: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out, upper = [], np.triu_indices(n)
        for v, c, s, a, b in zip(x, cnt, prod, left, right, strict=True):
            v = np.array(v, float)
            num, cross = square(c, n), square(s, n)
            first, second = np.zeros((n, n)), np.zeros((n, n))
            first[upper], second[upper] = a, b
            size = np.maximum(np.diag(num), 1)
            mean = np.diag(first) / size
            sd = np.sqrt(np.maximum(np.diag(cross) / size - mean**2, 0))
            ok = sd > 1e-12
            sd = np.where(ok, sd, 1.0)
            part = np.triu(cross - mean[:, None] * second - first * mean[None, :] + np.outer(mean, mean) * num)
            gram = (part + np.triu(part, 1).T) / np.outer(sd, sd)
            gram[~ok] = gram[:, ~ok] = 0
            values, vectors = np.linalg.eigh(gram)
            w = vectors[:, -1]
            largest = int(np.argmax(np.abs(w) >= np.abs(w).max() - 1e-9))  # the first of equal ones
            if w[signs].sum() < 0 if signs else w[largest] < 0:
                w = -w
            z = np.where(np.isfinite(v) & ok, (v - mean) / sd, 0.0)
            top, total = float(values[-1]), float(np.trace(gram))
            out.append((float(z @ w / np.sqrt(top / window)), top / total) if top > 0 else (None, None))
        return pd.DataFrame(out, columns=["fci", "share"])

    rows = _spread(s.select(*by, order, F.array(*[f"c{i}" for i in range(n)]).alias("x"), *map(table, "nsab")), by, order)
    return rows.select(*by, order, solve("x", "n", "s", "a", "b").alias("r")).select(*by, order, "r.*")
