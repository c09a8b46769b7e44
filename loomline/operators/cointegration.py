"""Unit roots, cointegration and breaks, by series, on windows and cross-moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf
from .regression import estimate, moments, scores, square
from .windows import lags, over

#: 5 per cent points of the trace statistic by the number of stochastic trends.
TRACE_5 = {1: 3.84, 2: 12.32, 3: 24.28, 4: 40.17, 5: 60.06, 6: 83.94, 7: 111.78, 8: 143.61, 9: 179.41, 10: 219.18}


def phillips_perron(df: DataFrame, by: list[str], order: str, y: str, bandwidth: int | None = None) -> DataFrame:
    """by, pp_t, n: the t statistic of y_{t-1} with a constant, corrected by the residual's long-run variance with
    Bartlett weights; by default over ceil(4 (T / 100)^(1/4)) lags of the longest series' T values."""
    w = over(by, order)
    d = df.where(F.col(y).isNotNull()).select(*by, order, F.lag(y, 1).over(w).alias("level"), (F.col(y) - F.lag(y, 1).over(w)).alias("dy"))
    s = scores(d, by, "dy", ["level"], "level")
    width = F.lit(bandwidth) if bandwidth is not None else F.ceil(4 * F.pow((F.col("n") + 1) / 100, F.lit(0.25)))
    most = bandwidth if bandwidth is not None else int(s.agg(F.max(width)).first()[0] or 0)
    s = s.withColumns({f"u{l}": F.lag("u", l).over(w) for l in range(1, most + 1)}).withColumn("__bw", width)
    auto = F.sum(F.col("u") * F.col("u")) / F.count("*")
    long_run = auto
    for l in range(1, most + 1):
        long_run = long_run + 2 * F.coalesce(F.sum(F.when(F.lit(l) <= F.col("__bw"), (1 - l / (F.col("__bw") + 1)) * F.col("u") * F.col(f"u{l}"))), F.lit(0.0)) / F.count("*")
    g = s.groupBy(*by).agg(auto.alias("g0"), F.greatest(long_run, F.lit(1e-12)).alias("lrv"), F.first("beta").alias("beta"), F.first("classical").alias("v"), F.first("ssr").alias("ssr"), F.count("*").alias("n"))
    # the row of the inverse moments is the classical variance over the residual variance
    inverse = F.col("v") / (F.col("ssr") / (F.col("n") - 2))
    t = F.sqrt(F.col("g0") / F.col("lrv")) * F.col("beta") / F.sqrt("v") - 0.5 * (F.col("lrv") - F.col("g0")) * F.sqrt(F.col("n") * inverse) / F.col("lrv")
    return g.select(*by, t.alias("pp_t"), "n")


def zivot_andrews(df: DataFrame, by: list[str], order: str, y: str, n_lags: int = 4, trim: float = 0.15) -> DataFrame:
    """by, za_t, break_at, n: the least t statistic of y_{t-1} over dates of a break in the mean, next to n_lags differences.

    What a break's regressor adds to a series' cross-moments are sums over the rows after it, so all breaks are one
    running sum and no row is copied. Of equal ones the first counts; breaks before the first complete row are none.
    """
    w, every = over(by, order), Window.partitionBy(*by)
    d = df.where(F.col(y).isNotNull()).select(*by, order, (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(every).alias("__n"), F.lag(y, 1).over(w).alias("level"), (F.col(y) - F.lag(y, 1).over(w)).alias("dy"))
    d = d.select("*", *lags(["dy"], n_lags, by, order)).dropna()
    names = ["level", *[f"dy_L{k}" for k in range(1, n_lags + 1)], "dy"]
    fixed = moments(d, by, [F.lit(1.0), *[F.col(c).cast("double") for c in names]])
    after = over(by, order, 1, Window.unboundedFollowing)
    sums = F.array(*[F.coalesce(F.sum(c).over(after), F.lit(0.0)) for c in (F.lit(1.0), *map(F.col, names))])
    each = d.select(*by, F.col("__i").alias("break_at"), "__n", sums.alias("a")).where((F.col("break_at") >= F.floor(trim * F.col("__n"))) & (F.col("break_at") <= F.floor((1 - trim) * F.col("__n"))))
    k = len(names) + 1  # constant, level, differences, break

    @F.pandas_udf("double")
    def statistic(m: pd.Series, a: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, s, t in zip(m, a, n, strict=True):
            full = np.zeros((k + 1, k + 1))
            full[np.ix_([*range(k - 1), k], [*range(k - 1), k])] = square(x, k)
            # a row's break regressor is its own square
            full[k - 1, [*range(k - 1), k]] = full[[*range(k - 1), k], k - 1] = s
            full[k - 1, k - 1] = s[0]
            scale = np.sqrt(np.maximum(np.diag(full)[:k], 1e-300))
            inv = np.linalg.pinv(full[:k, :k] / np.outer(scale, scale), rcond=1e-13) / np.outer(scale, scale)
            beta = inv @ full[:k, k]
            v = (full[k, k] - beta @ full[:k, k]) / (t - k) * inv[1, 1] if t > k else 0.0
            out.append(float(beta[1] / np.sqrt(v)) if v > 0 else None)
        return pd.Series(out, dtype=float)

    one = each.join(fixed, by) if by else each.join(F.broadcast(fixed))  # without groups, one row
    one = one.withColumn("t", F.nanvl(statistic("m", "a", "n"), F.lit(None).cast("double"))).where("t is not null")
    return one.groupBy(*by).agg(F.min(F.struct("t", "break_at", "n")).alias("b")).select(*by, F.col("b.t").alias("za_t"), F.col("b.break_at").alias("break_at"), F.col("b.n").alias("n"))


def gls_demeaned(df: DataFrame, by: list[str], order: str, y: str, c: float = -7.0) -> DataFrame:
    """by, order, and y less its mean by quasi-differences at 1 + c / T."""
    w, every = over(by, order), Window.partitionBy(*by)
    d = df.where(F.col(y).isNotNull()).select(*by, order, y, F.lag(y, 1).over(w).alias("__l"), (1 + c / F.count("*").over(every)).alias("__a"))
    first = F.col("__l").isNull()
    z, v = F.when(first, 1.0).otherwise(1 - F.col("__a")), F.when(first, F.col(y)).otherwise(F.col(y) - F.col("__a") * F.col("__l"))
    return d.select(*by, order, (F.col(y) - F.sum(z * v).over(every) / F.sum(z * z).over(every)).alias(y))


def df_gls(df: DataFrame, by: list[str], order: str, y: str, n_lags: int = 1) -> DataFrame:
    """by, dfgls_t, n: the t statistic of y_{t-1}, without a constant, after GLS demeaning."""
    w = over(by, order)
    d = gls_demeaned(df, by, order, y).select(*by, order, F.lag(y, 1).over(w).alias("level"), (F.col(y) - F.lag(y, 1).over(w)).alias("dy"))
    d = d.select("*", *lags(["dy"], n_lags, by, order))
    s = scores(d, by, "dy", ["level", *[f"dy_L{k}" for k in range(1, n_lags + 1)]], "level", constant=False)
    return estimate(s, by, "classical").select(*by, F.col("t").alias("dfgls_t"), "n")


def engle_granger(df: DataFrame, by: list[str], order: str, y: str, x: str, n_lags: int = 4) -> DataFrame:
    """by, beta, adf_t, p_value, n: y on x and a constant, and the residual's Dickey-Fuller statistic, whose p-value is
    approximate, by the normal at (t + 1.61) / 0.94."""
    r = scores(df, by, y, [x], x)
    w = over(by, order)
    d = r.select(*by, order, F.lag("u", 1).over(w).alias("level"), (F.col("u") - F.lag("u", 1).over(w)).alias("dy"))
    d = d.select("*", *lags(["dy"], n_lags, by, order))
    t = estimate(scores(d, by, "dy", ["level", *[f"dy_L{k}" for k in range(1, n_lags + 1)]], "level"), by, "classical").select(*by, F.col("t").alias("adf_t"), "n")
    p = F.pandas_udf(lambda v: ((v + 1.61) / 0.94).map(norm_cdf), "double")
    return r.groupBy(*by).agg(F.first("beta").alias("beta")).join(t, by).select(*by, "beta", "adf_t", p("adf_t").alias("p_value"), "n")


def dynamic_ols(df: DataFrame, by: list[str], order: str, y: str, x: str, ends: int = 2, bandwidth: int = 3, alpha: float = 0.10) -> DataFrame:
    """The long-run coefficient of x next to its differences ``ends`` dates either way, that of the date itself left out."""
    w = over(by, order)
    d = df.select(*by, order, y, x, (F.col(x) - F.lag(x, 1).over(w)).alias("__d"))
    shifts = [s for s in range(-ends, ends + 1) if s]
    names = {f"d{'m' if s < 0 else 'p'}{abs(s)}": (F.lag("__d", -s) if s < 0 else F.lead("__d", s)).over(w) for s in shifts}
    # the first difference that there is stands at the second date; before it 0 is taken
    d = d.withColumn("__i", F.row_number().over(w)).withColumn("__d", F.when(F.col("__i") == 1, 0.0).otherwise(F.col("__d"))).withColumns(names)
    return estimate(scores(d, by, y, [x, *names], x), by, "hac", order, most=bandwidth, alpha=alpha)


def johansen(df: DataFrame, order: str, cols: list[str], p: int = 2) -> pd.DataFrame:
    """r, trace, cv_5: the trace statistics of a VAR(p) with a constant for each rank, from one aggregation of moments."""
    w = Window.orderBy(order)  # one row a date
    diffs, n = [f"__d{i}" for i in range(len(cols))], len(cols)
    d = df.select(order, *[F.lag(c, 1).over(w).alias(f"__l{i}") for i, c in enumerate(cols)], *[(F.col(c) - F.lag(c, 1).over(w)).alias(f"__d{i}") for i, c in enumerate(cols)])
    d = d.select("*", *[F.lag(x, k).over(w).alias(f"{x}_{k}") for k in range(1, p) for x in diffs]).dropna()
    short = [f"{x}_{k}" for k in range(1, p) for x in diffs]
    row = moments(d, [], [F.lit(1.0), *map(F.col, short), *map(F.col, diffs), *[F.col(f"__l{i}") for i in range(n)]]).first()
    k, t = 1 + len(short), row["n"]
    a = square(row["m"], k + 2 * n)
    s = (a[k:, k:] - a[k:, :k] @ np.linalg.solve(a[:k, :k], a[:k, k:])) / t
    s00, s01, s11 = s[:n, :n], s[:n, n:], s[n:, n:]
    values = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01))).real)[::-1]
    stats = [float(-t * np.log1p(-values[r:]).sum()) for r in range(n)]
    return pd.DataFrame({"r": range(n), "trace": stats, "cv_5": [TRACE_5[n - r] for r in range(n)]})


def bai_perron(df: DataFrame, by: list[str], order: str, y: str, most: int = 3, trim: float = 0.15) -> DataFrame:
    """by, breaks, at, ssr: for each number of breaks in the mean the least squared residuals and the first rows of later
    regimes, by dynamic programming over a series' prefix sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[y].to_numpy(float)
        t, least = len(v), max(1, int(trim * len(v)))
        s, q = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
        cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(j - i, 1)
        best, cuts, out = np.where(np.arange(t + 1) >= least, cost(0, np.arange(t + 1)), np.inf), [[]] * (t + 1), []
        for m in range(most + 1):
            if np.isfinite(best[t]):
                out.append((*pdf[by].iloc[0], m, [int(c) for c in cuts[t]], float(best[t])))
            after, where = np.full(t + 1, np.inf), [[]] * (t + 1)
            for j in range((m + 2) * least, t + 1):
                i = np.arange((m + 1) * least, j - least + 1)
                total = best[i] + cost(i, j)
                k = int(np.argmin(total))
                after[j], where[j] = total[k], [*cuts[i[k]], int(i[k])]
            best, cuts = after, where
        return pd.DataFrame(out, columns=[*by, "breaks", "at", "ssr"])

    types = dict(df.dtypes)
    return df.select(*by, order, y).dropna().groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in by) + ", breaks int, at array<int>, ssr double")
