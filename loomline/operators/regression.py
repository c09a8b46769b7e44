"""Regressions as Spark aggregations.

The cross-moments of a design are one aggregation; a small system is solved per group; and the variance
of the coefficient that is asked for needs no matrix: with b the coefficient's row of the inverse
moment matrix, its contribution from row t is q_t = (b . x_t) u_t, one number. Robust, clustered,
autocorrelation-robust and Driscoll-Kraay variances are sums of products of q over rows, groups or lags.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_ppf
from .windows import horizons, lags


def moments(df: DataFrame, by: list[str], cols: list[Column]) -> DataFrame:
    """by, n, and m: the upper triangle of the columns' cross-product sums, row by row."""
    products = [F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    g = df.groupBy(*by).agg(F.count("*").alias("n"), *products)
    return g.select(*by, "n", F.array(*[f"m{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))]).alias("m"))


def square(m, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = m
    return out + out.T - np.diag(np.diag(out))


def solver(k: int, target: int):
    """Coefficients and the target's row of the inverse, from moments of k regressors and the outcome."""

    @F.pandas_udf("struct<beta:array<double>,row:array<double>,ssr:double>")
    def solve(m: pd.Series) -> pd.DataFrame:
        out = []
        for x in m:
            a = square(x, k + 1)
            scale = np.sqrt(np.maximum(np.diag(a)[:k], 1e-300))
            inv = np.linalg.pinv(a[:k, :k] / np.outer(scale, scale), rcond=1e-13) / np.outer(scale, scale)
            beta = inv @ a[:k, k]
            out.append((beta.tolist(), inv[target].tolist(), float(a[k, k] - beta @ a[:k, k])))
        return pd.DataFrame(out, columns=["beta", "row", "ssr"])

    return solve


def dot(values: list[Column], weights: Column) -> Column:
    return sum((weights[i] * v for i, v in enumerate(values)), F.lit(0.0))


def scores(df: DataFrame, by: list[str], y: str, xs: list[str], target: str, constant: bool = True) -> DataFrame:
    """Complete rows with beta (the target's), u, q and n.

    With a constant, moments are of deviations from the group's means: those of levels lose twice the digits by which a
    column's level exceeds its spread.
    """
    d = df.dropna(subset=[y, *xs])
    regressors, outcome = [F.col(x).cast("double") for x in xs], F.col(y).cast("double")
    joined = lambda a, b: a.join(b, by) if by else a.join(F.broadcast(b))  # noqa: E731  without groups, one row
    if constant:
        centre = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c))  # noqa: E731  one value: nothing but 0 is left
        d = joined(d, d.groupBy(*by).agg(F.array(*map(centre, [*regressors, outcome])).alias("__m")))
        *regressors, outcome = [c - F.col("__m")[i] for i, c in enumerate([*regressors, outcome])]
    at, k = xs.index(target), len(xs) + int(constant)
    solved = moments(d, by, [*regressors, outcome]).withColumn("s", solver(len(xs), at)("m"))
    classical = F.try_divide(F.col("s.ssr"), F.col("n") - k) * F.col("s.row")[at]
    solved = solved.select(*by, "n", F.col("s.beta").alias("__b"), F.col("s.row").alias("__r"), F.col("s.ssr").alias("ssr"), classical.alias("classical"))
    d = joined(d, solved)
    return d.withColumn("u", outcome - dot(regressors, F.col("__b"))).withColumn("q", dot(regressors, F.col("__r")) * F.col("u")).withColumn("beta", F.col("__b")[at]).drop("__m")


def _lagged(d: DataFrame, by: list[str], order: str, most: int, bandwidth: Column) -> DataFrame:
    """by, beta, n, variance: of q with Bartlett weights up to each group's bandwidth."""
    w = Window.partitionBy(*by).orderBy(order)
    d = d.withColumns({f"q{l}": F.lag("q", l).over(w) for l in range(1, most + 1)}).withColumn("__bw", bandwidth)
    terms = [2 * F.sum(F.when(F.lit(l) <= F.col("__bw"), (1 - l / (F.col("__bw") + 1)) * F.col("q") * F.col(f"q{l}"))) for l in range(1, most + 1)]
    total = F.sum(F.col("q") * F.col("q"))
    for t in terms:
        total = total + F.coalesce(t, F.lit(0.0))
    return d.groupBy(*by).agg(F.first("beta").alias("beta"), F.first("n").alias("n"), total.alias("variance"))


def estimate(d: DataFrame, by: list[str], se: str, order: str | None = None, cluster: str | None = None, most: int = 0, bandwidth: Column | None = None, alpha: float = 0.10) -> DataFrame:
    """beta, se, t, lo, hi, n by group from ``scores``; se: classical, hc0, hac, cluster (no small-sample factor), or dk."""
    if se == "classical":
        v = d.groupBy(*by).agg(F.first("beta").alias("beta"), F.first("n").alias("n"), F.first("classical").alias("variance"))
    elif se == "hac":
        v = _lagged(d, by, order, most, bandwidth if bandwidth is not None else F.lit(most))
    elif se == "dk":
        times = d.groupBy(*by, order).agg(F.sum("q").alias("q"), F.first("beta").alias("beta"), F.first("n").alias("n"))
        v = _lagged(times, by, order, most, bandwidth if bandwidth is not None else F.lit(most))
    else:
        parts = d if se == "hc0" else d.groupBy(*by, cluster).agg(F.sum("q").alias("q"), F.first("beta").alias("beta"), F.first("n").alias("n"))
        v = parts.groupBy(*by).agg(F.first("beta").alias("beta"), F.first("n").alias("n"), F.sum(F.col("q") * F.col("q")).alias("variance"))
    z = norm_ppf(1 - alpha / 2)
    v = v.withColumn("se", F.sqrt(F.greatest("variance", F.lit(0.0))))
    return v.select(*by, "beta", "se", F.try_divide("beta", "se").alias("t"), (F.col("beta") - z * F.col("se")).alias("lo"), (F.col("beta") + z * F.col("se")).alias("hi"), "n")


def ols(df: DataFrame, by: list[str], y: str, xs: list[str], target: str, se: str = "hc0", **options) -> DataFrame:
    return estimate(scores(df, by, y, xs, target), by, se, **options)


def lp_design(df: DataFrame, by: list[str], order: str, y: str, x: str, hs: list[int], n_lags: int, controls: list[str] = (), difference: bool = True) -> tuple[DataFrame, list[str]]:
    """Rows per horizon with the outcome ``dy``, and the names of the regressors, the shock first."""
    cols = [x, y, *controls]
    d = df.select(*by, order, *dict.fromkeys(cols), *lags(cols, n_lags, by, order))
    d = horizons(d, y, hs, by, order, difference)
    return d, [x, *[f"{c}_L{k}" for k in range(1, n_lags + 1) for c in cols], *controls]


def lp_hac(df: DataFrame, by: list[str], order: str, y: str, x: str, hs: list[int], n_lags: int = 2, controls: list[str] = (), alpha: float = 0.10) -> DataFrame:
    """Local projections of y_{t+h} - y_{t-1} on x and lags; bandwidth h + 1."""
    d, xs = lp_design(df, by, order, y, x, hs, n_lags, list(controls))
    return estimate(scores(d, [*by, "h"], "dy", xs, x), [*by, "h"], "hac", order, most=max(hs) + 1, bandwidth=F.col("h") + 1, alpha=alpha)


def la_lp(df: DataFrame, by: list[str], order: str, y: str, x: str, hs: list[int], n_lags: int = 2, extra: int | None = None, alpha: float = 0.10) -> DataFrame:
    """Lag-augmented: ``extra`` more lags (default: the largest horizon), heteroskedasticity-robust."""
    d, xs = lp_design(df, by, order, y, x, hs, n_lags + (max(hs) if extra is None else extra))
    return estimate(scores(d, [*by, "h"], "dy", xs, x), [*by, "h"], "hc0", alpha=alpha)


def lp_asymmetric(df: DataFrame, by: list[str], order: str, y: str, x: str, hs: list[int], n_lags: int = 2, alpha: float = 0.10) -> DataFrame:
    """Responses to positive and to negative values of x, by ``sign``."""
    d, xs = lp_design(df, by, order, y, x, hs, n_lags)
    d = d.withColumn("pos", F.when(F.col(x).isNotNull(), F.greatest(F.col(x), F.lit(0.0)))).withColumn("neg", F.when(F.col(x).isNotNull(), F.least(F.col(x), F.lit(0.0))))
    parts = [estimate(scores(d, [*by, "h"], "dy", ["pos", "neg", *xs[1:]], s), [*by, "h"], "hac", order, most=max(hs) + 1, bandwidth=F.col("h") + 1, alpha=alpha).withColumn("sign", F.lit(s)) for s in ("pos", "neg")]
    return parts[0].unionByName(parts[1])


def _state_rows(df: DataFrame, by: list[str], order: str, y: str, x: str, state: str, hs: list[int], n_lags: int, weight, controls: list[str], difference: bool) -> tuple[DataFrame, list[str]]:
    """Complete rows by horizon with x split by ``weight`` of the state standardised on the horizon's rows; a state that
    never moves is 0 there."""
    d, xs = lp_design(df.select(*by, order, *dict.fromkeys([y, x, *controls])), by, order, y, x, hs, n_lags, controls, difference)
    d = d.join(df.select(*by, order, F.col(state).cast("double").alias("__z")), [*by, order]).dropna()
    w = Window.partitionBy(*by, "h")
    z = (F.col("__z") - F.avg("__z").over(w)) / F.coalesce(F.nullif(F.stddev_pop("__z").over(w), F.lit(0.0)), F.lit(1.0))
    return d.withColumn("__f", weight(z)).withColumn("high", F.col("__f") * F.col(x)).withColumn("low", (1 - F.col("__f")) * F.col(x)), xs[1:]


def lp_state(df: DataFrame, by: list[str], order: str, y: str, x: str, state: str, hs: list[int], n_lags: int = 2, gamma: float = 3.0, alpha: float = 0.10, transition: str = "logistic", threshold: float = 0.0, controls: list[str] = ()) -> DataFrame:
    """Responses of y_{t+h} - y_{t-1} in the high and the low state: F(z) a logistic of the standardised state, or whether
    it is over ``threshold`` deviations (transition "threshold")."""
    if transition not in ("logistic", "threshold"):
        raise ValueError(f"unknown transition {transition!r}")
    weight = (lambda z: 1 / (1 + F.exp(-gamma * z))) if transition == "logistic" else lambda z: F.when(z > threshold, 1.0).otherwise(0.0)
    d, rest = _state_rows(df, by, order, y, x, state, hs, n_lags, weight, list(controls), True)
    parts = [estimate(scores(d, [*by, "h"], "dy", ["high", "low", *rest], s), [*by, "h"], "hac", order, most=max(hs) + 1, bandwidth=F.col("h") + 1, alpha=alpha).withColumn("state", F.lit(s)) for s in ("high", "low")]
    return parts[0].unionByName(parts[1])


def lp_smooth_transition(df: DataFrame, by: list[str], order: str, y: str, x: str, state: str, hs: list[int], n_lags: int = 2, gamma: float = 5.0, threshold: float = 0.0, alpha: float = 0.10, controls: list[str] = ()) -> DataFrame:
    """Responses of y_{t+h} itself, by a logistic of the standardised state around ``threshold``.

    Bandwidth ceil(((h + 1) n)^(2/9)), variances times n / (n - k).
    """
    keys = [*by, "h"]
    d, rest = _state_rows(df, by, order, y, x, state, hs, n_lags, lambda z: 1 / (1 + F.exp(-gamma * (z - threshold))), list(controls), False)
    width = lambda n: F.greatest(F.lit(1), F.ceil(F.pow((F.col("h") + 1) * n, F.lit(2 / 9))))
    # the widest of all horizons, from one count of the rows
    most = int(d.groupBy(*keys).count().agg(F.max(width(F.col("count")))).first()[0] or 1)
    z, k = norm_ppf(1 - alpha / 2), 3 + len(rest)
    parts = []
    for s in ("high", "low"):
        one = estimate(scores(d, keys, "dy", ["high", "low", *rest], s), keys, "hac", order, most=most, bandwidth=width(F.col("n")), alpha=alpha)
        one = one.withColumn("se", F.col("se") * F.sqrt(F.try_divide(F.col("n").cast("double"), F.greatest(F.col("n") - k, F.lit(0)))))
        parts.append(one.select(*keys, "beta", "se", F.try_divide("beta", "se").alias("t"), (F.col("beta") - z * F.col("se")).alias("lo"), (F.col("beta") + z * F.col("se")).alias("hi"), "n", F.lit(s).alias("state")))
    return parts[0].unionByName(parts[1])


def lp_iv(df: DataFrame, by: list[str], order: str, y: str, x: str, z: str, hs: list[int], n_lags: int = 2, alpha: float = 0.10) -> DataFrame:
    """Two regressions: x on z, then the outcome on fitted x, whose residuals give the standard error (as
    published, uncorrected). first_stage_f is (pi / se)^2."""
    d, xs = lp_design(df, by, order, y, x, hs, n_lags)
    d = d.join(df.select(*by, order, F.col(z).alias("__z")), [*by, order]).dropna(subset=["dy", *xs, "__z"])
    keys, rest = [*by, "h"], xs[1:]
    first = scores(d, keys, x, ["__z", *rest], "__z")
    f = estimate(first, keys, "hac", order, most=max(hs) + 1, bandwidth=F.col("h") + 1).select(*keys, (F.col("t") * F.col("t")).alias("first_stage_f"))
    fitted = first.withColumn("fitted", F.col(x) - F.col("u")).drop("u", "q", "beta", "n", "__b", "__r", "ssr", "classical")
    return estimate(scores(fitted, keys, "dy", ["fitted", *rest], "fitted"), keys, "hac", order, most=max(hs) + 1, bandwidth=F.col("h") + 1, alpha=alpha).join(f, keys)


def time_effects(d: DataFrame, cols: list[str], by: list[str], entity: str, time: str) -> DataFrame:
    """by, time, and for each column its least-squares time effect (b0, b1, ...) next to entity effects, rows weighted
    mean 0, whatever rows are missing.

    The normal equations of the dates alone: a count of entities by pair of dates, from each entity's own list of
    dates, and sums of deviations from entity means. One small system per group is solved in its task.
    """
    e = Window.partitionBy(*by, entity)
    sums = d.withColumns({f"__d{i}": F.col(c) - F.avg(c).over(e) for i, c in enumerate(cols)}).groupBy(*by, time).agg(F.count("*").cast("double").alias("n"), *[F.sum(f"__d{i}").alias(f"b{i}") for i in range(len(cols))])
    dates = d.groupBy(*by, entity).agg(F.collect_list(time).alias("ts"))
    pairs = dates.select(*by, F.explode("ts").alias("t"), "ts").select(*by, "t", F.explode("ts").alias("s"), (1.0 / F.size("ts")).alias("w")).groupBy(*by, "t", "s").agg(F.sum("w").alias("w"))
    names = [f"b{i}" for i in range(len(cols))]

    def solve(pair: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        place = {t: i for i, t in enumerate(total[time])}
        a, n = np.diag(total["n"].to_numpy()), total["n"].to_numpy()
        np.subtract.at(a, (pair["t"].map(place).to_numpy(), pair["s"].map(place).to_numpy()), pair["w"].to_numpy())
        b = np.linalg.pinv(a, rcond=1e-11, hermitian=True) @ total[names].to_numpy()
        out = total[[*by, time]].copy()
        out[names] = b - n @ b / n.sum()
        return out

    types = dict(d.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in [*by, time]), *(f"{c} double" for c in names)])
    pairs = pairs.select(*[F.col(b).alias(f"k_{b}") for b in by], "t", "s", "w")  # columns of their own, as both sides come from one frame
    return pairs.groupBy(*[f"k_{b}" for b in by]).cogroup(sums.groupBy(*by)).applyInPandas(solve, schema)


def within(df: DataFrame, cols: list[str], by: list[str], entity: str, time: str | None) -> DataFrame:
    """Columns less least-squares entity effects, and time effects if asked for; rows may be missing anywhere."""
    e = Window.partitionBy(*by, entity)
    if not time:
        return df.withColumns({c: F.col(c) - F.avg(c).over(e) for c in cols})
    b = time_effects(df, cols, by, entity, time)
    d = df.join(b, [*by, time]).withColumns({c: F.col(c) - F.col(f"b{i}") for i, c in enumerate(cols)}).drop(*[f"b{i}" for i in range(len(cols))])
    return d.withColumns({c: F.col(c) - F.avg(c).over(e) for c in cols})


def panel_lp(df: DataFrame, entity: str, time: str, y: str, x: str, hs: list[int], n_lags: int = 2, se: str = "cluster", alpha: float = 0.10, two_way: bool = True) -> DataFrame:
    """Long differences on x and lags with entity and time effects; clustered by entity, or Driscoll-Kraay with
    max(1, round(4 (rows / 100)^(2/9))) lags."""
    d, xs = lp_design(df, [entity], time, y, x, hs, n_lags)
    d = within(d.dropna(subset=["dy", *xs]), ["dy", *xs], ["h"], entity, time if two_way else None)
    s = _no_constant(d, xs, x)
    if se == "cluster":
        return estimate(s, ["h"], "cluster", cluster=entity, alpha=alpha)
    width = lambda n: F.greatest(F.lit(1), F.round(4 * F.pow(n / 100, F.lit(2 / 9))))
    # the widest of all horizons, from one count of the rows
    most = d.groupBy("h").count().agg(F.max(width(F.col("count")))).first()[0]
    return estimate(s, ["h"], "dk", time, most=int(most or 1), bandwidth=width(F.col("n")), alpha=alpha)


def _no_constant(d: DataFrame, xs: list[str], x: str) -> DataFrame:
    return scores(d, ["h"], "dy", xs, x, constant=False)


def mean_group(df: DataFrame, entity: str, time: str, y: str, x: str, hs: list[int], n_lags: int = 2, least: int = 30, alpha: float = 0.10) -> DataFrame:
    """Unweighted mean of the entities' coefficients; se from their spread."""
    one = lp_hac(df, [entity], time, y, x, hs, n_lags).where(F.col("n") >= least)
    z = norm_ppf(1 - alpha / 2)
    d = one.groupBy("h").agg(F.avg("beta").alias("beta"), F.try_divide(F.stddev_samp("beta"), F.sqrt(F.count("*").cast("double"))).alias("se"), F.count("*").alias("n"))
    return d.withColumn("lo", F.col("beta") - z * F.col("se")).withColumn("hi", F.col("beta") + z * F.col("se"))


def cce_lp(df: DataFrame, entity: str, time: str, y: str, x: str, hs: list[int], n_lags: int = 2, alpha: float = 0.10) -> DataFrame:
    """Entity effects, with the cross-section means of y and x of each date as controls."""
    w = Window.partitionBy(time)
    d = df.withColumn("m_y", F.avg(y).over(w)).withColumn("m_x", F.avg(x).over(w))
    design, xs = lp_design(d, [entity], time, y, x, hs, n_lags, ["m_y", "m_x"])
    xs = [c for c in xs if not c.startswith("m_") or "_L" not in c]
    rows = within(design.dropna(subset=["dy", *xs]), ["dy", *xs], ["h"], entity, None)
    return estimate(_no_constant(rows, xs, x), ["h"], "cluster", cluster=entity, alpha=alpha)


def lp_did(df: DataFrame, unit: str, time: str, y: str, treat_time: str, hs: list[int], alpha: float = 0.10) -> DataFrame:
    """Newly treated against not yet (or never) treated at t + h, period effects, clustered by unit; h = -1 is 0.

    Time is an integer. Rows: treated in t with y at t + h and t - 1, and units with treatment after t + h.
    """
    w = Window.partitionBy(unit).orderBy(time)
    ups = [F.struct(F.lit(h).alias("h"), (F.lead(y, h).over(w) if h > 0 else F.lag(y, -h).over(w) if h < 0 else F.col(y)).alias("v")) for h in hs if h != -1]
    d = df.withColumn("__b", F.lag(y, 1).over(w)).withColumn("__h", F.array(*ups)).withColumn("__e", F.explode("__h")).select(unit, time, treat_time, F.col("__e.h").alias("h"), (F.col("__e.v") - F.col("__b")).alias("dy"))
    new = F.col(treat_time).eqNullSafe(F.col(time))
    clean = F.col(treat_time).isNull() | (F.col(treat_time) > F.col(time) + F.greatest(F.col("h"), F.lit(0)))
    d = d.where("dy is not null").withColumn("treated", F.when(new, 1.0).otherwise(0.0)).where(new | clean)
    d = within(d, ["dy", "treated"], ["h"], time, None)
    out = estimate(_no_constant(d, ["treated"], "treated"), ["h"], "cluster", cluster=unit, alpha=alpha)
    zero = out.sparkSession.createDataFrame([(-1, 0.0, 0.0, None, 0.0, 0.0, 0)], out.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    return out.union(zero)
