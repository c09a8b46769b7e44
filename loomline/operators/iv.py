"""Instrumental variables and tests of them, on cross-moments and sums of scores.

What needs no more than second moments (two-stage coefficients, concentration, Anderson-Rubin over a whole
grid, over-identification) is one aggregation and a small solve per group; robust variances take one more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, f_sf, norm_cdf, norm_ppf
from .regression import dot, estimate, lp_design, moments, panel_lp, scores, square, within


def _by_moments(df: DataFrame, by: list[str], cols: list[str], result: str, solve) -> DataFrame:
    """``solve`` (cross-moments of 1 and ``cols``, n) -> a tuple of ``result`` for each group of complete rows."""
    names = [f.split()[0] for f in result.split(", ")]

    @F.pandas_udf(", ".join(result.split(", ")).join(("struct<", ">")).replace(" ", ":").replace(",:", ", "))
    def run(m: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([solve(square(x, len(cols) + 1), int(k)) for x, k in zip(m, n, strict=True)], columns=names)

    d = df.dropna(subset=cols)
    g = moments(d, by, [F.lit(1.0), *[F.col(c).cast("double") for c in cols]])
    return g.withColumn("__s", run("m", "n")).select(*by, *[F.col(f"__s.{x}").alias(x) for x in names], "n")


def two_stage(df: DataFrame, by: list[str], y: str, x: str, zs: list[str], ws: list[str] = (), se: str = "classical", cluster: str | None = None, alpha: float = 0.10) -> DataFrame:
    """by, beta, se, lo, hi, n of x in y on 1, x and ws with instruments zs. se: classical, with the residual at x itself over
    n; hc0; or cluster, without a small-sample factor."""
    k, l = len(ws) + 1, len(zs)

    def solve(a: np.ndarray, n: int):
        own, ex, at_x, at_y = list(range(k)), list(range(k, k + l)), k + l, k + l + 1
        q = own + ex
        first = np.linalg.solve(a[np.ix_(q, q)], a[q, at_x])
        # moments of (x fitted, 1, ws) with themselves, and with y
        lift = np.zeros((len(a), k + 1))
        lift[q, 0] = first
        lift[own, range(1, k + 1)] = 1
        inverse = np.linalg.inv(lift.T @ a @ lift)
        beta = inverse @ (lift.T @ a[:, at_y])
        resid = np.zeros(len(a))
        resid[at_y], resid[at_x], resid[own] = 1, -beta[0], -beta[1:]
        s2 = float(resid @ a @ resid) / n
        return float(beta[0]), float(np.sqrt(max(s2, 0) * inverse[0, 0])), (lift @ inverse[0]).tolist(), resid.tolist()

    solved = _by_moments(df, by, [*ws, *zs, x, y], "beta double, se double, pick array<double>, resid array<double>", solve)
    if se != "classical":
        d = df.dropna(subset=[*ws, *zs, x, y])
        cols = [F.lit(1.0), *[F.col(c).cast("double") for c in (*ws, *zs, x, y)]]
        d = d.join(solved, by) if by else d.join(F.broadcast(solved))  # without groups, one row
        d = d.withColumn("q", dot(cols, F.col("pick")) * dot(cols, F.col("resid")))
        solved = estimate(d, by, se, cluster=cluster)
    z = norm_ppf(1 - alpha / 2)
    return solved.select(*by, "beta", "se", (F.col("beta") - z * F.col("se")).alias("lo"), (F.col("beta") + z * F.col("se")).alias("hi"), "n")


def first_stage(df: DataFrame, by: list[str], x: str, zs: list[str], cluster: str | None = None) -> DataFrame:
    """by, cragg_donald (of x on zs, nothing partialled out), robust_f and effective_f (demeaned, by row or cluster), n.

    robust_f: coefficients' Wald statistic over their number; effective_f: pi'Z'Z pi / tr((Z'Z)^-1 Omega).
    """
    l = len(zs)

    def solve(a: np.ndarray, n: int):
        zz, zx, xx = a[1 : l + 1, 1 : l + 1], a[1 : l + 1, l + 1], a[l + 1, l + 1]
        fit = zx @ np.linalg.solve(zz, zx)
        c = a[1:, 1:] - np.outer(a[0, 1:], a[0, 1:]) / n
        pi = np.linalg.solve(c[:l, :l], c[:l, l])
        return float(fit / max((xx - fit) / (n - l), 1e-300)), pi.tolist(), c[:l, :l].ravel().tolist(), (a[0, 1:] / n).tolist()

    solved = _by_moments(df, by, [*zs, x], "cragg_donald double, pi array<double>, zz array<double>, mean array<double>", solve)
    d = df.dropna(subset=[*zs, x])
    d = d.join(solved, by) if by else d.join(F.broadcast(solved))  # without groups, one row
    dev = [F.col(z) - F.col("mean")[i] for i, z in enumerate(zs)]
    u = F.col(x) - F.col("mean")[l] - dot(dev, F.col("pi"))
    d = d.withColumns({f"__u{i}": v * u for i, v in enumerate(dev)})
    keys = [*by, *([cluster] if cluster else [])]
    if cluster:
        d = d.groupBy(*keys).agg(*[F.sum(f"__u{i}").alias(f"__u{i}") for i in range(l)], *[F.first(c).alias(c) for c in ("pi", "zz", "cragg_donald", "n")])
    omega = F.array(*[F.sum(F.col(f"__u{i}") * F.col(f"__u{j}")) for i in range(l) for j in range(l)])
    g = d.groupBy(*by).agg(omega.alias("omega"), *[F.first(c).alias(c) for c in ("pi", "zz", "cragg_donald", "n")])

    @F.pandas_udf("struct<robust_f:double,effective_f:double>")
    def run(pi: pd.Series, zz: pd.Series, om: pd.Series) -> pd.DataFrame:
        out = []
        for p, a, o in zip(pi, zz, om, strict=True):
            p, a, o = np.asarray(p), np.reshape(a, (l, l)), np.reshape(o, (l, l))
            inv = np.linalg.inv(a)
            out.append((float(p @ np.linalg.pinv(inv @ o @ inv) @ p) / l, float(p @ a @ p / max(np.trace(inv @ o), 1e-300))))
        return pd.DataFrame(out, columns=["robust_f", "effective_f"])

    return g.withColumn("__s", run("pi", "zz", "omega")).select(*by, "cragg_donald", "__s.robust_f", "__s.effective_f", "n")


def anderson_rubin(df: DataFrame, by: list[str], y: str, x: str, zs: list[str], grid: list[float], ws: list[str] = ()) -> DataFrame:
    """by, beta0, f_stat, p_value: whether zs belong in y - beta0 x next to 1 and ws, for the whole grid from one aggregation."""
    k, l = len(ws) + 1, len(zs)

    def solve(a: np.ndarray, n: int):
        own, every, out = list(range(k)), list(range(k + l)), []
        for b in grid:
            pick = np.zeros(len(a))
            pick[k + l], pick[k + l + 1] = -b, 1
            total, cross = pick @ a @ pick, a @ pick
            rss = [total - cross[q] @ np.linalg.solve(a[np.ix_(q, q)], cross[q]) for q in (own, every)]
            stat = float((rss[0] - rss[1]) / l / (rss[1] / (n - k - l))) if n > k + l and rss[1] > 0 else float("nan")
            out.append({"beta0": float(b), "f_stat": stat, "p_value": float(f_sf(stat, l, n - k - l)) if stat == stat else float("nan")})
        return (out,)

    out = _by_moments(df, by, [*ws, *zs, x, y], "tests array<struct<beta0:double,f_stat:double,p_value:double>>", solve)
    return out.select(*by, F.explode("tests").alias("t")).select(*by, "t.*")


def anderson_rubin_band(tests: DataFrame, by: list[str], alpha: float = 0.10) -> DataFrame:
    """by, lo, hi: the ends of the grid's points that aren't rejected, or the likeliest point where all are."""
    kept = F.when(F.col("p_value") >= alpha, F.col("beta0"))
    top = F.max_by("beta0", F.struct("p_value", -F.col("beta0")))
    return tests.groupBy(*by).agg(F.coalesce(F.min(kept), top).alias("lo"), F.coalesce(F.max(kept), top).alias("hi"))


def hansen(df: DataFrame, by: list[str], y: str, x: str, zs: list[str], ws: list[str] = ()) -> DataFrame:
    """by, j_stat, p_value, df, n: rows times R-squared of the two-stage residual on 1, ws and zs."""
    k, l = len(ws) + 1, len(zs)

    def solve(a: np.ndarray, n: int):
        q, right = list(range(k + l)), [k + l, *range(k)]
        proj = np.linalg.solve(a[np.ix_(q, q)], a[np.ix_(q, [*right, k + l + 1])])
        hat = a[np.ix_(q, right)].T @ proj
        beta = np.linalg.solve(hat[:, :-1], hat[:, -1])
        u = np.zeros(len(a))
        u[k + l + 1], u[right] = 1, -beta
        cross = (a @ u)[q]
        explained, total, mean = cross @ np.linalg.solve(a[np.ix_(q, q)], cross), u @ a @ u, (a @ u)[0] / n
        j = float(n * (1 - (total - explained) / (total - n * mean * mean)))
        return j, float(chi2_sf(j, l - 1)) if l > 1 else float("nan"), l - 1

    return _by_moments(df, by, [*ws, *zs, x, y], "j_stat double, p_value double, df int", solve)


def lewbel(df: DataFrame, by: list[str], y: str, x: str, zs: list[str], alpha: float = 0.10) -> DataFrame:
    """Two-stage estimates without outside instruments: the centred zs times the residual of x on them stand for some."""
    r = scores(df.dropna(subset=[y, x, *zs]), by, x, zs, zs[0])
    w = Window.partitionBy(*by)
    made = {f"__g{i}": (F.col(z) - F.avg(z).over(w)) * F.col("u") for i, z in enumerate(zs)}
    d = r.select(*by, y, x, *zs, "u").withColumns(made)
    return two_stage(d, by, y, x, list(made), zs, alpha=alpha)


def cleaned(df: DataFrame, by: list[str], z: str, controls: list[str]) -> DataFrame:
    """Complete rows with ``cleaned``: what controls and a constant don't explain of an instrument."""
    d = scores(df, by, z, controls, controls[0])
    return d.select(*df.columns, F.col("u").alias("cleaned"))


def panel_lp_iv(df: DataFrame, entity: str, time: str, y: str, x: str, z: str, hs: list[int], n_lags: int = 2, alpha: float = 0.10) -> DataFrame:
    """One first stage of x on z with entity and time effects, then the panel projection on its slope times z."""
    d = df.select(F.lit(0).alias("h"), entity, time, x, z).dropna()
    first = estimate(scores(within(d, [x, z], ["h"], entity, time), ["h"], x, [z], z, constant=False), ["h"], "cluster", cluster=entity).select(F.col("beta").alias("__pi"), (F.col("t") * F.col("t")).alias("first_stage_f"))
    fitted = df.join(F.broadcast(first)).withColumn("__fit", F.col("__pi") * F.col(z))  # one row
    return panel_lp(fitted, entity, time, y, "__fit", hs, n_lags, alpha=alpha).join(F.broadcast(first.select("first_stage_f")))


def pooled(df: DataFrame, entity: str, y: str, x: str, z: str | None = None, alpha: float = 0.10) -> DataFrame:
    """Coefficient of x in y with entity effects, by z if given (just identified), clustered by entity."""
    cols = [y, x, *([z] if z else [])]
    d = within(df.select(F.lit(0).alias("__g"), entity, *cols).dropna(), cols, ["__g"], entity, None)
    zz = z or x
    b = d.groupBy("__g").agg((F.sum(F.col(zz) * F.col(y)) / F.sum(F.col(zz) * F.col(x))).alias("beta"), F.sum(F.col(zz) * F.col(x)).alias("zx"), F.count("*").alias("n"))
    d = d.join(F.broadcast(b), "__g").withColumn("q", F.col(zz) * (F.col(y) - F.col("beta") * F.col(x)) / F.col("zx"))  # one row
    return estimate(d, ["__g"], "cluster", cluster=entity, alpha=alpha).drop("__g")


def regime_interaction(df: DataFrame, entity: str, time: str, y: str, x: str, regime: str, hs: list[int], n_lags: int = 2, alpha: float = 0.10) -> DataFrame:
    """h, regime, beta, se, lo, hi, n: the response of y_{t+h} by the regime at t, with entity effects, Driscoll-Kraay, and
    ``wald_p`` that the two regimes' responses are equal (0 and 1)."""
    design, xs = lp_design(df, [entity], time, y, x, hs, n_lags, difference=False)
    d = design.join(df.select(entity, time, F.col(regime).cast("double").alias("__state")), [entity, time])
    d = d.withColumns({"x1": F.col("__state") * F.col(x), "x0": (1 - F.col("__state")) * F.col(x)}).dropna(subset=["dy", "x0", "x1", "__state", *xs])
    cols = ["x1", "x0", "__state", *xs[1:]]
    rows = within(d, ["dy", *cols], ["h"], entity, None)
    width = lambda n: F.greatest(F.lit(1), F.round(4 * F.pow(n / 100, F.lit(2 / 9))))
    most = int(d.groupBy("h").count().agg(F.max(width(F.col("count")))).first()[0] or 1)
    one = lambda target, columns: estimate(scores(rows, ["h"], "dy", columns, target, constant=False), ["h"], "dk", time, most=most, bandwidth=width(F.col("n")), alpha=alpha)
    parts = one("x1", cols).withColumn("regime", F.lit(1)).unionByName(one("x0", cols).withColumn("regime", F.lit(0)))
    # x itself next to x1: the coefficient of x1 is then the difference of the two
    gap = one("x1", ["x1", x, "__state", *xs[1:]]).select("h", F.col("t").alias("__t"))
    p = F.pandas_udf(lambda t: t.map(lambda v: float(chi2_sf(v * v, 1)), na_action="ignore"), "double")
    return parts.join(gap, "h").withColumn("wald_p", p("__t")).drop("__t", "t")


def cross_dependence(df: DataFrame, entity: str, time: str, u: str) -> DataFrame:
    """One row: cd_stat and p_value of no cross-section dependence in a balanced panel of residuals.

    The sum of all pairs' correlations is half the sum over dates of the squared total of standardised residuals less
    the sum of their squares, so no pairs are formed.
    """
    w = Window.partitionBy(entity)
    d = df.select(entity, time, ((F.col(u) - F.avg(u).over(w)) / F.stddev_pop(u).over(w)).alias("z"))
    t = d.groupBy(time).agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("ss"), F.count("*").alias("k"))
    g = t.agg(F.sum((F.col("s") * F.col("s") - F.col("ss")) / 2).alias("pairs"), F.count("*").alias("t"), F.max("k").alias("k"))
    stat = F.sqrt(2 * F.col("t") / (F.col("k") * (F.col("k") - 1))) * F.col("pairs") / F.col("t")
    p = F.pandas_udf(lambda s: 2 * (1 - s.abs().map(norm_cdf)), "double")
    return g.select(stat.alias("cd_stat")).withColumn("p_value", p("cd_stat"))


def slope_homogeneity(df: DataFrame, entity: str, y: str, xs: list[str], target: str) -> DataFrame:
    """One row: Swamy's statistic of equal coefficients over entities, with its degrees of freedom and p_value."""
    d = estimate(scores(df, [entity], y, xs, target), [entity], "classical")
    mean = d.agg(F.avg("beta").alias("__m"))  # one row
    g = d.join(F.broadcast(mean)).agg(F.sum(F.pow((F.col("beta") - F.col("__m")) / F.col("se"), 2)).alias("stat"), (F.count("*") - 1).alias("df"))
    p = F.pandas_udf(lambda s, k: pd.Series([None if v != v else float(chi2_sf(v, n)) for v, n in zip(s, k, strict=True)], dtype=float), "double")
    return g.withColumn("p_value", p("stat", "df"))
