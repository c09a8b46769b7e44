"""Smooth responses over horizons, and what components add to an aggregate's variance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_ppf


def spline_basis(x: np.ndarray, knots: int) -> np.ndarray:
    """Cubic B-splines over equally spaced knots from the least to the largest of ``x``, by the recursion over degrees."""
    inner = np.linspace(x.min(), x.max(), knots)
    t = np.concatenate([[inner[0]] * 3, inner, [inner[-1]] * 3])
    basis = ((x[:, None] >= t[:-1]) & (x[:, None] < t[1:])).astype(float)
    basis[x == inner[-1], knots + 1] = 1.0  # the last interval has its end
    for d in (1, 2, 3):
        ratio = lambda num, den: np.divide(num, den, out=np.zeros(np.broadcast_shapes(num.shape, den.shape)), where=np.broadcast_to(den > 0, np.broadcast_shapes(num.shape, den.shape)))
        up = ratio(x[:, None] - t[: -d - 1], t[d:-1] - t[: -d - 1])
        down = ratio(t[d + 1 :] - x[:, None], t[d + 1 :] - t[1:-d])
        basis = up * basis[:, :-1] + down * basis[:, 1:]
    return basis


def smoother(hs: np.ndarray, knots: int, penalty: float) -> np.ndarray:
    """The matrix that takes raw values at horizons to smooth ones, under a penalty on second differences of coefficients."""
    b = spline_basis(hs.astype(float), knots)
    d = np.diff(np.eye(b.shape[1]), n=2, axis=0)
    return b @ np.linalg.solve(b.T @ b + penalty * d.T @ d, b.T)


def smooth_responses(estimates: DataFrame, by: list[str], knots: int = 6, penalty: float | None = None, alpha: float = 0.10) -> DataFrame:
    """by, h, beta, se, lo, hi, penalty: estimates (by, h, beta, se) of ``lp_hac`` or others, smooth over horizons.

    The penalty, where none is given, is that of 30 from 10^-3 to 10^4 with the least generalised cross-validation. Errors take estimates at horizons as
    independent. A group needs four horizons with beta and se; others give none. A group is as many rows as it has horizons.
    """
    grid = np.logspace(-3, 4, 30)

    @F.pandas_udf("array<struct<h:int,beta:double,se:double,penalty:double>>")
    def each(h: pd.Series, beta: pd.Series, se: pd.Series) -> pd.Series:
        out = []
        for hs, b, s in zip(h, beta, se, strict=True):
            hs, b, s = np.asarray(hs), np.asarray(b, float), np.asarray(s, float)
            best = penalty
            if best is None:
                fits = [(p, smoother(hs, knots, p)) for p in grid]
                best = min(fits, key=lambda f: ((b - f[1] @ b) ** 2).sum() / max(1e-12, (1 - np.trace(f[1]) / len(b)) ** 2))[0]
            a = smoother(hs, knots, best)
            out.append([{"h": int(i), "beta": float(v), "se": float(e), "penalty": float(best)} for i, v, e in zip(hs, a @ b, np.sqrt((a * a) @ (s * s)), strict=True)])
        return pd.Series(out)

    rows = F.sort_array(F.collect_list(F.struct("h", "beta", "se")))
    g = estimates.dropna(subset=["h", "beta", "se"]).groupBy(*by).agg(rows.alias("r")).where(F.size("r") >= 4)
    z = norm_ppf(1 - alpha / 2)
    d = g.select(*by, F.explode(each("r.h", "r.beta", "r.se")).alias("s")).select(*by, "s.*")
    return d.select(*by, "h", "beta", "se", (F.col("beta") - z * F.col("se")).alias("lo"), (F.col("beta") + z * F.col("se")).alias("hi"), "penalty")


def shapley_variance(panel: DataFrame, by: list[str], order: str, component: str, growth: str, weight: str) -> DataFrame:
    """by, component, phi, share, n: what each component adds to the variance of the weighted sum of components.

    The Shapley value is the mean, over all orders in which components join, of what one adds to the joined ones' variance. A
    variance is a sum over pairs, each of which adds as much to either side's value, so the mean over all orders is the covariance of the component's
    own part with the whole: one aggregation for any number of components. Parts add up to the variance (over n). Only dates on
    which all components have growth and weight count; two rows of one component and date are added up. A share is null where nothing varies.
    """
    part = F.sum(F.col(growth).cast("double") * F.col(weight).cast("double")).alias("part")
    d = panel.dropna(subset=[order, component, growth, weight]).groupBy(*by, order, F.col(component).alias("component")).agg(part)
    all_ = d.groupBy(*by).agg(F.count_distinct("component").alias("of"))
    dates = d.groupBy(*by, order).agg(F.sum("part").alias("whole"), F.count("*").alias("here"))
    dates = (dates.join(all_, by) if by else dates.join(F.broadcast(all_))).where("here = of")  # without groups, one row
    phi = d.join(dates.select(*by, order, "whole"), [*by, order]).groupBy(*by, "component").agg(F.covar_pop("part", "whole").alias("phi"), F.count("*").alias("n"))
    return phi.select(*by, "component", "phi", F.try_divide("phi", F.sum("phi").over(Window.partitionBy(*by))).alias("share"), "n")
