"""Quantile regressions by aggregations over rows, exact though only rows near the fit are ever gathered.

A small group is solved in one task. In a large one the check function is first smoothed by a logistic kernel: Newton's steps
need the sums of value, gradient and Hessian, one aggregation each, while the kernel narrows. Rows far from that fit lie above or below the exact
one as well; there the check function is linear, so they count by one sum. The ``most`` rows nearest to it and that sum are a small problem with the same
solution, which is solved exactly; one more aggregation confirms that no far row has changed its side, else a new band is drawn around
the better fit. Replicates are weights of the rows.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .regression import dot, lp_design, square

#: A group between passes: its last accepted coefficients, the step to try next, and the kernel's width.
STATE = "struct<base:array<double>,step:array<double>,value:double,slope:double,width:double,least:double,tries:int,done:boolean>"
#: Bands tried around a fit are this part of the kernel's width, doubled from one to the next.
NARROWEST, BANDS = 2.0**-16, 28


def _residuals(rows: DataFrame, k: int, beta: str) -> DataFrame:
    return rows.withColumn("u", F.col("y") - dot([F.col(f"x{i}") for i in range(k)], F.col(beta)))


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _loss(u: Column) -> Column:
    return F.when(u >= 0, F.col("tau") * u).otherwise((F.col("tau") - 1) * u)


def _smooth_pass(rows: DataFrame, k: int, states: DataFrame) -> DataFrame:
    """key, state and the sums of the smoothed function at each open group's next coefficients."""
    at = F.zip_with("state.base", "state.step", lambda a, b: a + b)
    d = _residuals(rows.join(states.where("not state.done").withColumn("at", at), "key"), k, "at").withColumn("z", F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("u") / F.col("state.width"))))
    h, z = F.col("state.width"), F.col("z")
    d = d.withColumn("below", 1 / (1 + F.exp(z))).withColumn("value", F.col("w") * (F.col("tau") * F.col("u") + h * F.log1p(F.exp(-F.abs(z))) + F.greatest(-F.col("u"), F.lit(0.0))))
    d = d.withColumn("first", F.col("w") * (F.col("tau") - F.col("below"))).withColumn("second", F.col("w") * F.col("below") * (1 - F.col("below")) / h)
    x = [F.col(f"x{i}") for i in range(k)]
    g = d.groupBy("key").agg(F.first("state").alias("state"), F.sum("value").alias("value"), *[F.sum(v * F.col("first")).alias(f"g{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j] * F.col("second")).alias(f"h{i}_{j}") for i, j in _upper(k)])
    return g.select("key", "state", "value", F.array(*[f"g{i}" for i in range(k)]).alias("g"), F.array(*[f"h{i}_{j}" for i, j in _upper(k)]).alias("h"))


def _stepper(k: int):
    """Each group's next state: accept the last step or halve it, go on to the minimum, or narrow the kernel."""

    @F.pandas_udf(STATE)
    def step(state: pd.DataFrame, value: pd.Series, g: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for s, v, gi, hi in zip(state.to_dict("records"), value, g, h, strict=True):
            tried = np.asarray(s["step"])
            if not v <= s["value"] + 1e-4 * s["slope"] and s["tries"] < 30:
                out.append({**s, "step": (tried / 2).tolist(), "slope": s["slope"] / 2, "tries": s["tries"] + 1})
                continue
            base, hess = np.asarray(s["base"]) + tried, square(hi, k)
            newton = np.linalg.lstsq(hess + 1e-10 * np.trace(hess) / k * np.eye(k), np.asarray(gi), rcond=None)[0]
            decrement = float(np.asarray(gi) @ newton)
            if decrement > 1e-3 * s["width"] * k and s["tries"] < 30:
                out.append({**s, "base": base.tolist(), "step": newton.tolist(), "value": v, "slope": -decrement, "tries": s["tries"] + 1})
            else:
                out.append({**s, "base": (base + newton).tolist(), "step": [0.0] * k, "value": float("inf"), "slope": 0.0, "tries": 0, "done": s["width"] <= s["least"], "width": max(s["least"], s["width"] * 0.2)})
        return pd.DataFrame(out, columns=["base", "step", "value", "slope", "width", "least", "tries", "done"])

    return step


def minimum(y: np.ndarray, x: np.ndarray, w: np.ndarray, tau: float, linear: np.ndarray) -> np.ndarray:
    """The coefficients that minimise the weighted check function of y - x beta less linear beta, for few rows.

    Newton's steps follow the minima under the barrier of the linear programme; the fit through the nearest rows then replaces
    their end if it is as good, so that the result is a vertex.
    """
    n, k = x.shape
    scale = np.sqrt((w[:, None] * x * x).sum(0) / w.sum())
    scale[scale == 0] = 1.0
    x, linear = x / scale, linear / scale

    def value(b: np.ndarray) -> float:
        u = y - x @ b
        return float((w * np.where(u >= 0, tau * u, (tau - 1) * u)).sum() - linear @ b)

    root = np.sqrt(w)
    beta = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
    size = float(np.abs(y - x @ beta).mean())
    mu, end, best = 0.1 * size, 1e-13 * max(size, 1e-14 * np.abs(y).max(initial=0.0)), beta
    while mu > end and mu > 1e-290:
        mu *= 0.2
        for _ in range(50):
            u = y - x @ beta
            b = 2 * mu / (np.abs(u) + 2 * mu + np.sqrt(u * u + 4 * mu * mu))
            first = w * (np.where(u >= 0, 1 - b, b) - 1 + tau)
            second = w * b * b * (1 - b) ** 2 / (mu * (b * b + (1 - b) ** 2))
            g = x.T @ first + linear
            step = np.linalg.pinv((x * second[:, None]).T @ x, rcond=1e-14, hermitian=True) @ g
            decrement = float(g @ step)
            if decrement <= 0.1 * mu:
                break
            # a damped step, which the barrier's curvature makes safe
            beta = beta + step / (1 + np.sqrt(decrement / mu)) if decrement > 0.1 * mu else beta + step
    best = min((best, beta), key=value)
    rows: list[int] = []
    for i in np.argsort(np.abs(y - x @ best)):
        if np.linalg.matrix_rank(x[[*rows, i]]) > len(rows):
            rows.append(int(i))
        if len(rows) == k:
            break
    if len(rows) == k:
        vertex = np.linalg.solve(x[rows], y[rows])
        if value(vertex) <= value(best) + 1e-9 * abs(value(best)):
            best = vertex
    return best / scale


def _solver(k: int):
    @F.pandas_udf("array<double>")
    def solve(near: pd.Series, tau: pd.Series, far: pd.Series) -> pd.Series:
        out = []
        for rows, t, f in zip(near, tau, far, strict=True):
            r = np.stack(rows)
            out.append(minimum(r[:, 1], r[:, 2:], r[:, 0], t, np.asarray(f, float)).tolist())
        return pd.Series(out)

    return solve


def quantile_fit(rows: DataFrame, by: list[str], y: str, xs: list[str], tau: str, weight: str | None = None, constant: bool = True, most: int = 1000, passes: int = 100) -> DataFrame:
    """by, beta (the constant first), objective, n: the tau-th quantile regression of each group of ``rows``.

    ``tau`` is a column that is the same in all rows of a group. Rows with a null in y, a regressor or the weight go, as do those of weight
    0; weights aren't negative, and n is their sum. Of collinear regressors, or where several fits reach the minimum, one comes. A group of more than
    ``most`` rows is smoothed first, and at most that many of its rows are gathered. An empty table gives an empty result; a group that needs more
    than ``passes`` aggregations, or ten bands, is an error (as with more than ``most`` rows on one fit).
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cols = [*([F.lit(1.0)] if constant else []), *[F.col(x).cast("double") for x in xs]]
    k, key = len(cols), F.struct(*by).alias("key")
    x = [F.col(f"x{i}") for i in range(k)]
    d = rows.dropna(subset=[y, *xs, *([weight] if weight else [])]).select(key, w.alias("w"), F.col(tau).cast("double").alias("tau"), F.col(y).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(cols)])
    d = checkpointed(d.where("w > 0"))
    sizes = checkpointed(d.groupBy("key").agg(F.count("*").alias("n")))
    zero, one = F.array(*[F.lit(0.0)] * k), F.array("w", "y", *x)
    solve = _solver(k)
    small = d.join(sizes.where(F.col("n") <= most), "key").groupBy("key").agg(F.collect_list(one).alias("near"), F.first("tau").alias("tau")).select("key", solve("near", "tau", zero).alias("beta"))
    solved = checkpointed(small)
    large = d.join(sizes.where(F.col("n") > most), "key")
    if not sizes.where(F.col("n") > most).isEmpty():
        solved = solved.union(_large(large, sizes, k, most, passes, solve))
    result = _residuals(d.join(solved, "key"), k, "beta").groupBy("key").agg(F.first("beta").alias("beta"), F.sum(F.col("w") * _loss(F.col("u"))).alias("objective"), F.sum("w").alias("n"))
    return result.select("key.*", "beta", "objective", "n")


def _large(d: DataFrame, sizes: DataFrame, k: int, most: int, passes: int, solve) -> DataFrame:
    """key and exact beta of groups of more than ``most`` rows."""
    x = [F.col(f"x{i}") for i in range(k)]
    start = _least_squares(d, k)
    state = F.struct(F.col("base"), F.array(*[F.lit(0.0)] * k).alias("step"), F.lit(float("inf")).alias("value"), F.lit(0.0).alias("slope"), (F.col("sd") / 2).alias("width"), (F.col("sd") * F.greatest(F.lit(0.002), 0.3 * F.pow(k / F.col("n"), 0.4))).alias("least"), F.lit(0).alias("tries"), F.lit(False).alias("done"))
    states, step, ended = checkpointed(start.select("key", state.cast(STATE).alias("state"))), _stepper(k), None
    for _ in range(passes):
        states = checkpointed(_smooth_pass(d, k, states).select("key", step("state", "value", "g", "h").alias("state")))
        done = states.where("state.done")
        ended = done if ended is None else ended.union(done)
        if states.where("not state.done").isEmpty():
            break
    else:
        raise RuntimeError(f"quantile regressions weren't smooth after {passes} passes")
    centres = ended.select("key", F.col("state.base").alias("centre"), F.col("state.width").alias("width"))
    found = None
    for _ in range(10):
        centred = checkpointed(_residuals(d.join(centres, "key"), k, "centre").withColumn("size", F.abs("u")))
        counts = centred.groupBy("key").agg(*[F.count_if(F.col("size") <= F.col("width") * (NARROWEST * 2.0**i)).alias(f"c{i}") for i in range(BANDS)])
        bands = counts.select("key", F.coalesce(*[F.when(F.col(f"c{i}") <= most, F.lit(NARROWEST * 2.0**i)) for i in reversed(range(BANDS))], F.lit(0.0)).alias("band"))
        centred = centred.join(bands, "key").withColumn("inside", F.col("size") <= F.col("width") * F.col("band"))
        side = F.when(F.col("u") >= 0, F.col("tau")).otherwise(F.col("tau") - 1) * F.col("w")
        far = F.array(*[F.coalesce(F.sum(F.when(~F.col("inside"), v * side)), F.lit(0.0)) for v in x])
        small = centred.groupBy("key").agg(F.collect_list(F.when(F.col("inside"), F.array("w", "y", *x))).alias("near"), F.first("tau").alias("tau"), far.alias("far"))
        if not small.where(F.size("near") < k).isEmpty():
            raise RuntimeError("too many rows lie on one fit; allow more of them to be gathered")
        fits = checkpointed(small.select("key", solve("near", "tau", "far").alias("beta")))
        after = F.col("y") - dot(x, F.col("beta"))
        turned = F.count_if(~F.col("inside") & ((F.col("u") >= 0) != (after >= 0)))
        better = F.sum(F.col("w") * _loss(after)) < F.sum(F.col("w") * _loss(F.col("u")))
        checked = checkpointed(centred.join(fits, "key").groupBy("key").agg(turned.alias("turned"), better.alias("better"), F.first("beta").alias("beta"), F.first("centre").alias("centre"), F.first("width").alias("width")))
        right = checked.where("turned = 0").select("key", "beta")
        found = right if found is None else found.union(right)
        wrong = checked.where("turned > 0")
        if wrong.isEmpty():
            return found
        # half way where the fit of the band isn't better for all rows
        middle = F.zip_with("centre", "beta", lambda a, b: (a + b) / 2)
        centres = wrong.select("key", F.when(F.col("better"), F.col("beta")).otherwise(middle).alias("centre"), "width")
        d = d.join(centres.select("key"), "key", "left_semi")
    raise RuntimeError("a quantile regression didn't end in ten bands")


def _least_squares(d: DataFrame, k: int) -> DataFrame:
    """key, n, base and sd: coefficients and residual deviation to start from."""
    z = [*[F.col(f"x{i}") for i in range(k)], F.col("y")]
    sums = d.groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), *[F.sum(F.col("w") * z[i] * z[j]).alias(f"m{i}_{j}") for i, j in _upper(k + 1)])

    @F.pandas_udf("struct<base:array<double>,sd:double>")
    def fit(m: pd.Series, weight: pd.Series) -> pd.DataFrame:
        out = []
        for v, n in zip(m, weight, strict=True):
            a = square(v, k + 1)
            s = np.sqrt(np.maximum(np.diag(a)[:k], 1e-300))
            b = np.linalg.pinv(a[:k, :k] / np.outer(s, s), rcond=1e-13, hermitian=True) @ (a[:k, k] / s) / s
            out.append((b.tolist(), float(np.sqrt(max(a[k, k] - b @ a[:k, k], 1e-24 * a[k, k], 1e-280) / n))))
        return pd.DataFrame(out, columns=["base", "sd"])

    return sums.select("key", "n", fit(F.array(*[f"m{i}_{j}" for i, j in _upper(k + 1)]), "weight").alias("f")).select("key", "n", "f.*")


def quantile_lp(df: DataFrame, by: list[str], order: str, y: str, x: str, hs: list[int], taus: list[float], n_lags: int = 2, controls: list[str] = (), replicates: int = 0, alpha: float = 0.10, seed: int = 0, most: int = 1000) -> DataFrame:
    """by, h, tau, beta, objective, n of local projections of y_{t+h} - y_{t-1} on x and lags at quantiles; lo and hi with ``replicates``.

    Replicates draw rows by Poisson weights of mean 1, from a hash of seed, replicate and row, as many as rows on average;
    lo and hi are percentiles of theirs.
    """
    design, xs = lp_design(df, by, order, y, x, hs, n_lags, list(controls))
    rows = design.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    keys = [*by, "h", "tau"]
    point = quantile_fit(rows, keys, "dy", xs, "tau", most=most).select(*keys, F.col("beta")[1].alias("beta"), "objective", F.col("n").cast("long").alias("n"))
    if not replicates:
        return point
    below = np.cumsum([exp(-1) / factorial(n) for n in range(12)]).tolist()
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("replicate"), *by, "h", order), F.lit(1 << 40)) / float(1 << 40)
    drawn = drawn.withColumn("weight", sum((F.when(draw >= p, 1).otherwise(0) for p in below), F.lit(0)))
    fits = quantile_fit(drawn, [*keys, "replicate"], "dy", xs, "tau", "weight", most=most)
    band = fits.groupBy(*keys).agg(F.percentile(F.col("beta")[1], F.lit(alpha / 2)).alias("lo"), F.percentile(F.col("beta")[1], F.lit(1 - alpha / 2)).alias("hi"))
    return point.join(band, keys)
