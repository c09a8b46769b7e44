"""Difference-in-differences on panels (unit, time, y, treat_time); null treat_time: never treated. Time is an integer."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .regression import time_effects
from .simplex_fit import cross, paths, simplex_weights, summed


def cohort_cells(df: DataFrame) -> DataFrame:
    """g, t, m, n, k: mean, rows and values of each cohort and date."""
    return df.groupBy(F.col("treat_time").alias("g"), F.col("time").alias("t")).agg(F.avg("y").alias("m"), F.count("*").alias("n"), F.count("y").alias("k"))


def att_gt(df: DataFrame) -> DataFrame:
    """(g, t, att, n): (Y_gt - Y_g,g-1) - (C_t - C_g-1) against the never treated, for t >= g - 1."""
    return att_of(cohort_cells(df))


def att_of(cells: DataFrame) -> DataFrame:
    """``att_gt`` from ``cohort_cells``."""
    treated, never = cells.where("g is not null"), cells.where("g is null").select("t", F.col("m").alias("c"))
    base = treated.select("g", F.col("t").alias("b"), F.col("m").alias("m0")).where("b = g - 1").join(never.select(F.col("t").alias("b"), F.col("c").alias("c0")), "b").drop("b")
    d = treated.where("t >= g - 1").join(never, "t").join(base, "g")
    return d.select("g", "t", ((F.col("m") - F.col("m0")) - (F.col("c") - F.col("c0"))).alias("att"), "n")


def event_study(cells: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean effect by time since treatment; ``weighted`` by the cohort's size."""
    w = F.col("n") if weighted else F.lit(1.0)
    return cells.groupBy((F.col("t") - F.col("g")).alias("e")).agg((F.sum(F.col("att") * w) / F.sum(w)).alias("att"), F.count("*").alias("cells"))


def switchers(df: DataFrame, horizon: int = 0) -> DataFrame:
    """One row: mean over switches 0 to 1 of the change from t - 1 to t + horizon, less that of units which stay
    at 0 until then, by date, weighted by switchers."""
    w = Window.partitionBy("unit").orderBy("time")
    d = df.withColumn("d", F.when(F.col("treat_time") <= F.col("time"), 1).otherwise(0))
    d = d.select("time", (F.lead("y", horizon).over(w) - F.lag("y", 1).over(w) if horizon else F.col("y") - F.lag("y", 1).over(w)).alias("dy"), F.lag("d", 1).over(w).alias("before"), "d", (F.lead("d", horizon).over(w) if horizon else F.col("d")).alias("later"))
    d = d.where("dy is not null and before = 0")
    per = d.groupBy("time").agg(F.avg(F.when(F.col("d") == 1, F.col("dy"))).alias("s"), F.count(F.when(F.col("d") == 1, 1)).alias("n"), F.avg(F.when(F.col("later") == 0, F.col("dy"))).alias("c"))
    return per.where("s is not null and c is not null").agg((F.sum((F.col("s") - F.col("c")) * F.col("n")) / F.sum("n")).alias("did"), F.sum("n").alias("n_switchers"))


def imputation(df: DataFrame) -> DataFrame:
    """(e, att, n): treated outcomes less unit and time effects from untreated cells, by time since treatment.

    Effects are those of least squares around the untreated mean, each kind with mean 0 over untreated cells; a
    unit or time never seen untreated has effect 0.
    """
    untreated = df.where("treat_time is null or time < treat_time").select(F.lit(0).alias("g"), "unit", "time", "y")
    mu = untreated.agg(F.avg("y").alias("mu"))  # one row
    times = time_effects(untreated, ["y"], ["g"], "unit", "time").select("time", F.col("b0").alias("b"))
    units = untreated.join(times, "time").join(F.broadcast(mu)).groupBy("unit").agg(F.avg(F.col("y") - F.col("mu") - F.col("b")).alias("a"))
    treated = df.where("time >= treat_time").join(units, "unit", "left").join(times, "time", "left").join(F.broadcast(mu))
    effect = F.col("y") - F.col("mu") - F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return treated.groupBy((F.col("time") - F.col("treat_time")).alias("e")).agg(F.avg(effect).alias("att"), F.count("*").alias("n"))


def drawn(unit: Column, b: Column, seed: int = 0) -> Column:
    """How often a replicate draws a unit, a Poisson number of mean 1 from a hash of both.

    As unit counts grow this is drawing as many units as there are with replacement.
    """
    u = F.pmod(F.xxhash64(unit, b, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    steps, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 16):
        total += term
        steps = steps + F.when(u >= total, 1).otherwise(0)
        term /= k
    return steps


def bootstrap_weights(units: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """units, b, w: the units that each replicate draws, and how often."""
    return units.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", drawn(F.col("unit"), F.col("b"), seed)).where("w > 0")


def att_gt_inference(df: DataFrame, draws: int = 200, alpha: float = 0.10, seed: int = 0) -> DataFrame:
    """g, t, att, n, se, lo, hi: ``att_gt`` with the deviation and percentiles of replicates that draw units again.

    A replicate is a weight per unit, hashed row by row, so only cells by replicate, cohort and date are shuffled.
    """
    cells = bootstrap_weights(df, draws, seed).groupBy("b", F.col("treat_time").alias("g"), F.col("time").alias("t")).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    treated, never = cells.where("g is not null"), cells.where("g is null").select("b", "t", F.col("m").alias("c"))
    base = treated.select("b", "g", F.col("t").alias("s"), F.col("m").alias("m0")).where("s = g - 1").join(never.select("b", F.col("t").alias("s"), F.col("c").alias("c0")), ["b", "s"]).drop("s")
    again = treated.where("t >= g - 1").join(never, ["b", "t"]).join(base, ["b", "g"]).select("g", "t", ((F.col("m") - F.col("m0")) - (F.col("c") - F.col("c0"))).alias("v"))
    spread = again.groupBy("g", "t").agg(F.stddev_pop("v").alias("se"), F.percentile("v", [alpha / 2, 1 - alpha / 2]).alias("p")).select("g", "t", "se", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    return att_gt(df).join(spread, ["g", "t"], "left")


def placebo_switchers(df: DataFrame, before: int = 1) -> DataFrame:
    """The effect of switches on the change from t - before - 1 to t - before, which should be none, as in ``switchers``."""
    w = Window.partitionBy("unit").orderBy("time")
    d = df.withColumn("d", F.when(F.col("treat_time") <= F.col("time"), 1).otherwise(0))
    d = d.select("time", (F.lag("y", before).over(w) - F.lag("y", before + 1).over(w)).alias("dy"), F.lag("d", 1).over(w).alias("was"), "d").where("dy is not null and was = 0")
    per = d.groupBy("time").agg(F.avg(F.when(F.col("d") == 1, F.col("dy"))).alias("s"), F.count(F.when(F.col("d") == 1, 1)).alias("n"), F.avg(F.when(F.col("d") == 0, F.col("dy"))).alias("c"))
    return per.where("s is not null and c is not null").agg((F.sum((F.col("s") - F.col("c")) * F.col("n")) / F.sum("n")).alias("did"), F.sum("n").alias("n_switchers"))


def simplex(gram: np.ndarray, cross: np.ndarray, ridge: float = 0.0, rounds: int = 20_000) -> np.ndarray:
    """Weights of at least 0 that sum to 1 with the least w'(G + ridge I)w / 2 - c'w: accelerated projected steps."""
    g = gram + ridge * np.eye(len(gram))
    step = 1 / max(float(np.linalg.eigvalsh(g)[-1]), 1e-300)
    w = v = np.full(len(g), 1 / len(g))
    for k in range(rounds):
        x = v - step * (g @ v - cross)
        # the nearest point of the simplex
        s = np.sort(x)[::-1]
        held = s - (np.cumsum(s) - 1) / np.arange(1, len(s) + 1)
        rho = int(np.flatnonzero(held > 0)[-1])
        new = np.maximum(x - (s[: rho + 1].sum() - 1) / (rho + 1), 0)
        v = new + k / (k + 3) * (new - w)
        done = np.abs(new - w).max() < 1e-13
        w = new
        if done and k > 50:
            break
    return w


def synthetic_control(df: DataFrame, treated: str, start: int) -> tuple[DataFrame, DataFrame]:
    """(unit, weight), and (time, y, synthetic, gap): the mix of never-treated units closest to one unit before ``start``.

    Donors without a value at every earlier date take no part. The driver gets sums over donors of the square of the
    earlier dates' number (``simplex_fit``), whatever the number of donors.
    """
    d = df.where((F.col("unit") == treated) | F.col("treat_time").isNull()).select("unit", "time", "y")
    rows, _ = paths(d.where(F.col("time") < start), "unit", "time", "y")
    own = rows.where(F.col("unit") == treated).first()
    if own is None:
        raise ValueError(f"{treated} lacks values before {start}")
    weights = simplex_weights(rows.where(F.col("unit") != treated), np.array(own["a"])).select("unit", "weight")
    mix = d.join(weights, "unit").groupBy("time").agg(F.sum(F.col("weight") * F.col("y")).alias("synthetic"))
    own = d.where(F.col("unit") == treated).select("time", "y")
    return weights, own.join(mix, "time").withColumn("gap", F.col("y") - F.col("synthetic"))


def _synthetic(df: DataFrame, cohort: int) -> tuple[DataFrame, DataFrame, dict]:
    """Treated and donor units with their weight and change, the dates' weights, and the cohort's figures."""
    spark, post = df.sparkSession, F.col("time") >= cohort
    mine = F.col("treat_time").eqNullSafe(F.lit(cohort)).alias("mine")
    units = df.groupBy("unit", mine).agg(F.avg(F.when(post, F.col("y"))).alias("later"))
    rows, dates = paths(df.where(~post), "unit", "time", "y")
    rows = checkpointed(rows.join(units, "unit").where("later is not null"))
    size = len(dates)
    donors, own = rows.where(~F.col("mine")), rows.where("mine")
    n_tr, n_co = own.count(), donors.count()
    if not n_tr or n_co < 2 or size < 2:
        raise ValueError(f"cohort {cohort} needs treated units, two donors and two earlier dates")
    t_post = df.where(post).select("time").distinct().count()
    # all that is fitted comes from moments of earlier paths and later means
    m = cross(donors.select(F.concat("a", F.array("later")).alias("a")), size + 1) / n_co
    level = summed(own, lambda a: a.sum(axis=0), size) / n_tr
    c = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])
    diff = np.diff(np.eye(size), axis=0)
    sums, square = diff @ m[0, 1:-1], diff @ m[1:-1, 1:-1] @ diff.T
    k = n_co * (size - 1)
    noise = float((np.trace(square) * n_co - (sums.sum() * n_co) ** 2 / k) / (k - 1)) if k > 1 else 0.0
    lam = simplex(n_co * c[:size, :size], n_co * c[:size, size], 1e-12 * n_co * float(np.trace(c)))
    ridge = max(noise, 0.0) * np.sqrt(n_tr * t_post) * size
    centred = donors.withColumn("raw", F.col("a")).withColumn("a", F.transform("a", lambda x: x - F.aggregate("a", F.lit(0.0), lambda s, v: s + v) / size))
    fitted = simplex_weights(centred, level - level.mean(), float(ridge)).select("unit", "mine", "later", F.col("raw").alias("a"), "weight")
    every = fitted.unionByName(own.select("unit", "mine", "later", "a", F.lit(None).cast("double").alias("weight")))
    mix = F.array(*[F.lit(float(x)) for x in lam])
    change = F.col("later") - F.aggregate(F.zip_with("a", mix, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    times = spark.createDataFrame([(t, float(x)) for t, x in zip(dates, lam, strict=True)], f"time {dict(df.dtypes)['time']}, weight double")
    return every.select("unit", "mine", "weight", change.alias("change")), times, {"cohort": cohort, "n": n_tr}


def synthetic_did(df: DataFrame, cohort: int) -> tuple[float, DataFrame, DataFrame]:
    """(effect, unit weights, time weights) of one cohort against never-treated units.

    Unit weights fit the cohort's mean path before treatment up to a level, with a ridge of the size of first
    differences' noise; time weights fit later means of the controls. Both come from moments of at most the square of
    the dates' number. Units that lack an earlier date, or all later ones, take no part.
    """
    every, times, _ = _synthetic(df.where((F.col("treat_time") == cohort) | F.col("treat_time").isNull()), cohort)
    effect = every.agg(F.avg(F.when(F.col("mine"), F.col("change"))) - F.sum(F.col("weight") * F.col("change"))).first()[0]
    return float(effect), every.where(~F.col("mine")).select(F.col("unit").cast("string").alias("u"), "weight"), times.select(F.col("time").cast("string").alias("k"), "weight")


def synthetic_did_cohorts(df: DataFrame, later: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cohort, att, n), and one row att, se, n, cohorts: each cohort's effect, and their mean by treated units.

    Donors are never-treated units and, if ``later``, those treated after the cohort (over all dates, as they are).
    A cohort without two donors or two earlier dates is left out. se is the jackknife over units at fixed weights: a
    unit left out as a donor hands its weight to the others in proportion, and one that bears all of a cohort's weight
    makes it null, as does a single treated unit. Cohorts run one after another, as many as there are dates at most.
    """
    spark = df.sparkSession
    found = [r[0] for r in df.where("treat_time is not null").select("treat_time").distinct().orderBy("treat_time").collect()]
    parts = []
    for g in found:
        pool = F.col("treat_time").isNull() | (F.col("treat_time") == g) | ((F.col("treat_time") > g) if later else F.lit(False))
        try:
            parts.append(_synthetic(df.where(pool), g)[0].withColumn("cohort", F.lit(g)))
        except ValueError:
            continue
    if not parts:
        raise ValueError("no cohort has two donors and two earlier dates")
    rows = checkpointed(reduce(DataFrame.unionByName, parts))
    own, mix = F.when(F.col("mine"), F.col("change")), F.col("weight") * F.col("change")
    sums = rows.groupBy("cohort").agg(F.count(own).alias("n"), F.sum(own).alias("s"), F.sum(mix).alias("m"))  # a row a cohort
    cohorts = sums.select("cohort", (F.col("s") / F.col("n") - F.col("m")).alias("att"), "n")
    total = cohorts.agg((F.sum(F.col("att") * F.col("n")) / F.sum("n")).alias("att"), F.sum("n").alias("n"), F.count("*").alias("cohorts"))
    full = F.col("s") - F.col("n") * F.col("m")  # the cohort's effect times its size
    less_own = (F.col("s") - F.col("change")) - (F.col("n") - 1) * F.col("m")
    less_donor = F.col("s") - F.col("n") * (F.col("m") - mix) / F.when(F.col("weight") < 1 - 1e-9, 1 - F.col("weight"))
    without = rows.join(F.broadcast(sums), "cohort").groupBy("unit").agg(
        F.sum(F.when(F.col("mine"), less_own).otherwise(less_donor) - full).alias("moved"), F.count(F.when(F.col("mine") | (F.col("weight") < 1 - 1e-9), 1)).alias("fine"), F.count("*").alias("all"), F.max(F.col("mine").cast("int")).alias("own")
    )
    left = without.join(F.broadcast(total)).select((F.when(F.col("fine") == F.col("all"), (F.col("att") * F.col("n") + F.col("moved")) / F.nullif(F.col("n") - F.col("own"), F.lit(0))) - F.col("att")).alias("gap"))
    spread = left.agg(F.when(F.count("gap") == F.count("*"), F.sqrt((F.count("*") - 1) / F.count("*") * F.sum(F.col("gap") * F.col("gap")))).alias("se"))
    return cohorts, total.join(spread).select("att", "se", "n", "cohorts")
