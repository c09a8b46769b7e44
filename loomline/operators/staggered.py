"""Errors of staggered designs, clustered by unit: each row's part in an estimate is one number, added up by unit.

Panels are those of ``did``: (unit, time, y, treat_time), one row a unit and date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.stats import norm_ppf
from .did import att_of, cohort_cells


def _banded(d: DataFrame, estimate: str, alpha: float) -> DataFrame:
    z = norm_ppf(1 - alpha / 2)
    return d.withColumns({"lo": F.col(estimate) - z * F.col("se"), "hi": F.col(estimate) + z * F.col("se")})


def event_study_inference(df: DataFrame, weighted: bool = True, alpha: float = 0.10) -> DataFrame:
    """e, att, se, lo, hi, cells: ``did.event_study`` with its error, cohorts' shares of an event time held fixed.

    An event time is a weighted sum of means of cohorts by date; a mean's coefficient depends on cohort, date and event
    time only. Squares of units' sums are sums of products of their rows by cohort and pair of dates, so no cohort, however
    large, meets the coefficients: a task holds one unit's dates at a time. A unit has one ``treat_time``.
    """
    means = checkpointed(cohort_cells(df))  # as many rows as cohorts times dates
    cells = att_of(means)
    w = F.col("n").cast("double") if weighted else F.lit(1.0)
    cells = cells.withColumn("e", F.col("t") - F.col("g")).withColumn("share", w / F.sum(w).over(Window.partitionBy("e")))
    point = cells.groupBy("e").agg(F.sum(F.col("share") * F.col("att")).alias("att"), F.count("*").alias("cells"))
    never = F.lit(None).cast(dict(df.dtypes)["treat_time"])
    side = lambda g, t, s: F.struct(g.alias("g"), t.cast("long").alias("t"), s.alias("c"))
    g, t, share = F.col("g"), F.col("t"), F.col("share")
    four = F.explode(F.array(side(g, t, share), side(g, g - 1, -share), side(never, t, -share), side(never, g - 1, share)))
    parts = cells.select("e", four.alias("p")).groupBy("e", F.col("p.g").alias("g"), F.col("p.t").alias("t")).agg(F.sum("p.c").alias("c")).where("c <> 0")
    values = df.where("y is not null").select("unit", "treat_time", "time", "y").join(F.broadcast(means), F.col("treat_time").eqNullSafe(F.col("g")) & (F.col("time") == F.col("t")))
    own = F.struct(F.col("time").cast("long").alias("t"), ((F.col("y") - F.col("m")) / F.col("k")).alias("v"))
    paths = values.groupBy("unit", "g").agg(F.collect_list(own).alias("p"))
    pairs = paths.select("g", F.explode("p").alias("a"), "p").select("g", "a", F.explode("p").alias("b"))
    products = pairs.groupBy("g", F.col("a.t").alias("t"), F.col("b.t").alias("s")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("vv"))
    one, two = (parts.select(F.col("e").alias(f"e_{x}"), F.col("g").alias(f"g_{x}"), F.col("t").alias(f"t_{x}"), F.col("c").alias(f"c_{x}")) for x in "ab")
    met = products.join(one, F.col("g").eqNullSafe(F.col("g_a")) & (F.col("t") == F.col("t_a"))).join(two, F.col("g").eqNullSafe(F.col("g_b")) & (F.col("s") == F.col("t_b")) & (F.col("e_a") == F.col("e_b")))
    square = F.sum(F.col("c_a") * F.col("c_b") * F.col("vv"))
    se = met.groupBy(F.col("e_a").alias("e")).agg(F.sqrt(F.greatest(square, F.lit(0.0))).alias("se"))
    return _banded(point.join(se, "e", "left"), "att", alpha).select("e", "att", "se", "lo", "hi", "cells")


def switchers_by_horizon(df: DataFrame, horizons: list[int], placebo: bool = True, alpha: float = 0.10) -> DataFrame:
    """h, did, se, lo, hi, n_switchers: ``did.switchers`` at each horizon, with its error; h = -1 is the placebo.

    The placebo compares the change before the switch. Dates without both switchers and units that stay are left out,
    and a horizon without such a date has no row. The error counts that the numbers of switchers are drawn as well.
    """
    w = Window.partitionBy("unit").orderBy("time")
    d = df.withColumn("d", F.when(F.col("treat_time") <= F.col("time"), 1).otherwise(0))

    def at(c: str, h: int) -> Column:
        return F.lead(c, h).over(w) if h > 0 else F.col(c) if h == 0 else F.lag(c, -h).over(w)

    per = [F.struct(F.lit(h).alias("h"), (at("y", h) - at("y", -1)).alias("dy"), at("d", h).alias("later")) for h in horizons]
    if placebo:
        per.append(F.struct(F.lit(-1).alias("h"), (at("y", -1) - at("y", -2)).alias("dy"), F.col("d").alias("later")))
    d = d.select("unit", "time", "d", at("d", -1).alias("before"), F.array(*per).alias("p")).where("before = 0")
    d = d.select("unit", "time", "d", F.explode("p").alias("p")).select("unit", "time", "d", "p.*").where("dy is not null and (d = 1 or later = 0)")
    cells = d.groupBy("h", "time").agg(F.avg(F.when(F.col("d") == 1, F.col("dy"))).alias("s"), F.count(F.when(F.col("d") == 1, 1)).alias("n"), F.avg(F.when(F.col("d") == 0, F.col("dy"))).alias("c"), F.count(F.when(F.col("d") == 0, 1)).alias("k")).where("s is not null and c is not null")
    every = Window.partitionBy("h")  # as many rows as dates
    cells = cells.withColumns({"total": F.sum("n").over(every), "did": F.sum((F.col("s") - F.col("c")) * F.col("n")).over(every) / F.sum("n").over(every)})
    # a switcher moves the mean of changes and the weights; a unit that stays, its date's mean
    v = F.col("dy") - F.col("c")
    part = F.when(F.col("d") == 1, v - F.col("did")).otherwise(-v * F.col("n") / F.col("k")) / F.col("total")
    psi = d.join(cells, ["h", "time"]).groupBy("h", "unit").agg(F.sum(part).alias("psi"), F.first("did").alias("did"), F.first("total").alias("n_switchers"))
    out = psi.groupBy("h").agg(F.first("did").alias("did"), F.sqrt(F.sum(F.col("psi") * F.col("psi"))).alias("se"), F.first("n_switchers").alias("n_switchers"))
    return _banded(out, "did", alpha).select("h", "did", "se", "lo", "hi", "n_switchers")
