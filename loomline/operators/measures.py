"""Selections, distribution measures and small aggregations over panels and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.panel import period
from .resample import calendar


def proxy_filter(df: DataFrame, codes: list[str], proxies: list[str]) -> DataFrame:
    """Rows of the countries, and those of the proxy variables whatever their country."""
    return df.where(F.col("code").isin(codes) | F.col("variable").isin(proxies))


def slice_country(wide: DataFrame, code: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One country's rows from ``start`` to ``end``, both included."""
    d = wide.where(F.col("code") == code)
    d = d.where(F.col("date") >= F.lit(start).cast("date")) if start else d
    return d.where(F.col("date") <= F.lit(end).cast("date")) if end else d


def align(df: DataFrame, y: str, x: str) -> DataFrame:
    """Rows with both series."""
    return df.select("code", "date", y, x).dropna(subset=[y, x])


def likeliest(probabilities: list[Column]) -> Column:
    """Place of the largest probability from 0, the first of equal ones."""
    p = F.array(*probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def indicator(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= threshold).cast("int")


def high_volatility(df: DataFrame, by: list[str], sigma: str, share: float = 0.5) -> DataFrame:
    """``high``: over the median, or another quantile, of the group."""
    bar = df.groupBy(*by).agg(F.percentile(sigma, share).alias("__bar"))
    return df.join(bar, by).withColumn("high", F.col(sigma) > F.col("__bar")).drop("__bar")


def fill_pairs(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("code", "variable")) -> DataFrame:
    """``first``, and of ``second`` the rows of pairs that ``first`` doesn't have at all."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def grid(spark: SparkSession, **choices: list) -> DataFrame:
    """A row for each combination of the choices, numbered in their order: the specifications of a curve."""
    frames = [spark.createDataFrame([(i, v) for i, v in enumerate(vs)], f"__{name} int, {name} {'double' if isinstance(vs[0], float) else 'string' if isinstance(vs[0], str) else 'int'}") for name, vs in choices.items()]
    every = reduce(lambda a, b: a.crossJoin(b), frames)  # as many rows as specifications are asked for
    place = F.lit(0)
    for name, vs in choices.items():
        place = place * len(vs) + F.col(f"__{name}")
    return every.select(place.alias("spec"), *choices)


def aligned(frames: list[DataFrame], how: str = "inner", key: str = "date") -> DataFrame:
    """Series side by side on their dates; inner keeps dates that all have."""
    return reduce(lambda a, b: a.join(b, key, how), frames)


def last_wins(columns: list[Column]) -> Column:
    """The last of several columns that isn't null."""
    return F.coalesce(*reversed(columns))


def event_density(events: DataFrame, by: list[str]) -> DataFrame:
    """by, n_total, n_zero_qs, max_gap_q: events, quarters without any between the first and the last, and the longest run of those."""
    q = events.groupBy(*by, period(F.col("date"), "quarter").alias("date")).agg(F.count("*").alias("n"))
    full = calendar(q, by, "date", 3).join(q, [*by, "date"], "left").na.fill(0, ["n"])
    run = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("date"))
    runs = full.withColumn("run", run).groupBy(*by, "run").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 0).alias("zeros"))
    return runs.groupBy(*by).agg(F.sum("n").alias("n_total"), F.sum("zeros").alias("n_zero_qs"), F.max("zeros").alias("max_gap_q"))


def consensus(df: DataFrame, series: str, date: str, value: str, least: int = 2) -> DataFrame:
    """date, consensus, disagreement, n_active: mean and population deviation over series of their z-scores; a
    constant series is left out, as are dates with fewer than ``least`` series."""
    w = Window.partitionBy(series)
    z = F.when(F.stddev_pop(value).over(w) > 0, (F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w))
    g = df.select(date, z.alias("z")).groupBy(date).agg(F.avg("z").alias("consensus"), F.stddev_pop("z").alias("disagreement"), F.count("z").alias("n_active"))
    return g.where(F.col("n_active") >= least)


def residual_seasonality(df: DataFrame, by: list[str], order: str, y: str, period_: int = 4) -> DataFrame:
    """by, f_stat, df1, df2: one-way analysis of variance of the second differences by place in the year."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.where(F.col(y).isNotNull()).select(*by, order, (F.col(y) - 2 * F.lag(y, 1).over(w) + F.lag(y, 2).over(w)).alias("d")).where("d is not null")
    d = d.withColumn("k", F.pmod(F.row_number().over(w) - 1, F.lit(period_)))
    g = d.groupBy(*by, "k").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.var_pop("d").alias("v")).where("n > 1")
    every = Window.partitionBy(*by)
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every))
    g = g.groupBy(*by).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    g = g.where((F.col("n") >= 2 * period_) & (F.col("k") > 1))
    return g.select(*by, F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f_stat"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def _mass(df: DataFrame, by: list[str], x: str, weight: str) -> DataFrame:
    """Rows in order of x, one per value, with their weight and the share up to each."""
    w = Window.partitionBy(*by).orderBy("x")
    d = df.groupBy(*by, F.col(x).cast("double").alias("x")).agg(F.sum(weight).cast("double").alias("w"))
    return d.withColumn("cdf", F.sum("w").over(w) / F.sum("w").over(Window.partitionBy(*by)))


def weighted_quantiles(df: DataFrame, by: list[str], x: str, weight: str, qs: list[float]) -> DataFrame:
    """by, q, value: on the weighted distribution function, linear between its points and flat beyond them."""
    w = Window.partitionBy(*by).orderBy("x")
    d = _mass(df, by, x, weight).withColumn("x0", F.lag("x").over(w)).withColumn("c0", F.lag("cdf").over(w)).withColumn("next", F.lead("x").over(w))
    d = d.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    first = F.col("c0").isNull() & (F.col("q") <= F.col("cdf"))
    inside = F.col("c0").isNotNull() & (F.col("q") > F.col("c0")) & (F.col("q") <= F.col("cdf"))
    beyond = F.col("next").isNull() & (F.col("q") > F.col("cdf"))
    value = F.when(inside, F.col("x0") + (F.col("x") - F.col("x0")) * (F.col("q") - F.col("c0")) / (F.col("cdf") - F.col("c0"))).otherwise(F.col("x"))
    return d.where(first | inside | beyond).select(*by, "q", value.alias("value"))


def lorenz(df: DataFrame, by: list[str], x: str, weight: str) -> DataFrame:
    """by, x, pop, share: shares of weight and of value held up to each value, which may not be negative."""
    w = Window.partitionBy(*by).orderBy("x")
    total = F.sum(F.col("x") * F.col("w")).over(Window.partitionBy(*by))
    return _mass(df, by, x, weight).withColumn("share", F.when(total > 0, F.sum(F.col("x") * F.col("w")).over(w) / total).otherwise(F.col("cdf"))).select(*by, "x", F.col("cdf").alias("pop"), "share")


def gini(df: DataFrame, by: list[str], x: str, weight: str) -> DataFrame:
    """One less twice the area under the Lorenz curve, by trapezoids."""
    w = Window.partitionBy(*by).orderBy("x")
    before = lambda c: F.lag(c, 1, 0.0).over(w)
    d = lorenz(df, by, x, weight).withColumn("part", (F.col("pop") - before("pop")) * (F.col("share") + before("share")))
    return d.groupBy(*by).agg((1 - F.sum("part")).alias("gini"))


def forward_log_change(price: str, by: list[str], order: str) -> Column:
    return F.log(F.lead(price, 1).over(Window.partitionBy(*by).orderBy(order))) - F.log(price)


def cumulative(column: str, by: list[str], h: str = "h") -> Column:
    return F.sum(column).over(Window.partitionBy(*by).orderBy(h).rowsBetween(Window.unboundedPreceding, 0))


def peaks(irf: DataFrame, by: list[str], column: str, h: str = "h", signed: bool = False) -> DataFrame:
    """by, peak_h, peak: the response that is largest in size (``signed``: most negative), the first of equal ones."""
    best = F.min_by(F.struct(h, column), F.struct(F.col(column) if signed else -F.abs(column), h))
    return irf.where(F.col(column).isNotNull()).groupBy(*by).agg(best.alias("b")).select(*by, F.col(f"b.{h}").alias("peak_h"), F.col(f"b.{column}").alias("peak"))


def weighted_demeaned(column: str, weight: str, by: list[str]) -> Column:
    """A column less its weighted mean over the group."""
    w = Window.partitionBy(*by)
    return F.col(column) - F.try_divide(F.sum(F.col(weight) * F.col(column)).over(w), F.sum(F.when(F.col(column).isNotNull(), F.col(weight))).over(w))


def labels_of_spans(date: Column, spans: list[tuple[str, str, str]], default: str | None = None) -> Column:
    """The label of the last of the given spans (start, end, label; both ends included) that holds the date."""
    out = F.lit(default)
    for start, end, label in spans:
        out = F.when(date.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(label)).otherwise(out)
    return out


def month_scaled(pre: Column, post: Column, date: Column) -> Column:
    """A change in a contract on a month's average, scaled by the month's days over those left, the day itself included."""
    days = F.dayofmonth(F.last_day(date))
    return (post - pre) * days / (days - F.dayofmonth(date) + 1)


def delay_quarters(announced: Column, effective: Column) -> Column:
    """Calendar quarters from one date to the other, not under 0."""
    return F.greatest(F.lit(0), 4 * (F.year(effective) - F.year(announced)) + F.quarter(effective) - F.quarter(announced))


def power_mean(a: Column, b: Column, share: Column, sigma: float, price: bool = False) -> Column:
    """Constant-elasticity aggregate of two quantities, or the dual of two prices; at elasticity 1 the geometric mean."""
    if abs(sigma - 1) < 1e-9:
        return F.pow(a, share) * F.pow(b, 1 - share)
    r = 1 - sigma if price else 1 - 1 / sigma
    return F.pow(share * F.pow(a, F.lit(r)) + (1 - share) * F.pow(b, F.lit(r)), F.lit(1 / r))


def url_key(url: Column) -> Column:
    """SHA-256 of a URL in UTF-8, in hexadecimal."""
    return F.sha2(url.cast("binary"), 256)


def json_value(json: Column, key: str, kind: str = "string") -> Column:
    """A top-level value of a JSON object, null where it or the object isn't there."""
    return F.get_json_object(json, f"$.{key}").try_cast(kind)


def harmonised(events: DataFrame, deflators: DataFrame, stub: float = 0.05) -> DataFrame:
    """Magnitudes in per cent of GDP over the deflator of the nearest date (the earlier of two equally near); 0 becomes a
    stub; z-scores, stubs and units that aren't known stay. Events without a deflator of their country stay too.

    Each date looks at the last deflator up to it and the next one after it, on windows of a country's dates; of
    deflators of one date the least counts, a null one before numbers.
    """
    known = deflators.where("date is not null").groupBy("code", "date").agg(F.min(F.struct("deflator")).alias("found")).withColumn("wanted", F.lit(0))
    dates = events.where((F.col("unit") == "pct_gdp") & (F.col("magnitude") != 0)).select("code", "date").distinct().withColumn("found", F.lit(None).cast(known.schema["found"].dataType)).withColumn("wanted", F.lit(1))
    w = Window.partitionBy("code").orderBy("date")
    held = F.when(F.col("found").isNotNull(), F.struct("date", "found"))
    ends = known.unionByName(dates).select("code", "date", "wanted", F.last(held, True).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("b"), F.first(held, True).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("a"))
    earlier = F.col("b").isNotNull() & (F.col("a").isNull() | (F.datediff("date", F.col("b.date")) <= F.datediff(F.col("a.date"), F.col("date"))))
    near = ends.where("wanted = 1").select("code", "date", F.when(earlier, F.col("b.found.deflator")).otherwise(F.col("a.found.deflator")).alias("deflator"))
    d = events.join(near, ["code", "date"], "left").select(*events.columns, "deflator")
    zero = (F.col("unit") != "z") & (F.col("magnitude") == 0)
    size = F.when(zero, stub).when((F.col("unit") == "pct_gdp") & (F.col("deflator") > 0), F.col("magnitude") / F.col("deflator")).otherwise(F.col("magnitude"))
    return d.withColumns({"magnitude": size, "unit": F.when(zero, "stub_pct_gdp").otherwise(F.col("unit"))}).drop("deflator")


def quality(events: DataFrame, steps: list, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Events after ``steps`` ((name, function of a frame), ...) with confidence at or over ``floor``, and (step, n) after each."""
    counts, d = [events.agg(F.count("*").alias("n")).select(F.lit("raw").alias("step"), "n")], events
    for name, step in [*steps, ("confidence", lambda e: e.where(F.col("confidence") >= floor))]:
        d = step(d)
        counts.append(d.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n"))
    return d, reduce(DataFrame.unionByName, counts)


def innovations(df: DataFrame, by: list[str], order: str, y: str, least: int = 12) -> DataFrame:
    """by, order, value: residuals of a second-order autoregression, with mean 0 and deviation 1 in each group."""
    from .regression import scores
    from .windows import lags

    d = df.where(F.col(y).isNotNull()).select(*by, order, y, *lags([y], 2, by, order))
    r = scores(d, by, y, [f"{y}_L1", f"{y}_L2"], f"{y}_L1").where(F.col("n") >= least)
    w = Window.partitionBy(*by)
    return r.select(*by, order, F.try_divide(F.col("u") - F.avg("u").over(w), F.stddev_pop("u").over(w)).alias("value"))


def validate(panel: DataFrame, keys: tuple[str, ...] = ("code", "date", "variable"), aggregates: tuple[str, ...] = (), least: dict[str, int] | None = None, when: int = 20) -> DataFrame:
    """(problem, what, n): repeated keys, aggregates among countries, and variables of ``least`` that fewer countries
    have, the last where the panel has ``when`` countries or more. No row: the panel is sound."""
    repeated = panel.groupBy(*keys).count().where("count > 1").select(F.lit("repeated").alias("problem"), F.concat_ws("/", *keys).alias("what"), F.col("count").alias("n"))
    leaked = panel.where(F.upper("code").isin(list(aggregates))).groupBy("code").count().select(F.lit("aggregate").alias("problem"), F.col("code").alias("what"), F.col("count").alias("n"))
    out = repeated.unionByName(leaked)
    if least:
        wanted = panel.sparkSession.createDataFrame(list(least.items()), "variable string, least long")
        many = panel.agg(F.count_distinct("code").alias("all_codes"))  # one row
        have = panel.groupBy("variable").agg(F.count_distinct("code").alias("n"))
        short = wanted.join(have, "variable", "left").na.fill(0, ["n"]).join(F.broadcast(many)).where((F.col("n") < F.col("least")) & (F.col("all_codes") >= when))
        out = out.unionByName(short.select(F.lit("coverage").alias("problem"), F.col("variable").alias("what"), "n"))
    return out
