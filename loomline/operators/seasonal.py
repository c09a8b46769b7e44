"""X-11: trend, seasonal and irregular by iterated moving averages over windows.

Every filter is a weighted sum over a window of a series in order, or of a series' values of one calendar position; at the ends,
where a window isn't whole, other weights take the place of the symmetric ones. Weights that the ends need come from
their formulas, not from extrapolated values. Series are independent, and a series is read in order, never gathered.
"""

from __future__ import annotations

from math import pi

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

#: Noise-to-trend ratios that the end weights of trend filters suppose, by length.
RATIO = {5: 0.001, 7: 4.5, 9: 1.0, 13: 3.5, 23: 4.5}
#: Seasonal filters' symmetric weights, and those with fewer later values (none, one, ...), over their sum.
SEASONAL = {
    "3x3": ([1, 2, 3, 2, 1], [[5, 11, 11], [3, 7, 10, 7]]),
    "3x5": ([1, 2, 3, 3, 3, 2, 1], [[9, 17, 17, 17], [4, 11, 15, 15, 15], [4, 8, 13, 13, 13, 9]]),
}
#: Deviations of an irregular value from which it counts less, and not at all, in standard deviations.
LOW, HIGH = 1.5, 2.5


def henderson(n: int) -> np.ndarray:
    """Symmetric weights of an odd length that keep cubics and are smoothest in their third differences."""
    p, j = (n + 3) / 2, np.arange(n) - (n - 1) / 2
    w = ((p - 1) ** 2 - j**2) * (p**2 - j**2) * ((p + 1) ** 2 - j**2) * (3 * p**2 - 16 - 11 * j**2)
    return w / w.sum()


def end_weights(w: np.ndarray, later: int, ratio: float) -> np.ndarray:
    """Weights of the first values of a window that has only ``later`` ones after its middle: those that revise least.

    The missing values' weights go to the others evenly and along a line, whose part depends on the ratio of noise to trend.
    """
    m = len(w)
    n = m // 2 + later + 1
    i = np.arange(1, m + 1) - (n + 1) / 2
    d = 4 / (pi * ratio**2)
    lost = w[n:].sum()
    tilt = d / (1 + n * (n - 1) * (n + 1) / 12 * d) * (i[n:] * w[n:]).sum()
    return w[:n] + lost / n + i[:n] * tilt


def _weighted(c: Column, w: Window, weights: list[float], before: int) -> Column:
    """The sum of weights times values from ``before`` rows earlier on."""
    at = lambda k: F.lag(c, before - k).over(w)
    return sum((at(k) * float(v) for k, v in enumerate(weights)), F.lit(0.0))


def trend_filter(c: Column, w: Window, n: int, place: Column, size: Column) -> Column:
    """Henderson's filter of length ``n``; near the ends with their weights. Null where the series is shorter."""
    sym, half = henderson(n), n // 2
    out = F.when((place > half) & (size - place >= half), _weighted(c, w, list(sym), half))
    for later in range(half):
        ends = end_weights(sym, later, RATIO[n])
        out = out.when((size - place == later) & (place > half), _weighted(c, w, list(ends), half))
        out = out.when((place == later + 1) & (size - place >= half), _weighted(c, w, list(ends[::-1]), later))
    return out


def seasonal_filter(c: Column, w: Window, name: str, place: Column, size: Column) -> Column:
    """A seasonal average over the values of one calendar position; their mean where they are fewer than the filter has."""
    sym, ends = SEASONAL[name]
    half, most = len(sym) // 2, Window.unboundedPreceding
    out = F.when(size < len(sym), F.avg(c).over(w.rowsBetween(most, Window.unboundedFollowing)))
    out = out.when((place > half) & (size - place >= half), _weighted(c, w, [x / sum(sym) for x in sym], half))
    for later, row in enumerate(ends):
        share = [x / sum(row) for x in row]
        out = out.when(size - place == later, _weighted(c, w, share, len(row) - 1 - later))
        out = out.when(place == later + 1, _weighted(c, w, share[::-1], later))
    return out


class _Series:
    """The windows and the arithmetic of one run."""

    def __init__(self, by: list[str], period: int, multiplicative: bool):
        self.by, self.period, self.multiplicative = by, period, multiplicative
        self.order = Window.partitionBy(*by).orderBy("place")
        self.same = Window.partitionBy(*by, "position").orderBy("place")
        self.neutral = 1.0 if multiplicative else 0.0

    def take(self, a: Column, b: Column) -> Column:
        return F.try_divide(a, b) if self.multiplicative else a - b

    def year_average(self, d: DataFrame, c: str, out: str) -> DataFrame:
        """The average of a year around each value, half of the outer ones; null in the half years at the ends."""
        p = self.period
        return d.withColumn(out, _weighted(F.col(c), self.order, [0.5 / p, *[1 / p] * (p - 1), 0.5 / p], p // 2))

    def normalised(self, d: DataFrame, c: str) -> DataFrame:
        """Factors taken from their average over a year; the ends use the nearest one there is."""
        d = self.year_average(d, c, "year_")
        earlier, later = self.order.rowsBetween(Window.unboundedPreceding, 0), self.order.rowsBetween(0, Window.unboundedFollowing)
        level = F.coalesce("year_", F.last("year_", ignorenulls=True).over(earlier), F.first("year_", ignorenulls=True).over(later))
        return d.withColumn("level_", level).withColumn(c, self.take(F.col(c), F.col("level_"))).drop("year_", "level_")

    def seasonal(self, d: DataFrame, ratio: str, name: str, out: str) -> DataFrame:
        """Normalised seasonal factors of the ratios of series to trend, which may be missing at the ends."""
        # ratios are missing at the ends alone, so a position's values follow each other
        whole = self.same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        d = d.withColumn("seat_", F.count(ratio).over(self.same.rowsBetween(Window.unboundedPreceding, 0))).withColumn("seats_", F.count(ratio).over(whole))
        factor = seasonal_filter(F.col(ratio), self.same, name, F.col("seat_"), F.col("seats_"))
        d = d.withColumn(out, F.when(F.col(ratio).isNotNull(), factor)).drop("seat_", "seats_")
        # factors of a position go on to where there was no ratio
        up, down = self.same.rowsBetween(Window.unboundedPreceding, 0), self.same.rowsBetween(0, Window.unboundedFollowing)
        d = d.withColumn(out, F.coalesce(out, F.last(out, ignorenulls=True).over(up), F.first(out, ignorenulls=True).over(down)))
        return self.normalised(d, out)

    def weights(self, d: DataFrame, irregular: str, out: str) -> DataFrame:
        """1 for usual irregular values, 0 for those beyond HIGH deviations, and in between a part.

        A year's deviation is that of the five years around it (at the ends, of the five nearest), once from all values and
        once without those beyond HIGH.
        """
        d = d.withColumn("off_", F.col(irregular) - self.neutral)
        year, all_ = Window.partitionBy(*self.by).orderBy("year"), Window.partitionBy(*self.by)
        last = F.col("years_") - 1
        for k in (1, 2):
            used = F.col("off_") if k == 1 else F.when(F.abs("off_") <= HIGH * F.col("dev_"), F.col("off_"))
            d = d.withColumn("square_", used * used)
            around = lambda a, b: F.avg("square_").over(year.rangeBetween(a, b))
            square = F.when(last <= 3, F.avg("square_").over(all_)).when(F.col("year") == 0, around(0, 4)).when(F.col("year") == 1, around(-1, 3))
            square = square.when(F.col("year") == last, around(-4, 0)).when(F.col("year") == last - 1, around(-3, 1)).otherwise(around(-2, 2))
            d = d.withColumn("dev_", F.sqrt(square))
        z = F.abs("off_") / F.when(F.col("dev_") > 0, F.col("dev_"))
        return d.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (HIGH - F.coalesce(z, F.lit(0.0))) / (HIGH - LOW)))).drop("off_", "dev_", "square_")

    def replaced(self, d: DataFrame, ratio: str, weight: str) -> DataFrame:
        """Ratios of low weight become the average of themselves, so weighted, and the two nearest usual ones of their position on either side."""
        usual = F.when(F.col(weight) >= 1, F.col(ratio))
        near = lambda a, b, k: F.slice(F.collect_list(usual).over(self.same.rowsBetween(a, b)), F.lit(k), F.lit(2))
        before = F.collect_list(usual).over(self.same.rowsBetween(Window.unboundedPreceding, -1))
        donors = F.concat(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2)), near(1, Window.unboundedFollowing, 1))
        total = F.aggregate("donors_", F.lit(0.0), lambda a, x: a + x)
        mean = F.try_divide(F.col(ratio) * F.col(weight) + total, F.col(weight) + F.size("donors_"))
        return d.withColumn("donors_", donors).withColumn(ratio, F.when(F.col(weight) < 1, F.coalesce(mean, F.col(ratio))).otherwise(F.col(ratio))).drop("donors_")


def x11(df: DataFrame, by: list[str], order: str, value: str, period: int = 12, multiplicative: bool = True, henderson_terms: int | None = None, least: int = 24) -> DataFrame:
    """by, order, value, trend, seasonal, irregular, adjusted of each series, by two rounds of X-11.

    A round takes a year's average as the trend, seasonal factors by 3x3 averages of each calendar position, a Henderson trend of the adjusted series (13
    terms for months, 5 for quarters, unless given), and seasonal factors by 3x5 averages. In each step ratios whose irregular part is
    extreme are replaced. The second round's trends are of the series without the first one's extremes. ``value`` is product (or sum) of the parts,
    and ``adjusted`` is without the seasonal one.

    The first round's rows are kept in the checkpoint folder. A series' rows are its periods without a gap, in order; a null value, or with ``multiplicative`` one that isn't positive, makes the series give null parts, as do
    fewer than ``least`` values or two years. Constant series have no seasonal part. Keys aren't null; an empty table gives an empty result.
    """
    if period not in (4, 12):
        raise ValueError("a period has 4 or 12 parts")
    terms = henderson_terms or (13 if period == 12 else 5)
    if terms not in RATIO:
        raise ValueError(f"a trend filter has {', '.join(map(str, RATIO))} terms")
    everything = Window.partitionBy(*by)
    v = F.col("value_")
    bad = v.isNull() | F.isnan(v) | (v <= 0 if multiplicative else F.lit(False))
    d = df.select(*by, order, F.col(value).cast("double").alias("value_")).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).withColumn("size", F.count("*").over(everything))
    d = d.withColumn("bad_", F.count_if(bad).over(everything))
    d = d.withColumn("y", F.when((F.col("bad_") == 0) & (F.col("size") >= max(least, 2 * period + 1, terms)), F.col("value_")))
    d = d.withColumn("position", (F.col("place") - 1) % period).withColumn("year", F.floor((F.col("place") - 1) / period).cast("int")).withColumn("years_", F.max("year").over(everything) + 1).drop("bad_")
    s = _Series(by, period, multiplicative)
    d = d.withColumn("base", F.col("y"))
    for turn in (1, 2):
        d = s.year_average(d, "base", "t1").withColumn("r1", s.take(F.col("base"), F.col("t1")))
        d = s.seasonal(d, "r1", "3x3", "s1").withColumn("i1", s.take(F.col("r1"), F.col("s1")))
        d = s.replaced(s.weights(d, "i1", "w1"), "r1", "w1")
        d = s.seasonal(d, "r1", "3x3", "s2").withColumn("a1", s.take(F.col("base"), F.col("s2")))
        d = d.withColumn("t2", trend_filter(F.col("a1"), s.order, terms, F.col("place"), F.col("size")))
        d = d.withColumn("r2", s.take(F.col("y"), F.col("t2")))
        d = s.seasonal(d, "r2", "3x5", "s3").withColumn("i2", s.take(F.col("r2"), F.col("s3")))
        d = s.replaced(s.weights(d, "i2", "w2"), "r2", "w2")
        d = s.seasonal(d, "r2", "3x5", "seasonal").withColumn("adjusted", s.take(F.col("y"), F.col("seasonal")))
        if turn == 1:
            d = d.withColumn("i3", s.take(F.col("adjusted"), F.col("t2")))
            d = s.weights(d, "i3", "w3")
            usual = s.neutral + F.col("w3") * (F.col("i3") - s.neutral)
            extreme = F.try_divide(F.col("i3"), usual) if multiplicative else F.col("i3") - usual
            d = d.withColumn("base", s.take(F.col("y"), F.coalesce(extreme, F.lit(s.neutral))))
        d = checkpointed(d.select(*by, order, "value_", "place", "size", "position", "year", "years_", "y", "base", "seasonal", "adjusted"))
    d = d.withColumn("trend", trend_filter(F.col("adjusted"), s.order, terms, F.col("place"), F.col("size")))
    return d.select(*by, order, F.col("value_").alias(value), "trend", "seasonal", s.take(F.col("adjusted"), F.col("trend")).alias("irregular"), "adjusted")
