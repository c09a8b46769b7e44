"""Realised and range measures, degree days, and flows between states."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = math.log(2)


def realised(returns: DataFrame, by: list[str], order: list[str], r: str) -> DataFrame:
    """rv, bv and jump per group: squared returns, bipower variation, and max(0, rv - bv) / rv."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = returns.withColumn("__p", F.abs(F.lag(r).over(w)) * F.abs(r))
    g = d.groupBy(*by).agg(F.sum(F.col(r) * F.col(r)).alias("rv"), (F.coalesce(F.sum("__p"), F.lit(0.0)) * (math.pi / 2)).alias("bv"))
    return g.withColumn("jump", F.when(F.col("rv") > 0, F.greatest(F.lit(0.0), F.col("rv") - F.col("bv")) / F.col("rv")).otherwise(F.lit(0.0)))


def parkinson(high: Column, low: Column) -> Column:
    return F.pow(F.log(high / low), F.lit(2)) / (4 * LN2)


def garman_klass(open_: Column, high: Column, low: Column, close: Column) -> Column:
    return F.pow(F.log(high / low), F.lit(2)) / 2 - (2 * LN2 - 1) * F.pow(F.log(close / open_), F.lit(2))


def rogers_satchell(open_: Column, high: Column, low: Column, close: Column) -> Column:
    return F.log(high / close) * F.log(high / open_) + F.log(low / close) * F.log(low / open_)


def degree_days(temp: Column, base: float = 18.0) -> tuple[Column, Column]:
    """(cooling, heating), null where the temperature is."""
    return tuple(F.when(temp.isNotNull(), F.greatest(x, F.lit(0.0))) for x in (temp - base, base - temp))


def transitions(moves: DataFrame, period: str, origin: str, destination: str) -> DataFrame:
    """period, origin, destination, n, p: shares of an origin's moves, which add up to one."""
    g = moves.groupBy(period, origin, destination).agg(F.count("*").alias("n"))
    return g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(period, origin)))


def chained(p: DataFrame, period: str, origin: str, destination: str, states: list[str], months: Column) -> DataFrame:
    """Transition shares over each group of months: the product of its months' matrices in order."""
    zero = F.transform(F.array(*[F.lit(s) for s in states]), lambda i: F.transform(F.array(*[F.lit(s) for s in states]), lambda j: F.when(i == j, 1.0).otherwise(0.0)))
    row = lambda i: F.array(*[F.coalesce(F.max(F.when((F.col(origin) == i) & (F.col(destination) == j), F.col("p"))), F.lit(1.0 if i == j else 0.0)) for j in states])
    m = p.groupBy(period).agg(F.array(*[row(i) for i in states]).alias("m")).withColumn("g", months)
    seq = m.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(period).alias("t"), "m"))), lambda x: x["m"]).alias("ms"))
    k = len(states)
    times = lambda a, b: F.array(*[F.array(*[sum((a[i][x] * b[x][j] for x in range(k)), F.lit(0.0)) for j in range(k)]) for i in range(k)])
    prod = seq.select("g", F.aggregate("ms", zero, times).alias("m"))
    return prod.select("g", F.explode(F.array(*[F.struct(F.lit(a).alias("origin"), F.lit(b).alias("destination"), F.col("m")[i][j].alias("p")) for i, a in enumerate(states) for j, b in enumerate(states)])).alias("e")).select("g", "e.*")
