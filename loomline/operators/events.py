"""Narrative events: code, date, kind, target, sign, magnitude, confidence, scoring, profile (array of date and weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import period
from .resample import calendar

#: Aggregation by kind; scorers by precedence.
COUNTED, INDICATED = ("macropru", "fx"), ("structural",)
PRECEDENCE = {"manual": 0, "llm": 1, "keyword": 2}
#: What budgets announce.
BUDGETED = ("transfers", "wages", "expenditure", "general")


def schedule(events: DataFrame) -> DataFrame:
    """A row per entry of each event's profile, or the event's own date with weight 1."""
    own = F.array(F.struct(F.col("date").alias("date"), F.lit(1.0).alias("weight")))
    entries = F.when(F.coalesce(F.size("profile"), F.lit(0)) > 0, F.col("profile")).otherwise(own)
    return events.withColumn("e", F.explode(entries)).withColumn("when", F.col("e.date")).withColumn("weight", F.col("e.weight")).drop("e")


def quarterly(events: DataFrame, how: str = "sum", least_confidence: float = 0.0, target: str | None = None) -> DataFrame:
    """code, kind, date, value: fiscal and monetary amounts by ``how`` (sum, mean, max by size, first), counts of sign
    for macropru and fx, the first event's sign for structural; 0 in quarters without events."""
    e = schedule(events.where(F.col("confidence") >= least_confidence))
    if target:
        e = e.where(F.col("target").isin(target, "both"))
    amount = F.col("sign") * F.col("magnitude") * F.col("weight")
    e = e.withColumn("q", period(F.col("when"), "quarter")).withColumn("v", F.when(F.col("kind").isin(*COUNTED, *INDICATED), F.col("sign").cast("double")).otherwise(amount))
    value = {"sum": F.sum("v"), "mean": F.avg("v"), "max": F.max_by("v", F.struct(F.abs("v"), F.col("when"))), "first": F.min_by("v", F.struct("when", "v"))}[how]
    first = F.min_by("v", F.struct((F.col("v") == 0).alias("z"), "when", "v"))
    rule = F.when(F.first("kind").isin(*COUNTED), F.sum("v")).when(F.first("kind").isin(*INDICATED), first).otherwise(value)
    q = e.groupBy("code", "kind", F.col("q").alias("date")).agg(rule.alias("value"))
    return calendar(q, ["code", "kind"], "date", 3).join(q, ["code", "kind", "date"], "left").na.fill(0.0, ["value"])


def relative_to_output(series: DataFrame, output: DataFrame) -> DataFrame:
    """Amounts of events over the quarter's output (code, date, output) of their country; counts and signs stay. Without an output, null."""
    d = series.join(output.select("code", "date", F.col("output").cast("double").alias("output")), ["code", "date"], "left")
    value = F.when(F.col("kind").isin(*COUNTED, *INDICATED), F.col("value")).otherwise(F.try_divide("value", "output"))
    return d.select("code", "kind", "date", value.alias("value"))


def surprise_filter(events: DataFrame, budget_months: dict[str, int], decay: float = 0.25, floor: float = 0.1) -> DataFrame:
    """Confidence of anticipated events times ``decay``; those under ``floor`` go. Anticipated: a profile of several
    entries or a later quarter, or in the code's budget month on a target that budgets have; unless marked unanticipated."""
    months = F.create_map(*[F.lit(x) for kv in budget_months.items() for x in kv])
    later = F.coalesce(F.exists("profile", lambda p: F.date_trunc("quarter", p["date"]) > F.date_trunc("quarter", F.col("date"))), F.lit(False))
    budget = F.coalesce((months[F.col("code")] == F.month("date")) & F.lower("subtarget").isin(*BUDGETED), F.lit(False))
    anticipated = ~F.coalesce("unanticipated", F.lit(False)) & ((F.coalesce(F.size("profile"), F.lit(0)) > 1) | later | budget)
    return events.withColumn("anticipated", anticipated).withColumn("confidence", F.when(anticipated, F.col("confidence") * decay).otherwise(F.col("confidence"))).where(F.col("confidence") >= floor)


def chains(events: DataFrame, days: int = 90, ratio: float = 4.0) -> DataFrame:
    """Cluster number of each event: a new one starts where the previous event of the same code, target and sign is
    more than ``days`` before, or differs in magnitude by more than ``ratio``."""
    w = Window.partitionBy("code", "target", "sign").orderBy("date", "event_id")
    before, size = F.lag("date").over(w), F.lag("magnitude").over(w)
    apart = (size > 0) & (F.col("magnitude") > 0) & (F.greatest(size, "magnitude") / F.least(size, "magnitude") > ratio)
    new = before.isNull() | (F.datediff("date", before) > days) | F.coalesce(apart, F.lit(False))
    return events.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("cluster", F.sum("__new").over(w)).drop("__new")


def representatives(clustered: DataFrame) -> DataFrame:
    """One event per cluster: by scorer, then confidence, magnitude, and date."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])[F.col("scoring")], F.lit(99))
    w = Window.partitionBy("code", "target", "sign", "cluster").orderBy(rank, F.desc("confidence"), F.desc("magnitude"), "date", "event_id")
    return clustered.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def connector_health(log: DataFrame, now) -> DataFrame:
    """Rows, successes, fallbacks and last time per source in the seven days up to ``now``."""
    d = log.where((F.col("ts") >= F.lit(now).cast("timestamp") - F.expr("interval 7 days")) & (F.col("ts") <= F.lit(now).cast("timestamp")))
    g = d.groupBy("source").agg(F.count("*").alias("n_total"), F.count_if(F.col("outcome") == "success").alias("n_success"), F.count_if(F.col("fallback_used") != "live").alias("n_fallback"), F.max("ts").alias("last_seen"))
    return g.withColumn("success_rate", F.col("n_success") / F.col("n_total")).withColumn("fallback_rate", F.col("n_fallback") / F.col("n_total"))
