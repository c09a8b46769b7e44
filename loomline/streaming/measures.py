"""Structured Streaming forms of measures whose state is small: telemetry, daily variance, vintages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def health(log: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Rows, successes and fallbacks per source and tumbling window of ``ts``; rows later than ``late`` are left out."""
    d = log.withWatermark("ts", late).groupBy(F.window("ts", window), "source")
    return d.agg(F.count("*").alias("n_total"), F.count_if(F.col("outcome") == "success").alias("n_success"), F.count_if(F.col("fallback_used") != "live").alias("n_fallback")).select(F.col("window.start").alias("start"), "source", "n_total", "n_success", "n_fallback")


def daily_variance(ticks: DataFrame, by: str, late: str = "1 hour") -> DataFrame:
    """Realised variance and number of returns per key and day."""
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), by).agg(F.sum(F.col("r") * F.col("r")).alias("rv"), F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("day"), by, "rv", "n")


KEYS = ["series_id", "observation_date", "vintage_date"]


def upsert_vintages(arrivals: DataFrame, path: str, checkpoint: str, arrival: str | None = None) -> StreamingQuery:
    """Each batch of vintage rows replaces rows of equal key; ``latest`` reads the current table.

    A batch is written as it is under ``path``/v=<batch>, one row per key: the last by the ``arrival`` column, or
    where none is named the largest value. Nothing that is there is read or written again; a batch that is run again
    writes the same. ``compact`` folds batches.
    """

    def write(batch: DataFrame, k: int) -> None:
        last = F.max_by("value", F.struct(arrival, "value") if arrival else F.col("value"))
        batch.groupBy(*KEYS).agg(last.alias("value")).write.mode("overwrite").parquet(f"{path}/v={k}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return fs, sorted(int(n[2:]) for n in names if n.startswith("v=") and done(n))


def latest(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table after the last batch (before a given one), or None: of each key the row of the latest batch."""
    _, found = _versions(spark, path)
    found = [k for k in found if before is None or k < before]
    if not found:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/v={k}" for k in found])
    return rows.groupBy(*KEYS).agg(F.max_by("value", "v").alias("value"))


def compact(spark, path: str) -> None:
    """Fold all batches into the last one's folder and drop the others; not while a batch is being written."""
    fs, found = _versions(spark, path)
    if len(found) < 2:
        return
    folder = lambda n: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")
    latest(spark, path).write.mode("overwrite").parquet(f"{path}/folded")
    fs.delete(folder(f"v={found[-1]}"), True)
    fs.rename(folder("folded"), folder(f"v={found[-1]}"))
    for k in found[:-1]:
        fs.delete(folder(f"v={k}"), True)
