"""Where callers bring their own: catalogs of series, estimators over specifications, refits and forecasts by group."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Loaders of instruments or shocks by name: a loader takes a session and returns (date, value)."""

    def __init__(self):
        self._loaders: dict[str, tuple[Callable[[SparkSession], DataFrame], dict]] = {}

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame], replace: bool = False, **about) -> None:
        if name in self._loaders and not replace:
            raise KeyError(f"{name} is registered")
        self._loaders[name] = loader, about

    def names(self, **about) -> list[str]:
        return sorted(n for n, (_, a) in self._loaders.items() if all(a.get(k) == v for k, v in about.items()))

    def load(self, spark: SparkSession, *names: str) -> DataFrame:
        """date, name, value of the named series, one under another."""
        parts = [self._loaders[n][0](spark).select("date", F.lit(n).alias("name"), F.col("value").cast("double").alias("value")) for n in names]
        return reduce(DataFrame.unionByName, parts)


def specification_curve(data: DataFrame, specs: Iterable[dict], estimator: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """beta and se of each specification (a dict of choices), in order of beta; the estimator returns one row with both.

    All specifications are one query, so Spark runs them together and reads ``data`` no more often than it must.
    """
    parts = []
    for k, spec in enumerate(specs):
        own = estimator(data, spec).select("beta", "se")
        parts.append(own.select(F.lit(k).alias("spec"), F.lit("; ".join(f"{a}={b}" for a, b in spec.items())).alias("choices"), "beta", "se"))
    return reduce(DataFrame.unionByName, parts).orderBy("beta", "spec")


def refit(residuals: DataFrame, order: str, value: str, fit: Callable[[np.ndarray], float], draws: int = 200, kind: str = "wild", block: int | None = None, seed: int = 0) -> DataFrame:
    """draw, value: ``fit`` of a series' residuals with random signs (wild), or drawn again in blocks of about T^(1/3).

    Draws are spread over tasks, each of which gets the series once.
    """
    v = np.array([r[0] for r in residuals.where(F.col(value).isNotNull()).orderBy(order).select(F.col(value).cast("double")).collect()])  # one series
    size = block or max(1, round(len(v) ** (1 / 3)))

    def run(batches):
        for batch in batches:
            out = []
            for k in batch["id"]:
                r = np.random.default_rng([seed, int(k)])
                e = v * r.choice([-1.0, 1.0], len(v)) if kind == "wild" else np.concatenate([v[s : s + size] for s in r.integers(0, len(v) - size + 1, -(-len(v) // size))])[: len(v)]
                out.append((int(k), float(fit(e))))
            yield pd.DataFrame(out, columns=["draw", "value"])

    return residuals.sparkSession.range(draws).mapInPandas(run, "draw long, value double")


def forecast_revisions(vintages: DataFrame, forecast: Callable[[pd.Series], float]) -> DataFrame:
    """series_id, vintage_date, forecast, revision: a caller's forecast of each vintage's series, and its change from the
    vintage before. A vintage is a group; the forecast gets its values in order of date."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("observation_date").set_index("observation_date")["value"]
        return pd.DataFrame([(pdf["series_id"].iloc[0], pdf["vintage_date"].iloc[0], float(forecast(s)))], columns=["series_id", "vintage_date", "forecast"])

    from pyspark.sql import Window

    kinds = dict(vintages.dtypes)
    d = vintages.groupBy("series_id", "vintage_date").applyInPandas(run, f"series_id string, vintage_date {kinds['vintage_date']}, forecast double")
    return d.withColumn("revision", F.col("forecast") - F.lag("forecast").over(Window.partitionBy("series_id").orderBy("vintage_date")))
