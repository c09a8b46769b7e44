"""Queries over the driver's tables, one per operator, with DuckDB SQL where it can say them."""

from importlib import import_module

MODULES = ("panel_queries", "measure_queries", "estimator_queries", "inference_queries", "text_index_queries", "system_queries", "dynamic_queries", "rolling_queries", "source_queries", "staggered_queries")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__name__}.{name}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
