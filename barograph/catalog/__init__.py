"""Registered queries with their SQL twins.

Each entry is a function of a ``Market`` plus, where SQL can say it, the equivalent
DuckDB statement over the same parquet tables.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barograph.catalog.base import REGISTRY, full_sql
from barograph.sources.market import Market

SECTIONS = (
    "sources", "filters", "joins", "aggregates", "rolling", "topk", "setops", "scalars",
    "merges", "streams", "signals", "discovery", "leadlag", "fiscal", "warrants", "ledgers", "special",
)


def _load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"barograph.catalog.{section}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Market(spark, folder))

    return {name: bind(fn) for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: full_sql(sql) for name, (_, sql) in REGISTRY.items() if sql}
