"""Table maintenance as pure functions ``(existing, incoming) -> new table``.

Spark tables here are immutable snapshots: a merge returns the new content, and the
sink replaces the table (or, partitioned, only the touched partitions) atomically. Work
repeated after a lost executor therefore gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def upsert(existing: DataFrame, incoming: DataFrame, key) -> DataFrame:
    """New rows win: existing rows whose key arrives again are replaced."""
    keys = _keys(key)
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key) -> DataFrame:
    """Existing rows win."""
    keys = _keys(key)
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"))


def conditional_upsert(existing: DataFrame, incoming: DataFrame, key, keep: Column) -> DataFrame:
    """New rows win except over rows that satisfy ``keep``; unmatched rows of both stay."""
    keys = _keys(key)
    kept = existing.where(keep)
    replaceable = existing.where(~F.coalesce(keep, F.lit(False)))
    fresh = incoming.join(kept.select(*keys), keys, "left_anti")
    return kept.unionByName(upsert(replaceable, fresh, keys))


def replace_until(existing: DataFrame, incoming: DataFrame, date: str = "date") -> DataFrame:
    """Rows up to the newest incoming date are replaced; newer existing rows stay."""
    newest = incoming.agg(F.max(date)).scalar()
    return existing.where(F.col(date) > newest).unionByName(incoming)


def replace_from(existing: DataFrame, incoming: DataFrame, start, date: str = "date") -> DataFrame:
    """Rows from ``start`` on are replaced; safe to run again."""
    return existing.where(F.col(date) < F.lit(start)).unionByName(incoming.where(F.col(date) >= F.lit(start)))


def replace_keys(existing: DataFrame, incoming: DataFrame, key) -> DataFrame:
    """Whole history of each incoming key is replaced."""
    return upsert(existing, incoming, key)


def append_new_runs(existing: DataFrame, incoming: DataFrame, run_key: str) -> DataFrame:
    return insert_or_ignore(existing, incoming, run_key)


def after_high_water(existing: DataFrame, incoming: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Incoming rows later than the newest existing row of their key."""
    marks = existing.groupBy(key).agg(F.max(date).alias("_mark"))
    joined = incoming.join(marks, key, "left")
    return joined.where(F.col("_mark").isNull() | (F.col(date) > F.col("_mark"))).drop("_mark")


def refresh_current(symbols: DataFrame, bars: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Sets ``current`` to false where a symbol has no row within the last ``days`` days."""
    alive = bars.where(F.col("date") >= F.date_sub(as_of, days)).select("symbol").distinct()
    flagged = symbols.join(alive.withColumn("_alive", F.lit(True)), "symbol", "left")
    return flagged.withColumn("current", F.col("current") & F.col("_alive").isNotNull()).drop("_alive")


def resume(done: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """Planned keys that have no result yet."""
    return planned.join(done.select(key).distinct(), key, "left_anti")


def add_missing_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Additive schema evolution: absent columns appear with their default."""
    return df.withColumns({name: F.lit(value) for name, value in defaults.items() if name not in df.columns})


def month_ends(bars: DataFrame, value: str = "close") -> DataFrame:
    """Last row of each symbol and month."""
    return bars.groupBy("symbol", F.trunc("date", "MM").alias("month")).agg(
        F.max_by(value, "date").alias(value), F.max("date").alias("date"))
