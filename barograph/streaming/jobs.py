"""Streaming twins of the daily increments.

Unless stated otherwise a job is one function for both worlds: it takes a streaming or a
batch DataFrame of (event_id, ts, key, value) and returns the same relation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barograph.operators.calendar import trading_calendar

LATENESS = "2 days"


def _by_window(ticks: DataFrame, window: Column, *aggregates: Column) -> DataFrame:
    marked = ticks.withWatermark("ts", LATENESS) if ticks.isStreaming else ticks
    return marked.groupBy(window.alias("w"), "key").agg(*aggregates).withColumn(
        "start", F.col("w.start")).drop("w")


def bars(ticks: DataFrame) -> DataFrame:
    """Open, high, low, close and volume per key and day."""
    order = F.struct("ts", "event_id")
    return _by_window(
        ticks, F.window("ts", "1 day"), F.min_by("value", order).alias("open"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("n"))


def activity(ticks: DataFrame, length: str = "5 days", slide: str = "1 day") -> DataFrame:
    """Sliding count and traded value per key."""
    return _by_window(ticks, F.window("ts", length, slide), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def deduplicated(ticks: DataFrame, key: str = "event_id") -> DataFrame:
    """First delivery of each event; re-deliveries inside the lateness bound are ignored.

    A batch has no order of arrival: there the earliest ``ts`` is the first, then the
    smallest row.
    """
    if ticks.isStreaming:
        return ticks.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([key])
    rest = [c for c in ticks.columns if c != key]
    first = F.min(F.struct("ts", *[c for c in rest if c != "ts"])).alias("r")
    return ticks.groupBy(key).agg(first).select(*[F.col(c) if c == key else F.col(f"r.{c}") for c in ticks.columns])


def sessions(ticks: DataFrame, gap: str) -> DataFrame:
    """Activity sessions of a stream, closed by ``gap`` without events."""
    marked = ticks.withWatermark("ts", LATENESS)
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def sessions_batch(ticks: DataFrame, gap_seconds: int) -> DataFrame:
    """Batch twin of ``sessions``.

    Events of one half-gap bucket always share a session, so they are pre-aggregated; a
    key's sort then holds one row per bucket, however many events the key has.
    """
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (gap_seconds * 500_000))
    packed = ticks.groupBy("key", bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    w = Window.partitionBy("key").orderBy("b")
    silence = F.unix_micros(F.col("first_ts").cast("timestamp")) - F.unix_micros(F.lag("last_ts").over(w).cast("timestamp"))
    fresh = F.when(silence.isNull() | (silence > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = packed.withColumn("fresh", fresh).withColumn("s", F.sum("fresh").over(w))
    return numbered.groupBy("key", "s").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")).drop("s")


def enriched(ticks: DataFrame, static: DataFrame) -> DataFrame:
    """Stream-static left join on the key; Spark picks the strategy from the static size."""
    return ticks.join(static, "key", "left")


def alerts(latest: DataFrame, conditions: DataFrame) -> DataFrame:
    """Conditions (key, kind, level) met by the latest price of their key."""
    met = F.when(F.col("kind") == "price_above", F.col("price") >= F.col("level")).otherwise(F.col("price") <= F.col("level"))
    return conditions.join(latest, "key").where(met)


# --- consecutive misses ------------------------------------------------------------------

MISS_OUTPUT = "key string, day date, consecutive_misses int, first_miss_date date, last_miss_date date"
MISS_STATE = "misses int, first date, last date"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Reset on a day with data, count a silent open day; one row per delivered day."""
    misses, first, last = state.get if state.exists else (0, None, None)
    for pdf in batches:
        out = []
        for day, returned in pdf.sort_values("day")[["day", "returned"]].itertuples(index=False):
            if returned:
                misses, first, last = 0, None, None
            else:
                misses, first, last = misses + 1, first or day, day
            out.append((key[0], day, misses, first, last))
        yield pd.DataFrame(out, columns=["key", "day", "consecutive_misses", "first_miss_date", "last_miss_date"])
    state.update((misses, first, last))


def miss_counter(daily: DataFrame) -> DataFrame:
    """Streaming state per key over (key, day, returned) rows of open days."""
    return daily.groupBy("key").applyInPandasWithState(
        _advance, MISS_OUTPUT, MISS_STATE, "append", GroupStateTimeout.NoTimeout)


def miss_state(ticks: DataFrame, threshold: int = 10, recent_days: int = 7) -> DataFrame:
    """Batch twin: state after the last open day. A day is open when any key has data, so
    the misses of a key are the open days after its last active one."""
    active = ticks.select("key", F.col("ts").cast("date").alias("date")).distinct()
    calendar = trading_calendar(active)
    final_t, final_day = calendar.agg(F.max("t")).scalar(), calendar.agg(F.max("date")).scalar()
    last = active.join(F.broadcast(calendar), "date").groupBy("key").agg(F.max("t").alias("t"), F.max("date").alias("last_active"))
    following = calendar.select((F.col("t") - 1).alias("t"), F.col("date").alias("first_miss_date"))
    state = last.where(F.col("t") < final_t).join(F.broadcast(following), "t")
    misses = final_t - F.col("t")
    return state.select(
        "key", misses.alias("consecutive_misses"), "first_miss_date", final_day.alias("last_miss_date"),
        ((misses >= threshold) & (F.col("last_active") <= F.date_sub(final_day, recent_days))).alias("flagged"))


# --- sinks ---------------------------------------------------------------------------------

def upsert_sink(path: str, key: list[str], order: list[str] | None = None):
    """``foreachBatch`` writer that keeps the newest version of every key.

    Each micro-batch lands under its own id, replacing what an earlier attempt of the same
    batch left there, so replays are harmless; ``current`` resolves the versions. Inside a
    batch the version with the largest ``order`` columns wins, then the largest row.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        ranked = F.struct(*(order or []), *rest) if rest else F.struct(*key)
        newest = batch.groupBy(*key).agg(F.max_by(F.struct(*(rest or key)), ranked).alias("r"))
        newest.select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in batch.columns]).withColumn(
            "batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")

    return write


def current(versions: DataFrame, key: list[str]) -> DataFrame:
    """Newest version of each key of an upsert sink."""
    rest = [c for c in versions.columns if c not in (*key, "batch", "batch_id")]
    return versions.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*key, "r.*")
