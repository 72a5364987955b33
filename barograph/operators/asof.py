"""As-of joins.

Two shapes. A *bounded frame* as-of (how stale a match may be is known) is a join on the
key and a coarse time bucket, so that a key with a long history is spread over many
tasks. An unbounded one merges both sides into a single sorted window per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backward_within(points: DataFrame, facts: DataFrame, by: str, at: str, date: str, value: str,
                    days: int) -> DataFrame:
    """Adds the last ``value`` with ``date`` in [at - days, at]; null when none.

    Points and facts meet on (key, bucket) with buckets one tolerance wide; a point
    looks into its own bucket and the one before, hence an equi-join without a theta
    part and without a per-key hot spot.
    """
    width = days + 1
    bucket = F.floor(F.datediff(F.col(at), F.lit("1970-01-01").cast("date")) / width)
    keyed = points.withColumn("_bucket", F.explode(F.array(bucket, bucket - 1)))
    facts = facts.select(
        F.col(by), F.col(date).alias("_date"), F.col(value).alias("_value"),
        F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / width).alias("_bucket"),
    )
    inside = (F.col("_date") <= F.col(at)) & (F.col("_date") >= F.date_sub(F.col(at), days))
    best = (
        keyed.join(facts, [by, "_bucket"])
        .where(inside)
        .groupBy(*points.columns)
        .agg(F.max_by("_value", "_date").alias(value), F.max("_date").alias(f"{value}_date"))
    )
    return best


def backward(points: DataFrame, facts: DataFrame, by: str, at: str, date: str, value: str) -> DataFrame:
    """Adds to every point the last ``value`` dated at or before it (no staleness limit)."""
    stacked = points.select("*", F.lit(None).cast(facts.schema[value].dataType).alias(value),
                            F.lit(False).alias("_fact"))
    width = {f.name: f.dataType for f in points.schema.fields}
    rows = facts.select(
        *[F.col(by) if name == by else F.col(date).alias(at) if name == at
          else F.lit(None).cast(kind).alias(name) for name, kind in width.items()],
        F.struct(F.col(value)).alias("_payload"), F.lit(True).alias("_fact"),
    )
    stacked = stacked.drop(value).withColumn(
        "_payload", F.lit(None).cast(rows.schema["_payload"].dataType))
    w = Window.partitionBy(by).orderBy(at, F.col("_fact").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        stacked.unionByName(rows)
        .withColumn("_payload", F.last("_payload", ignorenulls=True).over(w))
        .where(~F.col("_fact"))
        .select(*points.columns, F.col(f"_payload.{value}").alias(value))
    )


def report_fill(panel: DataFrame, reports: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """Each panel date takes its symbol's row of the latest *report date*.

    The latest report date per calendar day is found on the (bounded) calendar; symbols
    then join exactly, so a value missing in that report stays missing.
    """
    dates = reports.select("date").distinct().withColumn("_report", F.col("date"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    mapping = (
        calendar.select("date").withColumn("_on", F.lit(True)).join(dates, "date", "full")
        .withColumn("_report", F.last("_report", ignorenulls=True).over(w))
        .where("_on").select("date", "_report")
    )
    return (
        panel.join(F.broadcast(mapping), "date", "left")
        .join(reports.select("symbol", F.col("date").alias("_report"), value), ["symbol", "_report"], "left")
        .drop("_report")
    )
