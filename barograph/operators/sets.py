"""Set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_named(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def missing_from(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Requested keys that did not come back (null-safe anti-join)."""
    return requested.join(returned.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")


def source_priority(primary: DataFrame, fallback: DataFrame, keys, value: str) -> DataFrame:
    """Positive primary value, else positive fallback value; rows with neither disappear."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    a = primary.where(F.col(value) > 0).select(*keys, F.col(value).alias("_a"))
    b = fallback.where(F.col(value) > 0).select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full").select(
        *keys, F.coalesce("_a", "_b").alias(value),
        F.when(F.col("_a").isNotNull(), "primary").otherwise("fallback").alias("source"))


def first_wins(rows: DataFrame, key: str, priority, *carry: str) -> DataFrame:
    """One row per key, the one with the smallest priority (combines map-side)."""
    order = F.struct(*priority)
    return rows.groupBy(key).agg(F.min_by(F.struct(*carry), order).alias("_row")).select(
        key, *[f"_row.{c}" for c in carry])


def drop_duplicates_ordered(df: DataFrame, keys, order) -> DataFrame:
    """Keep the first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
