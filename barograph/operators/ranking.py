"""Global ranks without a global sort on one task.

A window without a partition key would move every row to a single task. Here the distinct
values are counted first (map-side, so a value costs one row however many rows hold it) and
range-partitioned: Spark samples them and picks the splitters, so that a dense stretch of
values is cut as finely as its rows demand. A rank is the place inside the range plus the
number of rows in the ranges before, and only one total per range passes a small window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.session import cut_lineage


def _same(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns])


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_of_{c}" for c in columns})


def value_ranks(df: DataFrame, order: list[str], by=()) -> DataFrame:
    """One row per ``by`` group and distinct ``order``: ``_n`` rows hold it, ``_before`` come before it.

    ``_total`` counts the group and ``_range`` names the range of values that one task ranks.
    Nulls come first.
    """
    by = list(by)
    counts = df.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("_n"))
    # written: splitters are sampled, so the ranges must not be drawn again by a later pass
    dealt = cut_lineage(counts.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_range", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_start"),
                          F.sum("_in").over(group).alias("_total"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_range"]
    placed = dealt.withColumn("_inner", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return placed.join(_renamed(starts, keys), _same(keys)).select(
        *by, *order, "_n", (F.col("_start") + F.col("_inner")).alias("_before"), "_total", "_range")


def with_average_rank(df: DataFrame, value: str, by, out: str) -> DataFrame:
    """Adds the tie-averaged rank of ``value`` inside each ``by`` group of any size."""
    keys = [*by, value]
    ranks = value_ranks(df, [value], by).select(*keys, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(_renamed(ranks, keys), _same(keys)).select(*df.columns, out)


def with_global_rank(df: DataFrame, value: str, tie, out: str = "rank", total: str = "total", by=()) -> DataFrame:
    """Adds the 1-based ordinal rank of ``value`` and the row count, per ``by`` group.

    ``tie`` orders equal values and tells rows apart; rows equal in it too share a rank.
    """
    keys = [*by, value, *tie]
    ranks = value_ranks(df, [value, *tie], by).select(*keys, (F.col("_before") + 1).alias(out), F.col("_total").alias(total))
    return df.join(_renamed(ranks, keys), _same(keys)).select(*df.columns, out, total)


def value_at_shares(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: the value whose ordinal rank is floor(total * share), per named share."""
    at = {name: F.floor(F.col("_total") * share) for name, share in shares.items()}
    return value_ranks(df, [value]).agg(*[
        F.max(F.when((F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_n")), F.col(value))).alias(name)
        for name, rank in at.items()])


def adjust_fdr(df: DataFrame, p: str, by=(), out: str = "fdr_p") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values inside each ``by`` group; null p counts as 1.

    adjusted = min over p' >= p of min(1, p' * n / #{<= p'}). Equal p share a value, so no
    tie order is needed. Rows with p = 1 adjust to 1 whatever the rest is: they count
    towards n and are not ranked.
    """
    by = list(by)
    # several passes follow; materialising the tests once spares recomputing them and makes
    # every pass see the very same p-values
    df = cut_lineage(df)
    rows = df.withColumn("_p", F.coalesce(F.least(F.col(p), F.lit(1.0)), F.lit(1.0)))
    tests = _renamed(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_tests")), by)
    ranked = value_ranks(rows.where("_p < 1"), ["_p"], by)
    ranked = ranked.join(tests, _same(by)) if by else ranked.join(F.broadcast(tests))  # one row
    raw = ranked.select(*by, "_p", "_range", F.least(F.lit(1.0), F.col("_p") * F.col("_tests") / (
        F.col("_before") + F.col("_n"))).alias("_raw"))
    # from the greatest value down: a frame that ends at the last row is summed anew for every row, one that begins
    # at the first row is carried on
    later = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    minima = raw.groupBy(*by, "_range").agg(F.min("_raw").alias("_m")).select(*by, "_range", F.min("_m").over(later).alias("_after"))
    rest = Window.partitionBy(*by, "_range").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    keys = [*by, "_range"]
    adjusted = raw.withColumn("_local", F.min("_raw").over(rest)).join(_renamed(minima, keys), _same(keys)).select(
        *by, "_p", F.least(F.col("_local"), F.coalesce("_after", F.lit(1.0))).alias("_adjusted"))
    keys = [*by, "_p"]
    return rows.join(_renamed(adjusted, keys), _same(keys), "left").select(
        *df.columns, F.coalesce("_adjusted", F.lit(1.0)).alias(out))


def running_total_by_day(df: DataFrame, by, day: str, within, value: str, out: str) -> DataFrame:
    """Running sum over (day, within) per ``by`` group.

    Days are summed first; only day totals pass through the per-group window, and the
    order inside a day is resolved by a window per day.
    """
    by = list(by)
    days = df.groupBy(*by, day).agg(F.sum(value).alias("_day"))
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(*by, day, F.coalesce(F.sum("_day").over(w), F.lit(0.0)).alias("_before"))
    inner = Window.partitionBy(*by, day).orderBy(*within).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_inner", F.sum(value).over(inner)).join(before, [*by, day]).withColumn(
        out, F.col("_before") + F.col("_inner")).drop("_before", "_inner")
