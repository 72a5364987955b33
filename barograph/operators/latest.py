"""Latest, previous and first rows per key, without self-joins.

``max_by`` combines map-side, so a key holding a large share of all rows costs one partial
row per task. ``row_number() <= n`` filters use Spark's window group limit, which also
trims each partition before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key, date: str, *columns: str, tie: str | None = None) -> DataFrame:
    """Row with the greatest date per key (ties by ``tie``)."""
    keys = [key] if isinstance(key, str) else list(key)
    order = F.struct(date, tie) if tie else F.col(date)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(date, *columns), order).alias("_row"))
    return picked.select(*keys, f"_row.{date}", *[f"_row.{c}" for c in columns])


def first_n(df: DataFrame, keys, order, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def last_two(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Latest and previous value per key."""
    top = first_n(df.select(key, date, value), [key], [F.col(date).desc()], 2)
    return top.groupBy(key).agg(
        F.max(F.when(F.col("rn") == 1, F.col(date))).alias("date"),
        F.max(F.when(F.col("rn") == 1, F.col(value))).alias("price"),
        F.max(F.when(F.col("rn") == 2, F.col(value))).alias("prev"),
    )


# Look-back of each period return in days.
PERIOD_DAYS = {
    "change_1m_pct": 31, "change_3m_pct": 92, "change_6m_pct": 183,
    "change_1y_pct": 365, "change_3y_pct": 1095, "change_5y_pct": 1825,
}


def percent(new: Column, old: Column) -> Column:
    return F.round(F.try_divide(new - old, old) * 100, 2)


def period_returns(prices: DataFrame, month_end: DataFrame, as_of: Column) -> DataFrame:
    """1d and 1w change from daily rows, longer ones from the first month-end at/after the
    look-back date (else the last month-end). One aggregation per source table."""
    daily = last_two(prices, "symbol", "date", "close")
    week = prices.where(F.col("date") <= F.date_sub(as_of, 7)).groupBy("symbol").agg(
        F.max_by("close", "date").alias("ref_1w"))
    refs = month_end.groupBy("symbol").agg(
        F.max_by("close", "date").alias("ref_last"),
        *[F.min_by("close", F.when(F.col("date") >= F.date_sub(as_of, days), F.col("date"))).alias(f"ref_{name}")
          for name, days in PERIOD_DAYS.items()],
    )
    joined = daily.join(week, "symbol").join(refs, "symbol")
    return joined.select(
        "symbol", F.round("price", 6).alias("price"),
        percent(F.col("price"), F.col("prev")).alias("change_1d_pct"),
        percent(F.col("price"), F.col("ref_1w")).alias("change_1w_pct"),
        *[percent(F.col("price"), F.coalesce(f"ref_{name}", "ref_last")).alias(name) for name in PERIOD_DAYS],
    )
