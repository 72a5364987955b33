"""Trading-calendar operators.

Every calendar here is a set of *distinct dates*, so its size is bounded by the days
covered (about 250 rows a year) whatever the number of rows or symbols behind it. That
bound is what makes the un-partitioned window and the broadcast below safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(bars: DataFrame, date: str = "date") -> DataFrame:
    """Dense index ``t`` (0-based) of all dates on which any symbol trades."""
    dates = bars.select(date).distinct()
    return dates.select(
        date, (F.row_number().over(Window.orderBy(date)) - 1).cast("long").alias("t")
    )


def with_calendar_index(df: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    return df.join(F.broadcast(calendar), date)


def previous_slot(value: Column | str, by: str = "symbol", t: str = "t") -> Column:
    """Value one calendar slot earlier; null when the symbol has no row in that slot."""
    return at_slot(value, -1, by, t)


def at_slot(value: Column | str, offset: int, by: str = "symbol", t: str = "t") -> Column:
    """Value exactly ``offset`` calendar slots away, without a dense panel or a join.

    A RANGE frame on the calendar index holds at most one row per symbol and slot.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.first(value).over(Window.partitionBy(by).orderBy(t).rangeBetween(offset, offset))


def every_kth_date(calendar: DataFrame, k: int) -> DataFrame:
    return calendar.where(F.col("t") % k == 0)


def equal_slices(n: int, total: Column, t: Column) -> Column:
    """Slice number p with ``floor(total*p/n) <= t < floor(total*(p+1)/n)``."""
    guess = F.floor(t * n / total)
    lower = F.floor(total * guess / n)
    upper = F.floor(total * (guess + 1) / n)
    return (
        F.when(t < lower, guess - 1).when(t >= upper, guess + 1).otherwise(guess).cast("int")
    )
