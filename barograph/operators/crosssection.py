"""Cross-sectional operators: one group per date.

A date group holds one row per symbol, so its size is the number of listed symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def unit_rank(score: str, by=("date",), tie: str = "symbol") -> Column:
    """Ordinal rank scaled to [0, 1] among non-null scores; null when n < 2."""
    present = F.col(score).isNotNull()
    group = Window.partitionBy(*by, present)
    n = F.count(F.lit(1)).over(group)
    position = F.row_number().over(group.orderBy(F.col(score), F.col(tie)))
    return F.when(present & (n >= 2), (position - 1) / (n - 1))


def average_rank(value: Column | str, by) -> Column:
    """Rank with ties averaged."""
    value = F.col(value) if isinstance(value, str) else value
    group = Window.partitionBy(*by)
    return F.rank().over(group.orderBy(value)) + (
        F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1
    ) / 2.0
