"""Date functions: parses and fiscal-year arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, tried in order.
LAYOUTS = ("yyyyMMdd", "yyyy-MM-dd", "dd/MM/yyyy", "d/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d MMM yyyy",
           "yyyy-MM-dd'T'HH:mm:ss'Z'")


def any_date(text: Column, layouts=LAYOUTS) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(layout))) for layout in layouts])


def day_month_in_year(text: Column, year: Column) -> Column:
    """'d-MMM' text completed by a year."""
    return F.to_date(F.try_to_timestamp(F.concat(text, F.lit("-"), year.cast("string")), F.lit("d-MMM-yyyy")))


def fiscal_label(year: Column) -> Column:
    return F.concat((year - 1).cast("string"), F.lit("-"), F.substring(year.cast("string"), -2, 2))


def fiscal_bounds(year: Column) -> dict[str, Column]:
    """Jul-Mar (q13) and Apr-Jun (q4) of the fiscal year ending in ``year``."""
    def day(y, month, d):
        return F.make_date(y.cast("int"), F.lit(month), F.lit(d))

    return {"q13_start": day(year - 1, 7, 1), "q13_end": day(year, 3, 31),
            "q4_start": day(year, 4, 1), "q4_end": day(year, 6, 30)}


def last_complete_fiscal_year(as_of: Column, buffer_days: int = 5) -> Column:
    candidate = F.year(as_of) - F.when(F.month(as_of) >= 7, 0).otherwise(1)
    close = F.make_date(candidate, F.lit(6), F.lit(30))
    return candidate - F.when(as_of < F.date_add(close, buffer_days), 1).otherwise(0)
