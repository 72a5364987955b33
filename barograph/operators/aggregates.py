"""Aggregations of lookups and screeners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth_metrics(financials: DataFrame) -> DataFrame:
    """Multi-year metrics per symbol. The yearly rows of one symbol form a short array
    (one element per fiscal year), so all metrics come from one aggregation."""
    years = F.sort_array(F.collect_list(F.struct(
        "fiscal_year_end", "total_revenue", "net_income", "free_cashflow", "stockholders_equity")))
    rows = financials.where(F.col("total_revenue").isNotNull()).groupBy("symbol").agg(years.alias("y"))
    y, n = F.col("y"), F.size("y")
    newest = F.element_at(y, -1)
    third = F.when(n >= 3, F.try_element_at(y, F.lit(-3)))
    older = F.filter(F.slice(y, 1, F.greatest(n - 1, F.lit(0))), lambda r: r["total_revenue"] != 0)
    oldest = F.when(n >= 4, F.try_element_at(older, F.lit(1)))
    recent = F.slice(y, F.greatest(n - 2, F.lit(1)), 3)

    def span(old):
        return F.datediff(newest["fiscal_year_end"], old["fiscal_year_end"]) / 365.25

    def cagr(old, least):
        usable = (newest["total_revenue"] > 0) & (old["total_revenue"] > 0) & (span(old) > 0) & (span(old) >= least)
        return F.when(usable, F.pow(newest["total_revenue"] / old["total_revenue"], 1 / span(old)) - 1)

    def mean_ratio(num, den):
        ratios = F.transform(F.filter(recent, lambda r: r[num].isNotNull() & (r[den] != 0)), lambda r: r[num] / r[den])
        return F.try_divide(F.aggregate(ratios, F.lit(0.0), lambda a, v: a + v), F.size(ratios))

    return rows.select(
        "symbol", cagr(third, 0.0).alias("rev_cagr_3yr"), cagr(oldest, 2.5).alias("rev_cagr_5yr"),
        mean_ratio("free_cashflow", "total_revenue").alias("fcf_margin_3yr"),
        mean_ratio("net_income", "stockholders_equity").alias("roe_avg_3yr"))


# Market-cap bucket floors.
CAP_FLOORS = (("large", 2_000_000_000), ("mid", 300_000_000), ("small", 50_000_000), ("micro", 10_000_000))


def cap_bucket(cap: Column, floors=CAP_FLOORS) -> Column:
    out = F.when(cap.isNull(), "unknown")
    for name, low in floors:
        out = out.when(cap >= low, name)
    return out.otherwise("nano")


def bracket(value: Column, breaks: list[Column]) -> Column:
    """1 + number of breakpoints at or below the value."""
    out = F.lit(1)
    for limit in breaks:
        out = out + F.when(value >= limit, 1).otherwise(0)
    return out


def portfolio_stats(returns: DataFrame, by, ret: str = "ret") -> DataFrame:
    r = F.col(ret)
    n = F.count(r)
    sharpe = F.when(n > 1, F.avg(r) / (F.stddev_pop(r) + 1e-10) * (252 ** 0.5))
    return returns.groupBy(*by).agg(
        n.alias("n"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(r).alias("mean_return"),
        sharpe.alias("sharpe"), (F.product(1 + r) - 1).alias("total_return"))


def completed_month_ends(bars: DataFrame, as_of: Column) -> DataFrame:
    """All rows dated on the market's last trading day of each completed month."""
    last = bars.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date")).where(
        F.col("month") < F.trunc(as_of, "MM"))
    return bars.join(F.broadcast(last.select("date")), "date")  # one row per month


def last_rows_range(df: DataFrame, key: str, date: str, value: str, rows: int) -> DataFrame:
    """Max and min over the newest ``rows`` non-null rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    return df.where(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(w)).where(
        F.col("rn") <= rows).groupBy(key).agg(F.max(value).alias("high"), F.min(value).alias("low"))
