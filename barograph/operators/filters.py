"""Row and key filters over panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.operators.rolling import last_rows, series


def split(df: DataFrame, which: str, cut, date: str = "date") -> DataFrame:
    """'train' before the cut, 'backtest' from it on, 'all' unchanged."""
    if which == "train":
        return df.where(F.col(date) < F.lit(cut))
    if which == "backtest":
        return df.where(F.col(date) >= F.lit(cut))
    if which == "all":
        return df
    raise ValueError(f"unknown split {which!r}")


def symbols_with_history(bars: DataFrame, least: int) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def with_history(bars: DataFrame, least: int) -> DataFrame:
    """Bars of symbols that have at least ``least`` rows: count first, then a semi-join."""
    return bars.join(symbols_with_history(bars, least), "symbol", "left_semi")


def liquid_symbols(bars: DataFrame, min_value: float, min_coverage: float, by: tuple = ()) -> DataFrame:
    """Symbols whose median traded value and share of trading days pass.

    With ``by`` (for example industry) the day total is taken inside each group.
    """
    days = bars.groupBy(*by).agg(F.countDistinct("date").alias("days"))
    stats = bars.groupBy(*by, "symbol").agg(
        F.median(F.col("close") * F.col("volume")).alias("median_value"),
        F.count(F.lit(1)).alias("n_days"),
    )
    if by:
        stats = stats.join(days, list(by))
        total = F.col("days")
    else:
        total = days.scalar()
    least = F.floor(F.lit(min_coverage) * total)
    return stats.where((F.col("median_value") >= min_value) & (F.col("n_days") >= least))


def modelling_universe(bars: DataFrame, symbols: DataFrame, as_of: Column, min_days: int,
                       max_age_days: int, max_move: float) -> DataFrame:
    """Current symbols with enough rows, a recent trade and no extreme one-row move."""
    move = F.abs(F.col("close") / F.lag("close").over(series(order="date")) - 1)
    stats = bars.withColumn("move", move).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"), F.max("move").alias("max_move"))
    return stats.where(
        (F.col("n") >= min_days) & (F.col("last_date") >= F.date_sub(as_of, max_age_days))
        & (F.coalesce("max_move", F.lit(0.0)) <= max_move)
    ).join(symbols.where("current"), "symbol", "left_semi")


def with_bad_price_flag(bars: DataFrame, factor: float = 4.0) -> DataFrame:
    """Flags rows whose close is more than ``factor`` times (or below 1/factor of) the last
    non-null, non-zero close before it."""
    usable = F.when(F.col("close") != 0, F.col("close"))
    earlier = F.last(usable, ignorenulls=True).over(
        series(order="date").rowsBetween(Window.unboundedPreceding, -1))
    ratio = F.col("close") / earlier
    bad = (earlier > 0) & (F.col("close") != 0) & ((ratio > factor) | (ratio < 1.0 / factor))
    return bars.withColumn("bad", F.coalesce(bad, F.lit(False)))


def without_recent_bad(flagged: DataFrame, rows: int = 25) -> DataFrame:
    recent = F.max(F.col("bad").cast("int")).over(last_rows(rows, order="date"))
    return flagged.withColumn("_recent", recent).where(F.col("_recent") == 0).drop("_recent")


def pair_predicate(industry=None, leader=None, follower=None, min_abs_r=None, min_stable=None,
                   min_lag=None, max_lag=None, direction=None) -> Column:
    """Composable predicate over a lead-lag pair table.

    The absolute threshold is written as two ranges so parquet min/max statistics apply;
    a missing out-of-sample r does not contradict a direction.
    """
    terms = []
    if industry is not None:
        terms.append(F.col("industry") == industry)
    if leader is not None:
        terms.append(F.col("leader") == leader)
    if follower is not None:
        terms.append(F.col("follower") == follower)
    if min_abs_r is not None:
        terms.append((F.col("train_r") >= min_abs_r) | (F.col("train_r") <= -min_abs_r))
    if min_stable is not None:
        terms.append(F.col("n_stable") >= min_stable)
    if min_lag is not None:
        terms.append(F.col("lag_days") >= min_lag)
    if max_lag is not None:
        terms.append(F.col("lag_days") <= max_lag)
    if direction == "positive":
        terms.append((F.col("train_r") > 0) & (F.col("backtest_r").isNull() | (F.col("backtest_r") > 0)))
    elif direction == "negative":
        terms.append((F.col("train_r") < 0) & (F.col("backtest_r").isNull() | (F.col("backtest_r") < 0)))
    predicate = F.lit(True)
    for term in terms:
        predicate = predicate & term
    return predicate


PAIR_SORTS = {
    "train_r": lambda: [F.abs("train_r").desc()],
    "backtest_r": lambda: [F.abs("backtest_r").desc_nulls_last()],
    "stability": lambda: [F.col("n_stable").desc(), F.col("recency_score").desc()],
    "lag_days": lambda: [F.col("lag_days").asc()],
    "fdr_p": lambda: [F.col("fdr_p").asc()],
}
"""Whitelist of sort columns of the pair table."""


def sort_pairs(pairs: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    if by not in PAIR_SORTS:
        raise ValueError(f"cannot sort by {by!r}; choose one of {sorted(PAIR_SORTS)}")
    ordered = pairs.orderBy(*PAIR_SORTS[by](), "leader", "follower", "lag_days")
    return ordered.limit(limit) if limit is not None else ordered


# Exchange holidays of one year (ISO dates), used by the market-closed predicate.
SAMPLE_HOLIDAYS = ("1996-01-01", "1996-01-26", "1996-04-05", "1996-04-08", "1996-04-25", "1996-06-10",
                   "1996-12-25", "1996-12-26")


def market_closed(date: Column, holidays) -> Column:
    """Holiday list only; weekends are tested separately."""
    return F.date_format(date, "yyyy-MM-dd").isin(*holidays)


def weekend(date: Column) -> Column:
    return F.weekday(date) >= 5
