"""Rolling operators.

Calendar-based operators use RANGE frames on the calendar index ``t``: a frame of W slots
then means W market days whether or not the symbol traded on each, so no symbol x date
grid is ever built. Row-based operators use ROWS frames on a symbol's own rows.

All windows share one (symbol, t) specification, so a chain of them costs one exchange and
one sort. A window group holds at most one row per calendar day, because (symbol, date)
is unique after bar building; it cannot grow with the number of raw records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(by="symbol", order="t"):
    return Window.partitionBy(by).orderBy(order)


def slots(window: int, by="symbol", t="t"):
    return series(by, t).rangeBetween(-(window - 1), 0)


def last_rows(window: int, by="symbol", order="t"):
    return series(by, order).rowsBetween(-(window - 1), 0)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def floor_at(value: Column, low: float) -> Column:
    return F.greatest(value, F.lit(low))


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp that keeps nulls null (``least``/``greatest`` skip nulls)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


# --- one-step features on the calendar -------------------------------------------------

def with_step_features(panel: DataFrame) -> DataFrame:
    """Adds returns, log_returns, hl_spread, gap; null unless t-1 and t are both valid."""
    w = series()
    adjacent = (
        F.col("valid") & F.lag("valid").over(w) & (F.lag("t").over(w) == F.col("t") - 1)
    )
    previous = floor_at(F.lag("close").over(w), 1e-8)
    return panel.withColumns({
        "returns": F.when(adjacent, (F.col("close") - F.lag("close").over(w)) / previous),
        "log_returns": F.when(adjacent, F.log(floor_at(F.col("close") / previous, 1e-10))),
        "hl_spread": F.when(F.col("valid"), (F.col("high") - F.col("low")) / floor_at(F.col("close"), 1e-8)),
        "gap": F.when(adjacent, (F.col("open") - F.lag("close").over(w)) / previous),
    })


def row_log_return(close: Column | str, by="symbol", order="date") -> Column:
    """Log return against the symbol's previous own row, bridging calendar gaps."""
    return F.log(as_column(close) / F.lag(close).over(series(by, order)))


def forward_return(close: str, horizon: int, by="symbol", t="t") -> Column:
    """Return from t to t+horizon when both slots are valid."""
    w = series(by, t).rangeBetween(horizon, horizon)
    later = F.first(F.when(F.col("valid"), F.col(close))).over(w)
    return F.when(F.col("valid"), later / floor_at(F.col(close), 1e-8) - 1)


# --- calendar windows ------------------------------------------------------------------

def zscore_strict(x: Column | str, window: int) -> Column:
    """Sample-std z-score; null if any slot of the window is missing or std <= 1e-8."""
    x, w = as_column(x), slots(window)
    std = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) == window) & (std > 1e-8), (x - F.avg(x).over(w)) / std)


def zscore_fast(x: Column | str, window: int) -> Column:
    """Population z-score over W slots in which a missing slot counts as zero."""
    x, w = as_column(x), slots(window)
    filled = F.coalesce(x, F.lit(0.0))
    mean = F.sum(filled).over(w) / window
    variance = floor_at(F.sum(filled * filled).over(w) / window - mean * mean, 0.0)
    return F.when(x.isNotNull() & (F.col("t") >= window - 1),
                  (x - mean) / floor_at(F.sqrt(variance), 1e-8))


def slope_strict(x: Column | str, window: int) -> Column:
    """OLS slope on ``window`` points spread over [-1, 1]; null if a slot is missing."""
    x, w = as_column(x), slots(window)
    return F.when(F.count(x).over(w) == window,
                  F.regr_slope(x, F.col("t").cast("double")).over(w) * ((window - 1) / 2))


def sum_zero_filled(x: Column | str, window: int) -> Column:
    x = as_column(x)
    return F.when(F.col("t") >= window, F.sum(F.coalesce(x, F.lit(0.0))).over(slots(window)))


# --- row windows that skip nulls ---------------------------------------------------------

def zscore_skipping(x: Column | str, window: int, by="symbol", order="date") -> Column:
    x, w = as_column(x), last_rows(window, by, order)
    std = F.stddev_samp(x).over(w)
    enough = (F.count(x).over(w) >= max(window // 2, 5)) & _full(window, by, order)
    return F.when(enough & (std >= 1e-8), (x - F.avg(x).over(w)) / std)


def sum_skipping(x: Column | str, window: int, by="symbol", order="date") -> Column:
    x, w = as_column(x), last_rows(window, by, order)
    enough = (F.count(x).over(w) >= window // 2) & _full(window, by, order)
    return F.when(enough, F.coalesce(F.sum(x).over(w), F.lit(0.0)))


def _full(window: int, by, order) -> Column:
    return F.row_number().over(series(by, order)) >= window


def is_stale(close: str, rows: int = 5, by="symbol", order="date") -> Column:
    """Price identical over the last ``rows`` rows, from the row after that on."""
    w = last_rows(rows, by, order)
    return (F.min(close).over(w) == F.max(close).over(w)) & _full(rows + 1, by, order)


def mean_return_ratio(num: str, den: str, rows=10, least=5, floor=5e-4, by="symbol", order="date") -> Column:
    """Mean of num/den over the window rows whose denominator is not negligible."""
    w = last_rows(rows, by, order)
    usable = F.col(num).isNotNull() & (F.abs(F.col(den)) > floor)
    ratio = F.when(usable, F.col(num) / F.col(den))
    return F.when((F.count(ratio).over(w) >= least) & _full(rows + 1, by, order), F.avg(ratio).over(w))


def historical_volatility(ret: str, rows=30, least=20, by="symbol", order="date") -> Column:
    w = last_rows(rows, by, order)
    return F.when((F.count(ret).over(w) >= least) & _full(rows + 1, by, order),
                  F.stddev_samp(ret).over(w) * (252 ** 0.5))


# --- statistics of the last non-null values of a bounded history --------------------------

def with_tails(df: DataFrame, wanted: dict[str, tuple[str, str, int, int]], by="symbol", order="date") -> DataFrame:
    """Adds ``out: (kind, column, history, keep)`` over the last ``keep`` non-null values of the last ``history`` rows.

    ``zscore``: population z-score of the last such value, null below two values or without
    spread. ``slope``: OLS slope against 0, 1, ..., null below two values.

    Counting a column's non-null rows numbers them, and a null row carries the number of the one
    before it. So "the last ``keep`` values" is a RANGE frame over that number, as long as the
    history holds that many; where it holds fewer, all of them count and the history's ROWS
    frame serves. Nothing is collected, and one exchange by ``by`` serves all columns.
    """
    number = {c: f"_k_{c}" for _, c, _, _ in wanted.values()}
    upto = series(by, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({k: F.count(c).over(upto).cast("double") for c, k in number.items()})
    kinds = {"zscore": _tail_zscore, "slope": _tail_slope}
    return rows.withColumns({
        out: kinds[kind](F.col(c), F.col(number[c]), last_rows(history, by, order),
                         Window.partitionBy(by).orderBy(number[c]).rangeBetween(-(keep - 1), 0), keep)
        for out, (kind, c, history, keep) in wanted.items()}).drop(*number.values())


def _tail(agg: Column, x: Column, near, kept, keep: int) -> Column:
    return F.when(F.count(x).over(near) < keep, agg.over(near)).otherwise(agg.over(kept))


def _tail_zscore(x: Column, k: Column, near, kept, keep: int) -> Column:
    spread = _tail(F.stddev_pop(x), x, near, kept, keep)
    last = F.last(x, ignorenulls=True).over(near)
    return F.when((F.count(x).over(near) >= 2) & (spread > 0), (last - _tail(F.avg(x), x, near, kept, keep)) / spread)


def _tail_slope(x: Column, k: Column, near, kept, keep: int) -> Column:
    return F.when(F.count(x).over(near) >= 2, _tail(F.regr_slope(x, k), x, near, kept, keep))


# --- running extremes --------------------------------------------------------------------

def running(agg, value: Column | str, by, order) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return agg(as_column(value)).over(w)
