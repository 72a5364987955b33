"""Cross-sectional signals: panel in, (symbol, date, t, score) out.

A signal is a function of the panel whose frames end at the current row, so a score never
depends on later rows. Higher is more bullish. Each signal costs one exchange by symbol
(rolling part) and one by date (ranking part).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.operators import rolling as R
from barograph.operators.crosssection import unit_rank

KEYS = ("symbol", "date", "t")

# Which industries a commodity's momentum speaks for.
COMMODITY_SECTORS = {
    "GC=F": ("Gold", "Metals & Mining"),
    "CL=F": ("Energy", "Oil, Gas & Consumable Fuels"),
    "HG=F": ("Copper", "Metals & Mining"),
}


def short_trend(feat: DataFrame, window: int = 20) -> DataFrame:
    """Falling short interest ranks high."""
    raw = feat.select(*KEYS, F.when(F.col("valid"), -R.slope_strict("short_pct", window)).alias("raw"))
    return raw.select(*KEYS, unit_rank("raw").alias("score"))


def short_squeeze(feat: DataFrame, momentum_window: int = 5, top: float = 0.8) -> DataFrame:
    """Momentum rank of the symbols whose short interest ranks in the top share."""
    raw = feat.select(
        *KEYS, F.when(F.col("valid"), F.col("short_pct")).alias("short"),
        F.when(F.col("valid"), R.sum_zero_filled("returns", momentum_window)).alias("momentum"))
    ranked = raw.select(*KEYS, unit_rank("short").alias("short_rank"), unit_rank("momentum").alias("momentum_rank"))
    return ranked.select(*KEYS, F.when(F.col("short_rank") >= top, F.col("momentum_rank")).alias("score"))


def volume_anomaly(feat: DataFrame, volume_window: int = 20, return_window: int = 5) -> DataFrame:
    """Volume z-score signed by recent momentum."""
    staged = feat.withColumn("log_volume", F.when(F.col("valid"), F.log1p("volume")))
    raw = staged.select(*KEYS, F.when(F.col("valid"), R.zscore_fast("log_volume", volume_window)
                                      * F.signum(R.sum_zero_filled("returns", return_window))).alias("raw"))
    return raw.select(*KEYS, unit_rank("raw").alias("score"))


def commodity_lead(feat: DataFrame, symbols: DataFrame, prices: DataFrame, sectors: DataFrame,
                   window: int = 5) -> DataFrame:
    """Momentum of the mapped commodity, given to every symbol of the mapped industry.

    ``sectors`` maps commodity id to industry; it and the commodity dates are small
    reference tables, but only joined on keys, so nothing depends on that.
    """
    w = Window.partitionBy("id").orderBy("date")
    momentum = prices.select("id", "date", (F.col("price") / F.lag("price", window).over(w) - 1).alias("m")).where(F.col("m").isNotNull())
    by_industry = momentum.join(sectors, "id").groupBy("industry", "date").agg(F.avg("m").alias("raw"))
    rows = feat.where("valid").select(*KEYS).join(symbols.select("symbol", "industry"), "symbol").join(by_industry, ["industry", "date"])
    return rows.select(*KEYS, unit_rank("raw").alias("score"))


SIGNALS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "short_trend": short_trend, "short_squeeze": short_squeeze, "volume_anomaly": volume_anomaly,
}


def signal_table(feat: DataFrame) -> DataFrame:
    """(signal, symbol, date, t, score) of every signal; rows without a score are left out."""
    parts = [signal(feat).select(F.lit(name).alias("signal"), *KEYS, "score") for name, signal in SIGNALS.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.where(F.col("score").isNotNull())


def feature_bank(feat: DataFrame) -> DataFrame:
    """Thirteen candidate features in one pass over the (symbol, t) ordering."""
    base = feat.withColumns({
        "log_volume": F.when(F.col("valid"), F.log1p("volume")),
        "short_pct": F.when(F.col("valid"), F.col("short_pct")),
    })
    return base.select(
        *KEYS, "valid", F.col("returns").alias("returns_1d"),
        R.zscore_fast("returns", 20).alias("returns_z20"), R.zscore_fast("returns", 5).alias("returns_z5"),
        R.slope_strict("returns", 20).alias("returns_slope20"), "log_volume",
        R.zscore_fast("log_volume", 20).alias("volume_z20"), R.zscore_fast("log_volume", 5).alias("volume_z5"),
        "short_pct", R.zscore_fast("short_pct", 20).alias("short_z20"), R.slope_strict("short_pct", 20).alias("short_slope20"),
        "hl_spread", R.zscore_fast("hl_spread", 20).alias("hl_z20"), "gap")


BANK = ("returns_1d", "returns_z20", "returns_z5", "returns_slope20", "log_volume", "volume_z20", "volume_z5",
        "short_pct", "short_z20", "short_slope20", "hl_spread", "hl_z20", "gap")

FACTORS = ("short_pct", "hl_spread", "gap", "returns_1d", "returns_z20", "volume_z20", "volume_z5", "short_z20",
           "returns_slope20", "short_slope20")


def factor_bank(bars: DataFrame, shorts: DataFrame, fundamentals: DataFrame | None = None) -> DataFrame:
    """Back-test factors of each row from the symbol's last 25 own rows.

    ``fundamentals`` (one snapshot row per symbol) adds its columns as ``f_*`` factors.
    """
    rows = bars.join(shorts.select("symbol", "date", "short"), ["symbol", "date"], "left")
    w = R.series(order="date")
    prev = F.lag("close").over(w)
    rows = rows.withColumns({
        "prev": prev,
        "ret": F.when((prev != 0) & (F.col("close") != 0), F.col("close") / prev - 1),
        "live_volume": F.when(F.col("volume") > 0, F.col("volume")),
    })
    tails = R.with_tails(rows, {
        "returns_z20": ("zscore", "ret", 24, 20), "volume_z20": ("zscore", "live_volume", 25, 20),
        "volume_z5": ("zscore", "live_volume", 25, 5), "short_z20": ("zscore", "short", 25, 20),
        "returns_slope20": ("slope", "ret", 24, 20), "short_slope20": ("slope", "short", 25, 20)})
    bank = tails.select(
        "symbol", "date", F.col("short").alias("short_pct"),
        F.when(F.col("close") != 0, (F.col("high") - F.col("low")) / F.col("close")).alias("hl_spread"),
        F.when(F.col("prev") != 0, F.col("open") / F.col("prev") - 1).alias("gap"),
        F.when(F.col("prev") != 0, F.col("close") / F.col("prev") - 1).alias("returns_1d"),
        "returns_z20", "volume_z20", "volume_z5", "short_z20", "returns_slope20", "short_slope20")
    if fundamentals is None:
        return bank
    extra = [c for c in fundamentals.columns if c not in ("symbol", "date")]
    return bank.join(fundamentals.select("symbol", *[F.col(c).alias(f"f_{c}") for c in extra]), "symbol", "left")


def latest_scores(scores: DataFrame, symbols: DataFrame) -> DataFrame:
    """Scores of the last calendar date, rounded, with metadata and rank order."""
    last = scores.agg(F.max("date")).scalar()
    return scores.where((F.col("date") == last) & F.col("score").isNotNull()).join(
        symbols.select("symbol", "name", "industry"), "symbol", "left").select(
        "symbol", "date", F.round("score", 4).alias("score"), "name", "industry").orderBy(F.col("score").desc(), "symbol")


def merged_latest(feat: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per symbol with the latest score of every signal."""
    named = None
    for name, signal in SIGNALS.items():
        part = latest_scores(signal(feat), symbols).select("symbol", F.lit(name).alias("signal"), "score")
        named = part if named is None else named.unionByName(part)
    return named.groupBy("symbol").pivot("signal", list(SIGNALS)).agg(F.max("score"))


def lookahead_correlation(scores: DataFrame, forward: DataFrame, lag: int = 1, least: int = 10) -> DataFrame:
    """Pooled Pearson r of score[t] with the forward value at t + lag."""
    shifted = forward.select("symbol", (F.col("t") - lag).alias("t"), F.col("fwd"))
    both = scores.join(shifted, ["symbol", "t"]).where(F.col("score").isNotNull() & F.col("fwd").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("score", "fwd").alias("r")).select(
        "n", F.when(F.col("n") >= least, F.col("r")).alias("r"))
