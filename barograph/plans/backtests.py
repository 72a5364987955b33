"""Trade-ledger evaluations: candidates by joins, keyed non-overlap, running totals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions import scalars as S
from barograph.functions.stats import binomial_tail, t_tail
from barograph.operators import ledger as L
from barograph.operators import rolling as R
from barograph.operators.crosssection import average_rank
from barograph.operators.filters import with_bad_price_flag
from barograph.plans import discovery as X
from barograph.session import cut_lineage

# Grid of the parameter sweep.
TRAIN_R_GRID = (0.80, 0.82, 0.84, 0.86, 0.88, 0.90, 0.92, 0.94, 0.96)
BACKTEST_R_GRID = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50)
LAG_GRID = (1, 2, 3, 4, 5, 7, 10, 15, 20)


# --- pair trades ----------------------------------------------------------------------------

@dataclass(frozen=True)
class PairConfig:
    """One pair strategy of a catalogue."""

    id: str
    min_train_r: float
    min_backtest_r: float
    min_lag: int = 1
    no_overlap: bool = False
    dedup: bool = False
    industries: tuple[str, ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()

    def predicate(self) -> Column:
        keep = (F.col("train_r") >= self.min_train_r) & (F.col("backtest_r") > self.min_backtest_r) & (
            F.col("lag_days") >= self.min_lag)
        if self.industries:
            keep = keep & F.col("industry").isin(*self.industries)
        if self.pairs:
            keep = keep & F.concat_ws("|", "leader", "follower").isin(*["|".join(p) for p in self.pairs])
        return keep


# The eight pair strategies.
PAIR_CONFIGS = (
    PairConfig("v1", 0.90, 0.10, 1),
    PairConfig("v2", 0.91, 0.15, 3, True),
    PairConfig("v3", 0.91, 0.15, 3, True, True),
    PairConfig("v5", 0.85, 0.40, 3, True, True),
    PairConfig("v4", 0.94, 0.20, 2, True, True),
    PairConfig("v6", 0.80, 0.10, 15, True, True),
    PairConfig("v7", 0.80, 0.10, 15, True, True, ("Materials", "Commercial & Professional Services")),
    PairConfig("v8", 0.80, 0.10, 15, True, True, (), (("RIO", "SBM"), ("BXB", "DOW"))),
)


def qualifying(pairs: DataFrame, configs) -> DataFrame:
    """Pairs of every configuration, keyed by ``config``: each pair row lists the strategies
    it satisfies, so the table is read once however long the catalogue."""
    flags = F.array(*[F.when(c.predicate(), F.struct(
        F.lit(c.id).alias("config"), F.lit(c.dedup).alias("dedup"), F.lit(c.no_overlap).alias("no_overlap"))) for c in configs])
    hits = pairs.where(F.col("train_r") > 0).select(
        "*", F.explode(F.filter(flags, lambda c: c.isNotNull())).alias("c")).select(*pairs.columns, "c.*")
    deduped = L.undirected_best(hits.where("dedup"), ["config"], "train_r", ["leader", "follower", "lag_days"])
    return hits.where(~F.col("dedup")).unionByName(deduped)


def leader_rises(panel: DataFrame) -> DataFrame:
    """Slots at which a symbol's close rose on the calendar day before."""
    w = R.series()
    prev = F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("close").over(w))
    rows = panel.select(F.col("symbol").alias("leader"), F.col("t").alias("signal_t"), F.col("date").alias("signal_date"),
                        F.when(prev != 0, F.col("close") / prev - 1).alias("leader_return"))
    return rows.where(F.col("leader_return") > 0)


def exits(panel: DataFrame, max_lag: int) -> DataFrame:
    """Per buy slot: open price and the closes of the following slots, lag 1 being its own."""
    w = R.series()

    def at(col, k):
        return F.first(col).over(w.rangeBetween(k, k))

    steps = F.array(*[F.struct(at("date", k).alias("date"), at("close", k).alias("close")) for k in range(max_lag)])
    return panel.select(F.col("symbol").alias("follower"), (F.col("t") - 1).alias("signal_t"), F.col("t").alias("buy_t"),
                        F.col("date").alias("buy_date"), F.col("open").alias("buy_price"), steps.alias("steps"))


def pair_candidates(pairs: DataFrame, panel: DataFrame, max_lag: int) -> DataFrame:
    """Buy the follower at the next open after the leader rose, sell at the close of t + lag."""
    signals = pairs.join(leader_rises(panel), "leader")
    joined = signals.join(exits(panel, max_lag), ["follower", "signal_t"])
    exit_ = F.element_at("steps", F.col("lag_days"))
    return joined.withColumns({
        "sell_date": exit_["date"], "sell_price": exit_["close"],
        "sell_t": F.col("signal_t") + F.col("lag_days"),
    }).where(F.col("sell_price").isNotNull() & (F.col("buy_price") > 0)).drop("steps")


def pair_ledger(candidates: DataFrame) -> DataFrame:
    """Economics of all trades; strategies without overlap keep disjoint holdings per follower."""
    sized = cut_lineage(L.economics(candidates))
    free = sized.where(~F.col("no_overlap"))
    kept = L.non_overlapping(sized.where("no_overlap"), ["config", "follower"], "buy_t", "sell_t", ["leader", "lag_days"])
    return free.unionByName(kept)


def recommendations(pairs: DataFrame, panel: DataFrame) -> DataFrame:
    """Pairs whose leader rose on the last market day."""
    today = panel.agg(F.max("t")).scalar()
    last = panel.where(F.col("t") == today).select(F.col("symbol").alias("follower"), F.col("close").alias("follower_last_close"))
    return pairs.join(leader_rises(panel).where(F.col("signal_t") == today), "leader").join(last, "follower", "left").select(
        *pairs.columns, "signal_date", F.round(F.col("leader_return") * 100, 2).alias("leader_return_pct"), "follower_last_close")


def grid_sweep(pairs: DataFrame, panel: DataFrame, train_grid=TRAIN_R_GRID, backtest_grid=BACKTEST_R_GRID,
               lag_grid=LAG_GRID, max_lag: int = 20) -> DataFrame:
    """Every parameter combination in one job.

    A combination's ledger for one follower depends only on which (leader, lag) it keeps
    for that follower. Equal sets recur in many combinations, so each distinct set is
    traded once and its totals are joined back.
    """
    def values(grid):
        return F.array(*[F.lit(g) for g in grid])

    hits = pairs.where(F.col("train_r") > 0)
    hits = hits.withColumn("min_train_r", F.explode(F.filter(values(train_grid), lambda g: F.col("train_r") >= g)))
    hits = hits.withColumn("min_backtest_r", F.explode(F.filter(values(backtest_grid), lambda g: F.col("backtest_r") > g)))
    hits = hits.withColumn("min_lag_days", F.explode(F.filter(values(lag_grid), lambda g: F.col("lag_days") >= g)))
    combo = ["min_train_r", "min_backtest_r", "min_lag_days"]
    best = L.undirected_best(hits, combo, "train_r", ["leader", "follower", "lag_days"])
    # one element per leader that keeps this follower: bounded by the industry's size
    sets = best.groupBy(*combo, "follower").agg(
        F.array_sort(F.collect_list(F.struct("leader", "lag_days"))).alias("members"), F.count(F.lit(1)).alias("n_pairs"))
    distinct = sets.select("follower", "members").distinct()
    exploded = distinct.select("follower", "members", F.explode("members").alias("p")).select("follower", "members", "p.*")
    sized = L.economics(pair_candidates(exploded, panel, max_lag))
    taken = L.non_overlapping(sized, ["follower", "members"], "buy_t", "sell_t", ["leader", "lag_days"])
    fees = F.col("cost") - F.col("shares") * F.col("buy_price") + F.col("shares") * F.col("sell_price") - F.col("proceeds")
    totals = taken.groupBy("follower", "members").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("pnl"), F.sum(fees).alias("fees"))
    per = sets.join(totals, ["follower", "members"], "left").groupBy(*combo).agg(
        F.sum("n_pairs").alias("n_pairs"), F.sum("n").alias("n_trades"), F.sum("wins").alias("wins"), F.sum("pnl").alias("pnl"),
        F.sum("fees").alias("total_fees"))
    grid = pairs.sparkSession.range(1).select(F.explode(values(train_grid)).alias("min_train_r"))
    grid = grid.select("*", F.explode(values(backtest_grid)).alias("min_backtest_r")).select("*", F.explode(values(lag_grid)).alias("min_lag_days"))
    full = grid.join(per, combo, "left").fillna(0, ["n_pairs", "n_trades", "wins"]).fillna(0.0, ["pnl", "total_fees"])
    n = F.col("n_trades")
    return full.select(
        *combo, "n_pairs", "n_trades", (S.START_BALANCE + F.col("pnl")).alias("end_balance"),
        (F.col("pnl") / S.START_BALANCE * 100).alias("total_return_pct"),
        F.coalesce(F.try_divide(F.col("wins") * 100.0, n), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide("pnl", n), F.lit(0.0)).alias("avg_pnl"), "total_fees")


# --- factor strategies ------------------------------------------------------------------------

@dataclass(frozen=True)
class FactorConfig:
    """Long the top or bottom names of one or several factors, holding ``lag`` slots."""

    id: str
    legs: tuple[tuple[str, int, str], ...]
    top_n: int = 10
    no_overlap: bool = True
    name: str = field(default="", compare=False)


# The thirteen factor strategies.
FACTOR_CONFIGS = (
    FactorConfig("s1", (("short_pct", 3, "long_top"),), name="Short Interest"),
    FactorConfig("s2", (("hl_spread", 9, "long_bottom"),), name="Low Volatility"),
    FactorConfig("s3", (("returns_z20", 1, "long_bottom"),), name="Mean Reversion"),
    FactorConfig("s4", (("gap", 2, "long_top"),), name="Gap Momentum"),
    FactorConfig("s5", (("volume_z20", 3, "long_top"),), name="Volume Anomaly"),
    FactorConfig("s7", (("short_z20", 1, "long_bottom"),), name="Short Interest Z-Score"),
    FactorConfig("s8", (("volume_z5", 4, "long_top"),), name="Volume Spike (5-day)"),
    FactorConfig("s9", (("short_slope20", 1, "long_bottom"),), name="Short Trend (20-day slope)"),
    FactorConfig("s6", (("short_pct", 3, "long_top"), ("returns_1d", 1, "long_top"), ("gap", 2, "long_top"),
                        ("volume_z20", 3, "long_top"), ("volume_z5", 2, "long_top")), 8, name="Top-6 Positive Combined"),
    FactorConfig("f1", (("f_trailing_pe", 5, "long_bottom"),), name="Low P/E"),
    FactorConfig("f2", (("f_return_on_equity", 5, "long_top"),), name="High ROE"),
    FactorConfig("f3", (("f_dividend_yield", 5, "long_top"),), name="High Dividend Yield"),
    FactorConfig("f4", (("f_debt_to_equity", 5, "long_bottom"),), name="Low Leverage"),
)


def factor_candidates(bank: DataFrame, panel: DataFrame, configs, start) -> DataFrame:
    """Selected names of every strategy leg and date, with prices of the holding span.

    Rows whose last 25 rows hold a price break are not ranked; spans that contain one are
    not traded (found by a running count of breaks, not by a range join).
    """
    flagged = with_bad_price_flag(panel).withColumn("bad", F.col("bad").cast("int"))
    w = R.series(order="date")
    slots = R.series()
    max_lag = max(lag for c in configs for _, lag, _ in c.legs)
    breaks = F.sum("bad").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = flagged.withColumns({"breaks": breaks, "recent": F.max("bad").over(R.last_rows(25, order="date"))}).where(
        F.col("date") >= F.lit(start))

    def at(col, k):
        return F.first(col).over(slots.rangeBetween(k, k))

    steps = F.array(*[F.struct(at("date", k).alias("date"), at("close", k).alias("close"), at("breaks", k).alias("breaks"))
                      for k in range(1, max_lag + 1)])
    priced = rows.select(
        "symbol", "date", "t", "recent", at("date", 1).alias("buy_date"), at("open", 1).alias("buy_price"),
        (at("breaks", 1) - at("bad", 1)).alias("before"), steps.alias("steps"))
    legs = F.array(*[F.struct(F.lit(c.id).alias("config"), F.lit(k).alias("leg"), F.lit(f).alias("factor"), F.lit(lag).alias("lag_days"),
                              F.lit(side).alias("side"), F.lit(c.top_n).alias("top_n"), F.lit(c.no_overlap).alias("no_overlap"),
                              F.col(f).alias("value")) for c in configs for k, (f, lag, side) in enumerate(c.legs)])
    long = bank.join(priced.where(F.col("recent") == 0), ["symbol", "date"]).select(
        "symbol", "date", "t", "buy_date", "buy_price", "before", "steps", F.explode(legs).alias("l")
    ).select("symbol", "date", "t", "buy_date", "buy_price", "before", "steps", "l.*").where(F.col("value").isNotNull())
    last = panel.agg(F.max("t")).scalar()
    long = long.where(F.col("t") + F.col("lag_days") <= last)
    day = Window.partitionBy("config", "leg", "date")
    order = day.orderBy("value", "symbol")
    n, rn = F.count(F.lit(1)).over(day), F.row_number().over(order)
    ranked = long.withColumns({"n": n, "rn": rn}).where(F.col("n") >= 2)
    picked = ranked.where(F.when(F.col("side") == "long_top", F.col("rn") > F.col("n") - F.col("top_n")).otherwise(F.col("rn") <= F.col("top_n")))
    exit_ = F.element_at("steps", F.col("lag_days"))
    return picked.select(
        "config", "leg", "factor", "symbol", F.col("date").alias("signal_date"), F.col("t").alias("signal_t"), (F.col("t") + 1).alias("buy_t"),
        "buy_date", "buy_price", exit_["date"].alias("sell_date"), exit_["close"].alias("sell_price"), (F.col("t") + F.col("lag_days")).alias("sell_t"),
        "lag_days", "value", ((F.col("rn") - 1) / (F.col("n") - 1)).alias("rank"), "rn", "no_overlap",
        (exit_["breaks"] - F.col("before")).alias("inside"),
    ).where(F.col("sell_price").isNotNull() & (F.col("buy_price") > 0) & (F.col("inside") == 0)).drop("inside")


def factor_ledger(candidates: DataFrame) -> DataFrame:
    sized = cut_lineage(L.economics(candidates))
    kept = L.non_overlapping(sized.where("no_overlap"), ["config", "symbol"], "buy_t", "sell_t", ["leg", "rn"])
    return sized.where(~F.col("no_overlap")).unionByName(kept)


def factor_summary(trades: DataFrame) -> DataFrame:
    return L.summary(trades, ["config"]).join(L.daily_risk(trades, ["config"]), "config")


# --- signal evaluation ---------------------------------------------------------------------------

def fit_threshold(ic_ir: Column) -> Column:
    """Rank share above which a signal triggers, from its training information ratio."""
    strength = F.coalesce(F.abs(ic_ir), F.lit(0.0))
    return F.when(strength > 0.10, 0.80).when(strength > 0.05, 0.75).otherwise(0.70)


def signal_ic(scores: DataFrame, panel: DataFrame, least: int = X.MIN_NAMES) -> DataFrame:
    """Information ratio of a signal against the one-slot forward return one slot ahead."""
    rows = panel.withColumn("fwd1", F.round(R.forward_return("close", 1), 9)).join(scores.select("symbol", "date", "score"), ["symbol", "date"])
    return X.ic_stats(X.ic_series(rows, ["score"], "fwd1", 1, least), "feature", "lag")


def triggers(scores: DataFrame, panel: DataFrame, threshold, horizons) -> DataFrame:
    """Triggered rows with the forward return of every horizon (null when not available)."""
    ahead = F.array(*[R.forward_return("close", h) for h in horizons])
    rows = panel.select("symbol", "date", "t", ahead.alias("ahead")).join(scores.select("symbol", "date", "score"), ["symbol", "date"])
    return rows.where(F.col("score") >= threshold)


def by_horizon(hits: DataFrame, horizons) -> DataFrame:
    long = hits.select("symbol", "date", "t", F.posexplode("ahead").alias("k", "ret"))
    names = F.array(*[F.lit(h) for h in horizons])
    return long.where(F.col("ret").isNotNull()).groupBy(F.element_at(names, F.col("k") + 1).alias("horizon")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("ret").alias("mean_return"))


def fitted_thresholds(scores: DataFrame, panel: DataFrame, signals, least: int = X.MIN_NAMES) -> DataFrame:
    """(signal, n, ic_ir, threshold): one row for each of ``signals``, also for those without an IC.

    All signals are ranked together, date by date. ``scores`` (signal, symbol, date, score)
    must end early enough for no outcome to reach past the training span.
    """
    wide = scores.groupBy("symbol", "date").pivot("signal", list(signals)).agg(F.max(F.round("score", 8)))
    rows = panel.withColumn("fwd1", F.round(R.forward_return("close", 1), 9)).join(wide, ["symbol", "date"], "left")
    stats = X.ic_stats(X.ic_series(rows, list(signals), "fwd1", 1, least), "feature", "lag")
    names = panel.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, signals))).alias("signal"))
    return names.join(stats.withColumnRenamed("feature", "signal"), "signal", "left").select(
        "signal", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "ic_ir", fit_threshold(F.col("ic_ir")).alias("threshold"))


def signal_triggers(scores: DataFrame, panel: DataFrame, thresholds: DataFrame, horizons) -> DataFrame:
    """Rows of each signal at or over its own threshold, with the return of every horizon."""
    ahead = F.array(*[R.forward_return("close", h) for h in horizons])
    rows = panel.select("symbol", "date", "t", ahead.alias("ahead")).join(
        scores.select("signal", "symbol", "date", "score"), ["symbol", "date"])
    # a row for each signal of a catalogue
    return rows.join(F.broadcast(thresholds.select("signal", "threshold")), "signal").where(F.col("score") >= F.col("threshold"))


def signal_horizons(hits: DataFrame, horizons) -> DataFrame:
    """Hit rate and mean return of every signal and horizon."""
    names = F.array(*[F.lit(h) for h in horizons])
    long = hits.select("signal", F.posexplode("ahead").alias("k", "ret")).where(F.col("ret").isNotNull())
    return long.groupBy("signal", F.element_at(names, F.col("k") + 1).alias("horizon")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg("ret").alias("mean_return"))


def additive_drawdown(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``dd`` of each key: deepest fall of the running sum of ``ret`` below its maximum, in (symbol, date) order.

    Two levels: inside a symbol by a window; across symbols over one row per symbol.
    """
    w = Window.partitionBy(*by, "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("c", F.sum("ret").over(w))
    tops = inner.withColumn("k", F.max("c").over(w))
    per = tops.groupBy(*by, "symbol").agg(F.sum("ret").alias("total"), F.max("c").alias("top"))
    across = Window.partitionBy(*by).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    placed = per.select(*by, "symbol", "total", "top", F.coalesce(F.sum("total").over(across), F.lit(0.0)).alias("base"))
    earlier = placed.select(*by, "symbol", "base", F.max(F.col("base") + F.col("top")).over(across).alias("peak_before"))
    joined = tops.join(earlier, [*by, "symbol"])
    peak = F.greatest(F.col("base") + F.col("k"), F.coalesce("peak_before", F.col("base") + F.col("k")))
    return joined.groupBy(*by).agg(F.min(F.col("base") + F.col("c") - peak).alias("dd"))


def signal_risk(hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row per signal of ``thresholds``: triggers, one-slot hit rate, Sharpe proxy, drawdown, binomial p, overfit flag.

    ``hits`` holds the first horizon's return as the first element of ``ahead``. A signal
    that never triggers has nulls and p 1; one return alone has neither Sharpe nor drawdown.
    """
    found = hits.select("signal", "symbol", "date", F.element_at("ahead", 1).alias("ret"))
    n = F.count("ret")
    each = found.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n_triggers"), F.avg(F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)).alias("hit_rate"),
        F.when(n > 1, F.avg("ret") / (F.stddev_pop("ret") + 1e-10) * (252 ** 0.5)).alias("sharpe"), n.alias("known"))
    falls = additive_drawdown(found.where(F.col("ret").isNotNull()), ("signal",))
    full = thresholds.join(each, "signal", "left").join(falls, "signal", "left").fillna(0, ["n_triggers"])
    p = binomial_tail(F.floor(F.col("hit_rate") * F.col("n_triggers")), F.col("n_triggers"))
    return full.select(
        "signal", "threshold", F.col("ic_ir").alias("train_ic_ir"), "n_triggers", "hit_rate", "sharpe",
        F.when(F.col("known") > 1, F.col("dd")).alias("max_drawdown"), F.coalesce(p, F.lit(1.0)).alias("p_value"),
        F.coalesce((F.abs("ic_ir") > 0.1) & (F.col("hit_rate") < 0.51), F.lit(False)).alias("overfit"))


# --- buy-and-hold books ------------------------------------------------------------------------------

def top_books(scores: DataFrame, allowed: DataFrame, size: int = 10) -> DataFrame:
    """(signal, symbol, score): the best allowed symbols of each signal on its last date, ties by symbol."""
    last = scores.groupBy("signal").agg(F.max("date").alias("date"))
    rows = scores.join(last, ["signal", "date"]).where(F.col("score").isNotNull()).join(
        allowed.select("symbol"), "symbol", "left_semi")
    place = F.row_number().over(Window.partitionBy("signal").orderBy(F.col("score").desc(), "symbol"))
    return rows.withColumn("place", place).where(F.col("place") <= size).select("signal", "symbol", "score")


def combined_book(books: DataFrame, order) -> DataFrame:
    """(symbol, source, score): every symbol of the books once, from the first signal of ``order`` that holds it."""
    first = F.min_by(F.struct(F.col("signal").alias("source"), "score"), F.array_position(F.array(*map(F.lit, order)), F.col("signal")))
    return books.groupBy("symbol").agg(first.alias("b")).select("symbol", "b.source", "b.score")


def book_totals(held: DataFrame, index: DataFrame, stake: float) -> DataFrame:
    """(book, date, invested, total, benchmark) on days that value a holding; the index starts at the sum invested.

    ``held``: (book, symbol, date, value), one row per holding and market day.
    """
    valued = held.where(F.col("value").isNotNull())
    invested = valued.groupBy("book").agg((F.countDistinct("symbol") * F.lit(stake)).alias("invested"))
    days = valued.groupBy("book", "date").agg(F.sum("value").alias("total")).join(invested, "book").join(
        index.select("date", "close"), "date", "left")
    w = Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # bounded: market days
    return days.select("book", "date", "invested", "total", (
        F.col("invested") * F.last("close", True).over(w) / F.first("close", True).over(w)).alias("benchmark"))


# --- forecasts -------------------------------------------------------------------------------------

def top_n_portfolios(forecasts: DataFrame, actual: DataFrame, sizes, cost: float) -> DataFrame:
    """Per (size, date): mean net return of the N best forecasts that have an outcome."""
    w = Window.partitionBy("date").orderBy(F.col("score").desc(), "symbol")
    ranked = forecasts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(sizes))
    known = ranked.join(actual.where(F.col("actual").isNotNull()), ["symbol", "date"])
    each = known.withColumn("n", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("rn") <= s)))
    net = F.col("actual") - cost
    return each.groupBy("n", "date").agg(F.avg(net).alias("net"), F.count(F.lit(1)).alias("names"), F.count_if(net > 0).alias("wins"))


def equity(portfolios: DataFrame) -> DataFrame:
    """Compounded equity and fractional drawdown per portfolio size over evaluation dates."""
    w = Window.partitionBy("n").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = portfolios.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(w)))
    peak = F.greatest(F.lit(1.0), F.max("equity").over(w))
    return curve.withColumn("drawdown", (F.col("equity") - peak) / (peak + 1e-10))


def portfolio_summary(curve: DataFrame, per_year: float = 252 / 5) -> DataFrame:
    net = F.col("net")
    raw = curve.groupBy("n").agg(
        F.count(net).alias("n_dates"), F.sum("names").alias("n_trades"), (F.sum("wins") / F.sum("names")).alias("hit_rate"),
        F.avg(net).alias("mean_return"), F.stddev_samp(net).alias("sd"), F.max_by("equity", "date").alias("final_equity"),
        F.min("drawdown").alias("max_drawdown"))
    spread = (F.col("n_dates") >= 2) & (F.col("sd") > 0)
    t = F.when(spread, F.col("mean_return") / (F.col("sd") / F.sqrt("n_dates")))
    return raw.withColumns({
        "sharpe": F.when(spread, F.col("mean_return") / F.col("sd") * (per_year ** 0.5)).otherwise(0.0),
        "p_value": F.coalesce(t_tail(t, F.col("n_dates") - 1), F.lit(1.0)),
    }).drop("sd")


def forecast_ic(forecasts: DataFrame, actual: DataFrame, least: int = 10) -> DataFrame:
    """Spearman IC per evaluation date, ties averaged; a date holds one row per symbol."""
    both = forecasts.join(actual.where(F.col("actual").isNotNull()), ["symbol", "date"])
    ranked = both.select("date", average_rank("score", ["date"]).alias("a"), average_rank("actual", ["date"]).alias("b"))
    return ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.nanvl(F.corr("a", "b"), F.lit(None)).alias("ic")).where(F.col("n") >= least)


def forecast_ic_summary(ics: DataFrame, per_year: float = 252 / 5) -> DataFrame:
    raw = ics.agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"))
    t = F.col("mean_ic") / (F.col("std_ic") / F.sqrt("n_dates"))
    return raw.withColumns({
        "ic_ir": F.when(F.col("std_ic") > 0, F.col("mean_ic") / F.col("std_ic") * (per_year ** 0.5)),
        "t_stat": F.when(F.col("std_ic") > 0, t),
    }).withColumn("p_value", t_tail(F.col("t_stat"), F.col("n_dates") - 1))
