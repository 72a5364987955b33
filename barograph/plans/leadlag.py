"""Lead-lag correlation of every ordered pair of one group, with FDR and stability.

Industry and sub-period are grouping columns, so one job serves all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions.stats import correlation_t, pearson_from_sums, t_tail
from barograph.operators.calendar import equal_slices
from barograph.operators.ranking import adjust_fdr
from barograph.operators.rolling import row_log_return

# Fixed values
MIN_OVERLAP = 30
PERIODS = 5
MAX_LAG = 20
MIN_R = 0.15
ALPHA = 0.05


def adjusted_returns(bars: DataFrame, members: DataFrame, index: DataFrame | None) -> DataFrame:
    """(industry, symbol, date, t, slots, x): row-adjacent log returns less the index's.

    ``t`` is dense over the dates on which any member of the industry trades and
    ``slots`` their number. Missing values stay missing here; they count as zero later.
    ``index`` has one row per day, ``members`` one per symbol.
    """
    own = bars.select("symbol", "date", "close").join(members.select("symbol", "industry"), "symbol")
    own = own.withColumn("ret", row_log_return("close"))
    if index is not None:
        market = index.select("date", (F.log(F.col("close") / F.lag("close").over(Window.orderBy("date")))).alias("market"))
        own = own.join(F.broadcast(market), "date", "left").withColumn("ret", F.col("ret") - F.col("market"))
    days = own.select("industry", "date").distinct()
    w = Window.partitionBy("industry")
    slots = days.select("industry", "date", (F.row_number().over(w.orderBy("date")) - 1).cast("long").alias("t"),
                        F.count(F.lit(1)).over(w).alias("slots"))
    return own.join(slots, ["industry", "date"]).select("industry", "symbol", "date", "t", "slots", F.col("ret").alias("x"))


def by_period(returns: DataFrame, periods: int = PERIODS) -> DataFrame:
    """Same rows keyed by sub-period, with t and slots counted inside it."""
    total = F.col("slots")
    sliced = returns.withColumn("period", equal_slices(periods, total, F.col("t")))
    start = F.floor(total * F.col("period") / periods)
    end = F.floor(total * (F.col("period") + 1) / periods)
    return sliced.select("industry", "symbol", "date", "period", (F.col("t") - start).alias("t"), (end - start).alias("slots"), "x")


def _block_moments(max_lag: int, chunk: int, keys: list[str]):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        """Moments of one leader block against one follower block over one stretch of slots."""
        base = int(pdf["_chunk"].iloc[0]) * chunk
        slots = int(pdf["slots"].iloc[0])
        side = {}
        for lead, width in ((True, chunk), (False, chunk + max_lag)):
            part = pdf[pdf["_lead"] == lead]
            names, rows = np.unique(part["symbol"].to_numpy(dtype=str), return_inverse=True)
            grid = np.zeros((len(names), width))
            np.add.at(grid, (rows, part["t"].to_numpy() - base), part["x"].to_numpy())
            side[lead] = (names, grid)
        (leaders, a), (followers, b) = side[True], side[False]
        out = []
        for lag in range(1, max_lag + 1):
            width = min(chunk, slots - lag - base)
            if width <= 0 or not len(leaders) or not len(followers):
                continue
            x, y = a[:, :width], b[:, lag:lag + width]
            n, k = len(leaders), len(followers)
            out.append(pd.DataFrame({
                "leader": np.repeat(leaders, k), "follower": np.tile(followers, n), "lag_days": lag,
                "sxy": (x @ y.T).ravel(), "sx": np.repeat(x.sum(1), k), "sxx": np.repeat((x * x).sum(1), k),
                "sy": np.tile(y.sum(1), n), "syy": np.tile((y * y).sum(1), n)}))
        frame = pd.concat(out) if out else pd.DataFrame(
            columns=["leader", "follower", "lag_days", "sxy", "sx", "sxx", "sy", "syy"])
        for key in keys:
            frame[key] = pdf[key].iloc[0]
        frame["slots"] = slots
        return frame

    return kernel


def lagged_moments(returns: DataFrame, by: list[str], max_lag: int = MAX_LAG, block: int = 64, chunk: int = 1024) -> DataFrame:
    """Moments of x_leader[t] and x_follower[t + lag] of every ordered pair, missing as zero.

    Pairs of *rows* are never formed. Symbols fall into blocks of about ``block`` names and
    slots into chunks; one task multiplies one (leader block, follower block, chunk), whose
    size is fixed by these two numbers, and partial moments are added up.
    """
    # every symbol of the group takes part in every stretch of every period, silent ones by a zero
    members = returns.select(*by, "slots").distinct().join(returns.select(by[0], "symbol").distinct(), by[0])
    sizes = members.groupBy(*by).agg(F.ceil(F.countDistinct("symbol") / block).cast("int").alias("_nb"))
    block_of = F.pmod(F.xxhash64("symbol"), F.col("_nb")).cast("int")
    rows = returns.where(F.col("x").isNotNull()).select(*by, "symbol", "t", "slots", "x").join(sizes, by).withColumn("_b", block_of)
    zeros = members.join(sizes, by).select(
        *by, "symbol", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / chunk))).alias("_c"), "slots", "_nb",
        block_of.alias("_b"))

    def with_zeros(place: Column) -> DataFrame:
        return rows.unionByName(zeros.select(*by, "symbol", place.alias("t"), "slots", F.lit(0.0).alias("x"), "_nb", "_b"))

    others = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    lead = with_zeros(F.col("_c") * chunk).select(*by, "symbol", "t", "slots", "x", F.lit(True).alias("_lead"),
                       F.floor(F.col("t") / chunk).alias("_chunk"), F.col("_b").alias("_bl"), others.alias("_bf"))
    first = F.greatest(F.floor((F.col("t") - max_lag) / chunk), F.lit(0))
    reach = with_zeros(F.col("_c") * chunk + 1).where(F.col("t") >= 1).withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col("t") - 1) / chunk))))
    follow = reach.select(*by, "symbol", "t", "slots", "x", F.lit(False).alias("_lead"), "_chunk",
                          others.alias("_bl"), F.col("_b").alias("_bf"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ("leader string, follower string, lag_days int, sxy double, sx double, sxx double, sy double, syy double, "
              + ", ".join(f"{k} {types[k]}" for k in by) + ", slots long")
    parts = lead.unionByName(follow).groupBy(*by, "_chunk", "_bl", "_bf").applyInPandas(
        _block_moments(max_lag, chunk, by), schema)
    return parts.groupBy(*by, "leader", "follower", "lag_days").agg(
        F.first("slots").alias("slots"), *[F.sum(c).alias(c) for c in ("sxy", "sx", "sxx", "sy", "syy")])


def ccf(returns: DataFrame, by: list[str], max_lag: int = MAX_LAG, block: int = 64, chunk: int = 1024) -> DataFrame:
    """r[leader, follower, lag] = Pearson(x_leader[t], x_follower[t + lag]), missing as zero."""
    sums = lagged_moments(returns, by, max_lag, block, chunk)
    n = F.col("slots") - F.col("lag_days")
    r = pearson_from_sums(n, *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])
    return sums.select(*by, "leader", "follower", "lag_days", n.alias("n"), F.when(n >= MIN_OVERLAP, r).otherwise(0.0).alias("r"))


def with_p(pairs: DataFrame) -> DataFrame:
    df = F.col("n") - 2
    return pairs.withColumn("p_value", F.when(df < 2, 1.0).otherwise(t_tail(correlation_t(F.col("r"), F.col("n")), df)))


def tested(pairs: DataFrame, by: list[str]) -> DataFrame:
    """p and FDR over all ordered pairs without the self-pairs."""
    return adjust_fdr(with_p(pairs.where(F.col("leader") != F.col("follower"))), "p_value", by)


def significant(min_r: float, alpha: float) -> Column:
    return (F.abs("r") >= min_r) & (F.col("fdr_p") <= alpha)


def stability(returns: DataFrame, min_r: float, alpha: float, max_lag: int = MAX_LAG) -> DataFrame:
    """Oldest-first bit string of per-period significance, its ones and recency score."""
    keys = ["industry", "leader", "follower", "lag_days"]
    by = ["industry", "period"]
    bits = tested(ccf(by_period(returns), by, max_lag), by).select(*keys, "period", significant(min_r, alpha).cast("int").alias("bit"))
    digit = [F.coalesce(F.max(F.when(F.col("period") == p, F.col("bit"))), F.lit(0)) for p in range(PERIODS)]
    wide = bits.groupBy(*keys).agg(*[d.alias(f"b{p}") for p, d in enumerate(digit)])
    names = [f"b{p}" for p in range(PERIODS)]
    return wide.select(
        *keys, F.concat(*[F.col(b).cast("string") for b in names]).alias("stability"),
        sum((F.col(b) for b in names[1:]), F.col(names[0])).alias("n_stable"),
        sum((F.col(b) * 2 ** p for p, b in enumerate(names) if p), F.col(names[0])).alias("recency_score"))


def pair_table(train: DataFrame, backtest: DataFrame, min_r: float = MIN_R, alpha: float = ALPHA,
               max_lag: int = MAX_LAG) -> DataFrame:
    """Significant triplets with direction, out-of-sample r and stability."""
    keys = ["industry", "leader", "follower", "lag_days"]
    found = tested(ccf(train, ["industry"], max_lag), ["industry"]).where(significant(min_r, alpha))
    later = ccf(backtest, ["industry"], max_lag).select(*keys, F.round("r", 6).alias("backtest_r"))
    return (
        found.join(later, keys, "left").join(stability(train, min_r, alpha, max_lag), keys, "left")
        .select(*keys, F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"),
                F.round("r", 6).alias("train_r"), F.coalesce("backtest_r", F.lit(0.0)).alias("backtest_r"),
                F.round("fdr_p", 8).alias("fdr_p"), "stability", "n_stable", "recency_score"))


def run_metadata(train: DataFrame, pairs: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    per = train.groupBy("industry").agg(
        F.countDistinct("symbol").alias("n_symbols"), F.min("date").alias("train_start"), F.max("date").alias("train_end"))
    found = pairs.groupBy("industry").agg(
        F.count(F.lit(1)).alias("n_significant"), F.count_if(F.col("n_stable") == PERIODS).alias("n_stable"))
    return per.join(found, "industry", "left").fillna(0, ["n_significant", "n_stable"]).withColumn(
        "n_tests", F.col("n_symbols") * (F.col("n_symbols") - 1) * max_lag)


def eligible_industries(symbols: DataFrame, active: DataFrame, least: int = 5) -> DataFrame:
    """Symbols of industries with at least ``least`` active members."""
    rows = symbols.select("symbol", "industry").join(active.select("symbol"), "symbol", "left_semi")
    large = rows.groupBy("industry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(large, "industry", "left_semi")
