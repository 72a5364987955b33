"""Trade ledgers as event-study operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barograph.functions import scalars as S
from barograph.operators.ranking import running_total_by_day
from barograph.session import write_once


SPAN = 1024  # slots of one chunk


def _follow(group: np.ndarray, begin: np.ndarray, until: np.ndarray, span: int) -> np.ndarray:
    """Where a walk goes on from each slot, in its own group: the first that begins when it is over, or the group's end.

    ``begin`` and ``until`` count from the start of the group's chunk, so a single search serves all groups.
    """
    at = np.searchsorted(group * (span + 1) + begin, group * (span + 1) + np.clip(until, 0, span))
    return np.maximum(at, np.arange(1, len(begin) + 1))


def _exits(span: int):
    """Per chunk: its slots and, for a walk that enters at each of them, until when it is busy on leaving.

    Rows come sorted by key, chunk and begin; all chunks of a batch are worked on together.
    """
    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        k, chunk = rows["k"].to_numpy(), rows["chunk"].to_numpy(np.int64)
        begin, until = rows["b"].to_numpy(np.int64), rows["u"].to_numpy(np.int64)
        start = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (k[1:] != k[:-1])]))
        run = np.diff(np.append(start, len(k)))
        group = np.repeat(np.arange(len(start)), run)
        follow = _follow(group, begin - chunk * span, until - chunk * span, span)
        last = np.where(follow >= (start + run)[group], np.arange(len(k)), follow)
        while True:  # each pass doubles the steps taken
            further = last[last]
            if (further == last).all():
                break
            last = further
        ends = start + run
        blobs = ([x[i:j].tobytes() for i, j in zip(start, ends, strict=True)] for x in (begin, until, until[last]))
        return pd.DataFrame(dict(zip(("begins", "untils", "exits"), blobs, strict=True)) | {"k": k[start], "chunk": chunk[start]})[
            ["k", "chunk", "begins", "untils", "exits"]]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            # the last chunk may go on in the next batch
            other = np.flatnonzero((rows["chunk"] != rows["chunk"].iat[-1]) | (rows["k"] != rows["k"].iat[-1]))
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield whole(rows.iloc[:cut])
            held = rows.iloc[cut:]
        if held is not None and len(held):
            yield whole(held)

    return kernel


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of a key in order: only the busy time passes from one to the next."""
    key, busy = None, 0
    for batch in batches:
        k = batch["k"].to_numpy()
        entered = np.fromiter((int.from_bytes(x[:8], "little", signed=True) for x in batch["begins"]), np.int64, len(batch))
        alone = np.append(k[1:] != k[:-1], False)  # the next chunk is another key's
        for i, (begins, exits) in enumerate(zip(batch["begins"], batch["exits"], strict=True)):
            if k[i] != key:
                key = k[i]
                busy = entered[i]
                if alone[i]:
                    continue
            entered[i] = busy
            at = np.searchsorted(np.frombuffer(begins, np.int64), busy)
            if 8 * at < len(begins):
                busy = max(busy, np.frombuffer(exits, np.int64)[at])
        yield batch[["k", "chunk", "begins", "untils"]].assign(busy=entered)


def _walk(span: int):
    """The slots taken in each chunk, by the walks of all chunks of a batch step by step."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            size = np.fromiter(map(len, batch["begins"]), np.int64, len(batch)) // 8
            begin, until = (np.frombuffer(b"".join(batch[c]), np.int64) for c in ("begins", "untils"))
            group, ends = np.repeat(np.arange(len(batch)), size), np.cumsum(size)
            zero = batch["chunk"].to_numpy(np.int64) * span
            follow = _follow(group, begin - zero[group], until - zero[group], span)
            every = np.arange(len(batch))
            at = np.searchsorted(group * (span + 1) + begin - zero[group],
                                 every * (span + 1) + np.clip(batch["busy"].to_numpy(np.int64) - zero, 0, span))
            taken = np.zeros(len(begin), bool)
            while len(at):
                inside = at < ends[every]
                at, every = at[inside], every[inside]
                taken[at] = True
                at = follow[at]
            yield pd.DataFrame({"k": batch["k"].to_numpy()[group[taken]], "b": begin[taken]})

    return kernel


def accepted_slots(slots: DataFrame, key: list[str], begin: str, until: str, span: int = SPAN) -> DataFrame:
    """(key, begin) of the slots a greedy walk takes: the first, then always the next that begins when the last is over.

    ``slots`` has one row per key and ``begin``. A key's time is cut into chunks of ``span``, so
    that a hot key is many tasks' work: each chunk finds, by pointers from slot to slot, when
    a walk entering at any slot leaves it. One pass over the chunks of a key hands the busy
    time on, and every chunk then walks from the entry it was given. Keys by the million have
    few slots each, so a task works on the chunks of a whole batch at once.
    """
    name = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    rows = slots.select(name.alias("k"), F.floor(F.col(begin) / span).cast("long").alias("chunk"), F.col(begin).cast("long").alias("b"),
                        F.col(until).cast("long").alias("u"))
    chunk = "k string, chunk long, begins binary, untils binary"
    chunks = rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "b").mapInPandas(_exits(span), f"{chunk}, exits binary")
    entered = chunks.repartition("k").sortWithinPartitions("k", "chunk").mapInPandas(_entries, f"{chunk}, busy long")
    taken = entered.repartition("k", "chunk").mapInPandas(_walk(span), "k string, b long").toDF("_name", "_begin")
    named = slots.select(*key, begin, name.alias("_named"))
    return named.join(taken, (F.col("_name") == F.col("_named")) & (F.col("_begin") == F.col(begin))).select(*key, begin)


def non_overlapping(candidates: DataFrame, key: list[str], begin: str, end: str, order: list[str], span: int = SPAN) -> DataFrame:
    """Greedy selection per key: a candidate is taken when ``begin >= busy``; ``busy`` then
    becomes its ``end``. Candidates of one key are visited by (begin, order).

    The visit is sequential only between *different* begins. Inside one begin the taken
    candidates are those up to and including the first that lasts beyond the begin, which
    is a map-side minimum. So each key contributes one short record per slot however many
    candidates share it, ``accepted_slots`` walks those, and the taken candidates are found
    by an equi-join.
    """
    candidates = write_once(candidates)  # read twice: for the slots and for the final join
    position = F.struct(*order)
    lasting = F.when(F.col(end) > F.col(begin), position)
    slots = candidates.groupBy(*key, begin).agg(
        F.min(lasting).alias("_stop"), F.coalesce(F.min_by(end, lasting), F.first(begin)).alias("_until"))
    open_slots = accepted_slots(slots, key, begin, "_until", span).join(slots.select(*key, begin, "_stop"), [*key, begin])
    return candidates.join(open_slots, [*key, begin]).where(
        F.col("_stop").isNull() | (position <= F.col("_stop"))).drop("_stop")


def undirected_best(pairs: DataFrame, by: list[str], strength: str, order: list[str]) -> DataFrame:
    """Keeps one direction per unordered pair: the stronger, the first in ``order`` on ties."""
    low, high = F.least("leader", "follower"), F.greatest("leader", "follower")
    w = Window.partitionBy(*by, low, high).orderBy(F.abs(strength).desc(), *order)
    return pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def economics(trades: DataFrame) -> DataFrame:
    """Whole-share sizing, fees, cost, proceeds and profit of each trade."""
    sized = trades.where(F.col("buy_price") > 0).withColumn(
        "shares", S.whole_shares(F.col("buy_price")).cast("long")).where(F.col("shares") >= 1)
    bought, sold = F.col("shares") * F.col("buy_price"), F.col("shares") * F.col("sell_price")
    return sized.withColumns({"cost": bought + S.fee(bought), "proceeds": sold - S.fee(sold)}).withColumn(
        "pnl", F.col("proceeds") - F.col("cost"))


def with_balance(trades: DataFrame, by: list[str], within: list[str], start: float = S.START_BALANCE) -> DataFrame:
    """Balance after each trade in (sell day, within) order."""
    return running_total_by_day(trades, by, "sell_date", within, "pnl", "_run").withColumn(
        "balance_after", F.col("_run") + start).drop("_run")


def daily_balance(trades: DataFrame, by: list[str], start: float = S.START_BALANCE) -> DataFrame:
    """End-of-day balance, running peak and drawdown in percent of the peak."""
    days = trades.groupBy(*by, "sell_date").agg(F.sum("pnl").alias("day_pnl"))
    w = Window.partitionBy(*by).orderBy("sell_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("balance", start + F.sum("day_pnl").over(w)).withColumn(
        "peak", F.greatest(F.lit(start), F.max("balance").over(w))).withColumn(
        "drawdown_pct", (F.col("peak") - F.col("balance")) / F.col("peak") * 100)


def summary(trades: DataFrame, by: list[str], start: float = S.START_BALANCE) -> DataFrame:
    n, total = F.count(F.lit(1)), F.sum("pnl")
    fees = F.sum(F.col("cost") - F.col("shares") * F.col("buy_price") + F.col("shares") * F.col("sell_price") - F.col("proceeds"))
    wins = F.count_if(F.col("pnl") > 0)
    return trades.groupBy(*by).agg(
        n.alias("n_trades"), wins.alias("n_wins"), (n - wins).alias("n_losses"), (wins / n * 100).alias("win_rate"),
        (total / n).alias("avg_trade_pnl"), fees.alias("total_fees"), (total + start).alias("end_balance"),
        (total / start * 100).alias("total_return_pct"))


def daily_risk(trades: DataFrame, by: list[str], start: float = S.START_BALANCE) -> DataFrame:
    """Annualised Sharpe over days with a sale (at least five) and maximum drawdown."""
    days = daily_balance(trades, by, start)
    r = F.col("day_pnl") / start
    return days.groupBy(*by).agg(
        F.when((F.count(F.lit(1)) >= 5) & (F.stddev_pop(r) > 0), F.avg(r) / F.stddev_pop(r) * (252 ** 0.5)).alias("sharpe_ratio"),
        F.max("drawdown_pct").alias("max_drawdown_pct"))
