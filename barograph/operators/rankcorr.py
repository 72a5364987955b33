"""Rank correlation of columns over all rows, for groups of any size.

Average ranks of hundreds of millions of rows by a table of values, joined back to the rows,
move every row many times over. Here rows carry no names: a row is its values as integers,
packed by the hundred thousand. They move once to the range of their x, where their rank is
found, and (y, rank of x) moves once to the range of y, where the products are summed. Ranges
come from a sample of values; the rows in and between their bounds are counted before
anything moves, so that each range knows the ranks it starts from, and a value that is a
bound (any value with more rows than a range holds is one) has its rank from these counts
alone and may be dealt to any range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.session import write_once

RANGE_ROWS = 250_000  # of a range, about
PACKED_ROWS = 1 << 20  # that are dealt out together
SAMPLE_ROWS = 200_000  # that bounds are drawn from; they decide who ranks a row, not its rank
NONE = np.iinfo(np.int64).min


def _slots(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2k: strictly below bound k and above the one before; 2k + 1: equal to bound k."""
    at = np.searchsorted(bounds, values)
    if not len(bounds):
        return at
    return 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == values)


def _columns(batch: pd.DataFrame, names: list[str]) -> list[np.ndarray]:
    return [batch[c].to_numpy(np.int64) for c in names]


def _gathered(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if rows:
        yield pd.concat(held, ignore_index=True)


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range that occurs in ``to``, with the places of its rows."""
    order = np.argsort(to, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]])[:len(to)])
    for a, b in zip(start, [*start[1:], len(to)], strict=False):
        yield int(to[order[a]]), order[a:b]


class _Ranks:
    """Doubled average ranks of one column in one pair's rows, from ``counts`` by slot."""

    def __init__(self, bounds: np.ndarray, counts: np.ndarray):
        self.bounds, self.counts = bounds, counts
        self.before = np.cumsum(counts) - counts

    def of_bounds(self, slots: np.ndarray) -> np.ndarray:
        return 2 * self.before[slots] + self.counts[slots] + 1

    def of(self, values: np.ndarray) -> np.ndarray:
        """Of rows that are all of a slot's, or of a bound."""
        slots = _slots(values, self.bounds)
        out = self.of_bounds(slots)
        inner = slots % 2 == 0
        if inner.any():
            _, index, times = np.unique(values[inner], return_inverse=True, return_counts=True)
            out[inner] = 2 * (self.before[slots[inner]] + (np.cumsum(times) - times)[index]) + times[index] + 1
        return out


SUMS = "xy double, xx double, yy double, rows long, total double, squares double"


def rank_correlations(df: DataFrame, xs: list[str], ys: list[str], digits: int = 8, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(x, y, n, ic, spread) of each pair of columns that share rows: the Spearman correlation over the rows that
    hold both, ties averaged, and the sample deviation of x in them. Values equal to ``digits`` decimals tie.

    Values times 10 ** ``digits`` must fit 53 bits. No correlation (null) without variation.
    """
    spark, scale = df.sparkSession, 10.0 ** digits
    codes = df.select(*[F.round(F.round(c, digits) * scale).cast("long").alias(c) for c in [*xs, *ys]]).where(
        F.coalesce(*xs).isNotNull() & F.coalesce(*ys).isNotNull()).fillna(NONE)
    rows = write_once(codes)

    known = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c) != NONE).alias(c) for c in [*xs, *ys]],
                     *[F.max(F.when(F.col(c) != NONE, F.abs(c))).alias(f"most {c}") for c in [*xs, *ys]]).first().asDict()
    drawn = rows.sample(min(1.0, SAMPLE_ROWS / max(known["rows"], 1)), 7).limit(2 * SAMPLE_ROWS).toPandas()
    bounds = {}
    for c in [*xs, *ys]:
        held = np.sort(drawn[c].to_numpy(np.int64)[drawn[c].to_numpy(np.int64) != NONE])
        parts = known[c] // range_rows + 1
        bounds[c] = np.unique(held[len(held) * np.arange(1, parts) // parts]) if len(held) else held
    small = max(known[f"most {c}"] or 0 for c in [*xs, *ys]) < 2**31 - 1
    kind = np.int32 if small else np.int64
    none = np.iinfo(kind).min
    pairs = [(x, y) for x in range(len(xs)) for y in range(len(ys))]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in _gathered(batches, PACKED_ROWS):
            x, y = _columns(batch, xs), _columns(batch, ys)
            at = {c: _slots(v, bounds[c]) for c, v in zip([*xs, *ys], [*x, *y], strict=True)}
            for p, (i, j) in enumerate(pairs):
                both = (x[i] != NONE) & (y[j] != NONE)
                for side, c in enumerate((xs[i], ys[j])):
                    new = np.bincount(at[c][both], minlength=2 * len(bounds[c]) + 1)
                    total[p, side] = total[p, side] + new if (p, side) in total else new
        for (p, side), held in total.items():
            slot = np.flatnonzero(held)
            yield pd.DataFrame({"pair": p, "side": side, "slot": slot, "rows": held[slot]})

    counts = {(p, side): np.zeros(2 * len(bounds[c]) + 1, np.int64) for p, (i, j) in enumerate(pairs) for side, c in enumerate((xs[i], ys[j]))}
    # ranges are a few hundred thousand rows each, so their counts are few
    for r in rows.mapInPandas(count, "pair int, side int, slot long, rows long").groupBy("pair", "side", "slot").agg(
            F.sum("rows").alias("rows")).collect():
        counts[r["pair"], r["side"]][r["slot"]] = r["rows"]
    many = {key: int(held.sum()) for key, held in counts.items()}

    def by_x(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _gathered(batches, PACKED_ROWS):
            x, y = _columns(batch, xs), _columns(batch, ys)
            some = np.zeros(len(batch), bool)
            for v in y:
                some |= v != NONE
            y = [np.where(v == NONE, none, v).astype(kind) for v in y]
            out = []
            for i, c in enumerate(xs):
                rows_of = np.flatnonzero(some & (x[i] != NONE))
                slots = _slots(x[i][rows_of], bounds[c])
                # bounds' own rows need no company: they are dealt out evenly
                to = np.where(slots % 2 == 1, np.arange(len(slots)) % (len(bounds[c]) + 1), slots // 2)
                for part, places in _dealt(to):
                    places = rows_of[places]
                    out.append((i, part, x[i][places].astype(kind).tobytes(), b"".join(v[places].tobytes() for v in y)))
            yield pd.DataFrame(out, columns=["x", "part", "xs", "ys"]).astype({"x": "int32", "part": "int32"})

    def rank_x(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        x = np.frombuffer(b"".join(group["xs"]), kind).astype(np.int64)
        blobs = [np.frombuffer(b, kind).reshape(len(ys), -1) for b in group["ys"]]
        held = np.concatenate(blobs, axis=1)
        out, none_sent = [], (b"", b"")
        for j in range(len(ys)):
            p = i * len(ys) + j
            both = held[j] != none
            if not both.any():
                continue
            value, y, n = x[both], held[j][both].astype(np.int64), many[p, 0]
            rank = _Ranks(bounds[xs[i]], counts[p, 0]).of(value)
            off = (rank - (n + 1)).astype(np.float64)
            slots = _slots(y, bounds[ys[j]])
            bound = slots % 2 == 1
            ranks_y = _Ranks(bounds[ys[j]], counts[p, 1])
            off_y = (ranks_y.of_bounds(slots[bound]) - (n + 1)).astype(np.float64)
            real = value / scale
            out.append((p, -1, *none_sent, float(off[bound] @ off_y), float(off @ off), float(off_y @ off_y), len(value),
                        float(real.sum()), float(real @ real)))
            rank = rank[~bound].astype(np.uint32 if n < 2**31 - 1 else np.uint64)
            y, to = y[~bound].astype(kind), slots[~bound] // 2
            out += [(p, part, y[at].tobytes(), rank[at].tobytes(), 0.0, 0.0, 0.0, 0, 0.0, 0.0) for part, at in _dealt(to)]
        return pd.DataFrame(out, columns=["pair", "part", "ys", "ranks", "xy", "xx", "yy", "rows", "total", "squares"])

    def rank_y(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        p, part = int(key[0]), int(key[1])
        sums = group[["xy", "xx", "yy", "rows", "total", "squares"]].sum()
        if part >= 0:
            n = many[p, 1]
            y = np.frombuffer(b"".join(group["ys"]), kind).astype(np.int64)
            off = np.frombuffer(b"".join(group["ranks"]), np.uint32 if n < 2**31 - 1 else np.uint64).astype(np.float64) - (n + 1)
            off_y = (_Ranks(bounds[ys[pairs[p][1]]], counts[p, 1]).of(y) - (n + 1)).astype(np.float64)
            sums["xy"], sums["yy"] = float(off @ off_y), float(off_y @ off_y)
        return pd.DataFrame([[p, *sums]], columns=["pair", "xy", "xx", "yy", "rows", "total", "squares"]).astype({"rows": "int64"})

    ranked = rows.mapInPandas(by_x, "x int, part int, xs binary, ys binary").groupBy("x", "part").applyInPandas(
        rank_x, f"pair int, part int, ys binary, ranks binary, {SUMS}")
    sums = ranked.groupBy("pair", "part").applyInPandas(rank_y, f"pair int, {SUMS}").groupBy("pair").agg(
        *[F.sum(c).alias(c) for c in ("xy", "xx", "yy", "rows", "total", "squares")])
    names = F.broadcast(spark.createDataFrame([(p, xs[i], ys[j]) for p, (i, j) in enumerate(pairs)], "pair int, x string, y string"))
    apart = F.greatest(F.col("squares") - F.col("total") * F.col("total") / F.col("rows"), F.lit(0.0))
    return sums.join(names, "pair").select(
        "x", "y", F.col("rows").alias("n"),
        F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt("xx") / F.sqrt("yy")).alias("ic"),
        F.when(F.col("rows") > 1, F.sqrt(apart / (F.col("rows") - 1))).alias("spread"))
