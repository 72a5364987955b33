"""Operators against plain restatements of their definition."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barograph.operators import ledger, rolling
from barograph.operators.ranking import adjust_fdr, running_total_by_day, value_at_shares, with_average_rank, with_global_rank


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(3):
        for t in range(60):
            if rng.random() < 0.15:
                continue
            x = None if rng.random() < 0.1 else (1.5 if s == 2 else float(rng.normal()))
            rows.append((f"S{s}", t, x))
    return rows, spark.createDataFrame(rows, "symbol string, t bigint, x double")


def slots(rows, symbol, t, window):
    have = {r[1]: r[2] for r in rows if r[0] == symbol}
    return [have.get(u) for u in range(t - window + 1, t + 1)]


@pytest.mark.parametrize("window", [5, 12])
def test_calendar_windows(panel, window):
    rows, df = panel
    got = df.select("symbol", "t", "x", rolling.zscore_fast("x", window).alias("fast"), rolling.zscore_strict("x", window).alias("strict"),
                    rolling.slope_strict("x", window).alias("slope"), rolling.sum_zero_filled("x", window).alias("total")).collect()
    for r in got:
        w = slots(rows, r.symbol, r.t, window)
        filled = np.array([0.0 if v is None else v for v in w])
        if r.x is None or r.t < window - 1:
            assert r.fast is None
        else:
            std = np.sqrt(max((filled ** 2).mean() - filled.mean() ** 2, 0))
            assert r.fast == pytest.approx((r.x - filled.mean()) / max(std, 1e-8), abs=1e-6)
        assert r.total == (None if r.t < window else pytest.approx(filled.sum(), abs=1e-9))
        if any(v is None for v in w):
            assert r.strict is None and r.slope is None
        else:
            line = np.linspace(-1, 1, window)
            assert r.slope == pytest.approx((line * (filled - filled.mean())).sum() / (line ** 2).sum(), abs=1e-9)
            std = filled.std(ddof=1)
            assert r.strict == (None if std <= 1e-8 else pytest.approx((filled[-1] - filled.mean()) / std, abs=1e-9))


def bh(p):
    order = np.argsort(p)
    n, out, best = len(p), np.empty(len(p)), 1.0
    for rank in range(n, 0, -1):
        best = min(best, p[order[rank - 1]] * n / rank)
        out[order[rank - 1]] = best
    return out


def test_fdr_with_hot_value(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random(300) ** 4, np.ones(200), [0.0, 0.25, 0.25]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double")
    got = {r.i: r.fdr_p for r in adjust_fdr(df, "p").collect()}
    assert np.allclose([got[i] for i in range(len(p))], bh(p), atol=1e-12)
    ordered = [got[i] for i in np.argsort(p, kind="stable")]
    assert all(a <= b + 1e-15 for a, b in zip(ordered, ordered[1:]))


def test_global_ranks(spark):
    values = [random.Random(i).choice([-3.5, -1e-9, 0.0, 2.0, 2.0, 7.25, 1e9]) + (i % 3) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    ranked = {r.i: r["rank"] for r in with_global_rank(df, "v", ["i"]).collect()}
    expected = {i: k + 1 for k, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert ranked == expected
    cuts = value_at_shares(df, "v", {"p60": 0.6}).first()
    assert cuts.p60 == sorted(values)[int(200 * 0.6) - 1]


def test_average_rank(spark):
    values = [5.0, -2.0, 5.0, 0.0, -2.0, -2.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    got = {r.i: r.a for r in with_average_rank(df, "v", ["g"], "a").collect()}
    assert got == {0: 5.5, 2: 5.5, 3: 4.0, 1: 2.0, 4: 2.0, 5: 2.0}


def test_running_total(spark):
    rows = [("a", d, k, float(d + k)) for d in range(4) for k in range(3)]
    df = spark.createDataFrame(rows, "c string, d int, k int, v double")
    got = [r.s for r in running_total_by_day(df, ["c"], "d", ["k"], "v", "s").orderBy("d", "k").collect()]
    assert got == list(np.cumsum([r[3] for r in rows]))


def greedy(rows):
    busy, taken = {}, set()
    for key, begin, order, end in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if begin >= busy.get(key, -1):
            taken.add((key, begin, order))
            busy[key] = max(busy.get(key, -1), end)
    return taken


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_non_overlapping(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), b := rng.randrange(60), i, b + rng.choice([0, 0, 1, 4, 9])) for i in range(300)]
    rows += [("hot", rng.randrange(20), 1000 + i, 0) for i in range(200)]
    rows = [(k, b, o, max(b, e)) for k, b, o, e in rows]
    df = spark.createDataFrame(rows, "k string, b bigint, o int, e bigint")
    for span in (7, 1024):
        got = {(r.k, r.b, r.o) for r in ledger.non_overlapping(df, ["k"], "b", "e", ["o"], span).collect()}
        assert got == greedy(rows)


def test_accepted_slots_of_a_hot_key(spark):
    """One key with a million slots: chunks share the work, and the walk is the plain one."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("b"), (F.col("id") + F.pmod(F.xxhash64("id"), F.lit(40))).alias("u"))
    got = {r.b for r in ledger.accepted_slots(rows, ["k"], "b", "u").select("b").toLocalIterator()}
    until = np.array([r.u for r in rows.select("u").orderBy("b").toLocalIterator()])
    at, want = 0, set()
    while at < n:
        want.add(at)
        at = max(at + 1, int(until[at]))
    assert got == want


def test_accepted_slots_of_many_short_keys(spark):
    """Keys by the ten thousand: their chunks share a batch, none is a call of its own."""
    n = 30_000
    rows = spark.range(n * 8).select(F.concat(F.lit("w"), F.col("id") % n).alias("k"), F.floor(F.col("id") / n).alias("j"),
                                     F.pmod(F.xxhash64("id"), F.lit(5)).alias("r")).where("r > 0").select(
        "k", (F.col("j") * 3 - 5).alias("b"), (F.col("j") * 3 - 5 + F.col("r") * 2 - 1).alias("u"))
    frame = ledger.accepted_slots(rows, ["k"], "b", "u", 8)
    assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().toString()
    got = {tuple(r) for r in frame.collect()}
    busy, want = {}, set()
    for k, b, u in sorted(map(tuple, rows.collect())):
        if b >= busy.get(k, b):
            want.add((k, b))
            busy[k] = max(busy.get(k, b), u)
    assert got == want and len(want) > n


def test_tails_over_non_null_values(spark):
    from barograph.operators.rolling import with_tails

    rng = random.Random(6)
    rows = [(k, t, None if rng.random() < rate else (5.0 if k == "flat" else rng.gauss(0, 1)))
            for k, rate in (("a", 0.1), ("b", 0.6), ("c", 0.97), ("flat", 0.2)) for t in range(160)]
    df = spark.createDataFrame(rows, "symbol string, date int, x double")
    got = {(r.symbol, r.date): r for r in with_tails(df, {"z": ("zscore", "x", 25, 20), "z5": ("zscore", "x", 25, 5), "s": ("slope", "x", 25, 20)}).collect()}
    for k in ("a", "b", "c", "flat"):
        values = [v for name, _, v in rows if name == k]
        for t in range(160):
            held = [v for v in values[max(0, t - 24):t + 1] if v is not None]
            for out, keep in (("z", 20), ("z5", 5), ("s", 20)):
                v = np.array(held[-keep:])
                if len(v) < 2 or (out != "s" and v.std() < 1e-12):
                    want = None
                else:
                    want = (v[-1] - v.mean()) / v.std() if out != "s" else np.polyfit(np.arange(len(v)), v, 1)[0]
                assert got[k, t][out] == (None if want is None else pytest.approx(want, abs=1e-9))


def test_ranges_follow_the_rows(spark):
    """A value held by nine rows of ten costs one row, and a dense octave is cut like any other stretch."""
    from barograph.operators.ranking import value_ranks

    hot = spark.range(90_000).select(F.lit(1.5).alias("v"))
    dense = spark.range(10_000).select((1 + F.col("id") / 1e7).alias("v"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would else be one range
    spark.conf.set(coalesce, "false")
    try:
        ranks = value_ranks(hot.unionByName(dense), ["v"]).collect()
    finally:
        spark.conf.unset(coalesce)
    assert len(ranks) == 10_001
    by = {}
    for r in ranks:
        by[r["_range"]] = by.get(r["_range"], 0) + 1
    assert len(by) >= 4 and max(by.values()) < 0.5 * len(ranks)
    at = {r["v"]: (r["_before"], r["_n"], r["_total"]) for r in ranks}
    assert at[1.5] == (10_000, 90_000, 100_000) and at[1.0] == (0, 1, 100_000) and at[1 + 9_999 / 1e7] == (9_999, 1, 100_000)


def test_ranks_of_nulls_and_groups(spark):
    rows = [("g", 1, None), ("g", 2, 3.0), ("h", 3, -0.0), ("h", 4, 0.0), (None, 5, 2.0), (None, 6, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {r.i: r.a for r in with_average_rank(df, "v", ["g"], "a").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 1.5, 4: 1.5, 5: 2.0, 6: 1.0}
    fdr = {r.i: r.fdr_p for r in adjust_fdr(df.withColumn("v", F.col("v") / 10), "v", ["g"]).collect()}
    assert fdr == pytest.approx({1: 1.0, 2: 0.6, 3: 0.0, 4: 0.0, 5: 0.2, 6: 0.2})


def test_exercise_adjustment(spark):
    from barograph.catalog.scalars import adjusted_exercises

    cases = [
        ("A", "SA", 0.028, "2026-05-30", [("2026-06-02", 0.02)], 1.40),
        ("B", "SB", 0.006, "2026-05-23", [("2026-05-31", 0.0285714285714286)], 0.21),
        ("C", "SC", 2.00, "2026-01-01", [("2026-06-01", 2.0)], 1.00),
        ("D", "SD", 1.00, "2026-06-10", [("2026-06-01", 0.1)], None),
        ("E", "SE", 0.01, "2026-01-01", [("2026-03-01", 0.1), ("2026-06-01", 0.2)], 0.50),
        ("F", "SF", 1.00, "2026-06-01", [], None),
        ("G", "SB", 0.002, "2026-05-23", [], 0.07),
        ("H", "SH", 0.5, "2026-06-20", [("2026-06-02", 0.02)], None),
    ]
    options = spark.createDataFrame([c[:4] for c in cases], "option_symbol string, share_symbol string, exercise double, f string").withColumn(
        "fetched_at", F.to_date("f"))
    events = spark.createDataFrame([(c[1], d, r) for c in cases for d, r in c[4]], "symbol string, d string, ratio double").withColumn("date", F.to_date("d"))
    got = {r.option_symbol: r for r in adjusted_exercises(options, events).collect()}
    for name, *_, expected in cases:
        assert (got[name].adjusted if name in got else None) == (None if expected is None else pytest.approx(expected, abs=1e-6))
    assert got["E"].note == "post 1:10 Consolidation, 1:5 Consolidation"
    assert got["C"].note == "post 2:1 Split"


def test_tails_agree_with_sums(spark):
    """Binomial tails against exact sums; t tails against the binomial ones' relation by symmetry and known values."""
    from math import comb

    from barograph.functions.stats import binomial_tail, t_tail

    pairs = [(k, n) for n in (1, 2, 7, 60, 300, 1000) for k in range(0, n + 2, max(1, n // 9))]
    df = spark.createDataFrame(pairs, "k int, n int")
    for r in df.withColumn("p", binomial_tail(F.col("k"), F.col("n"))).collect():
        want = sum(comb(r.n, j) for j in range(max(r.k, 0), r.n + 1)) / 2**r.n
        assert r.p == pytest.approx(want, rel=1e-10, abs=1e-300)
    known = [(1.812461123, 10, 0.1), (2.228138852, 10, 0.05), (-1.959963985, 1e9, 0.05), (636.6192488, 1, 0.001), (3.390, 5000, 0.000704)]
    t = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in known], "t double, n double, p double")
    for r in t.withColumn("got", t_tail(F.col("t"), F.col("n"))).collect():
        assert r.got == pytest.approx(r.p, rel=2e-3 if r.n == 5000 else 1e-6)
    odd = spark.createDataFrame([(1.0, 0.0), (None, 3.0), (1.0, None), (1.0, -2.0)], "t double, n double")
    assert [r.p for r in odd.select(t_tail(F.col("t"), F.col("n")).alias("p")).collect()] == [None] * 4


def test_tails(spark):
    from barograph.functions.stats import binomial_tail, t_tail

    t = spark.createDataFrame([(2.0, 2.0), (1.0, 1.0), (0.0, 9.0), (12.0, 2400.0), (None, 5.0)], "t double, n double")
    got = [r.p for r in t.select(t_tail(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got[0] == pytest.approx(1 - 2 / np.sqrt(6), rel=1e-10)  # closed form for 2 degrees of freedom
    assert got[1] == pytest.approx(0.5, rel=1e-10) and got[2] == 1.0 and got[4] is None
    assert got[3] == pytest.approx(2.92e-32, rel=1e-2)
    b = spark.createDataFrame([(8, 10), (0, 10), (10, 10)], "k int, n int")
    assert [r.p for r in b.select(binomial_tail(F.col("k"), F.col("n")).alias("p")).collect()] == pytest.approx([56 / 1024, 1.0, 1 / 1024])


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_adjusted_p_values_in_one_pass(spark):
    """No frame that ends at the last row: such a frame is summed anew for each row."""
    p = [((k * 7919) % 4001) / 4000 for k in range(4000)]
    frame = spark.createDataFrame(list(enumerate(p)), "i long, p double")
    adjusted = adjust_fdr(frame, "p")
    plan = plan_of(adjusted).lower().replace(" ", "")
    assert "unboundedpreceding" in plan and "currentrow$(),unboundedfollowing" not in plan and "1,unboundedfollowing" not in plan
    least, want = 1.0, {}
    for rank, i in sorted(enumerate(sorted(range(4000), key=p.__getitem__), 1), reverse=True):
        least = want[i] = min(least, p[i] * 4000 / rank)
    assert all(abs(r.fdr_p - want[r.i]) < 1e-12 for r in adjusted.collect())


def test_later_events_travel_to_the_options(spark):
    """Options meet lists of events, so that no row per option and event is grouped."""
    from barograph.catalog.scalars import adjusted_exercises

    day = dt.date(1990, 1, 1)
    options = spark.createDataFrame([(f"P{k}", "A", day + dt.timedelta(k % 3), 0.5 + k / 7) for k in range(20)],
                                    "option_symbol string, share_symbol string, fetched_at date, exercise double")
    ratios = [0.1 if k % 3 else 2.0 for k in range(400)]
    events = spark.createDataFrame([("A", day + dt.timedelta(k), r) for k, r in enumerate(ratios)], "symbol string, date date, ratio double")
    adjusted = adjusted_exercises(options, events)
    assert "Aggregate [option_symbol" not in plan_of(adjusted)
    for r in adjusted.collect():
        k = int(r.option_symbol[1:])
        value = 0.5 + k / 7
        for ratio in ratios[k % 3 + 1:]:
            value /= ratio
            if value < 1e11:
                value = float(Decimal(repr(value)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
        assert r.adjusted == value and r.note.count(",") == 398 - k % 3


def test_later_events_of_options_are_broadcast(spark, market):
    """Options stay spread by their own key and are not gathered by their few underlyings."""
    from barograph import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin [share_symbol" not in plan_of(catalog.queries()["joi_14"](spark, market.folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("range_rows", [7, 250_000])
def test_rank_correlations(spark, range_rows):
    """Against plain average ranks: ties, a hot value, nulls, pairs without rows, ranges of few rows."""
    from barograph.operators.rankcorr import rank_correlations

    rng = np.random.default_rng(3)
    n = 900
    a = rng.normal(size=n)
    columns = {"a": a, "b": np.where(rng.random(n) < 0.7, 0.25, rng.normal(size=n).round(1)), "none": np.full(n, np.nan), "flat": np.full(n, 1.5),
               "f": a * 0.3 + rng.normal(size=n), "g": np.where(rng.random(n) < 0.5, -1e-9, rng.normal(size=n).round(1) * 100)}
    for name in "abfg":
        columns[name][rng.random(n) < 0.2] = np.nan
    columns["g"][:2] = [-30.0, 30.0]  # beyond 4 bytes of hundred millionths
    frame = pd.DataFrame(columns)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame)).repartition(3)
    got = {(r.x, r.y): r for r in rank_correlations(df, ["a", "b", "none", "flat"], ["f", "g"], 8, range_rows).collect()}
    assert set(got) == {(x, y) for x in ("a", "b", "flat") for y in "fg"}
    for (x, y), r in got.items():
        both = frame[[x, y]].round(8).dropna()
        assert r.n == len(both) and r.spread == pytest.approx(both[x].std(), abs=1e-9)
        want = both[x].rank().corr(both[y].rank()) if x != "flat" else None
        assert r.ic is None if want is None else r.ic == pytest.approx(want, abs=1e-12)
    assert rank_correlations(df.where("a > 1e6"), ["a"], ["f"]).collect() == []


def test_rank_correlations_move_packed_rows(spark):
    """Rows moved once a horizon and signal, their counts and ranks beside them; now they move packed, two values at a time."""
    from barograph.plans import warrants as W

    rows = spark.range(4000).select(
        F.concat(F.lit("w"), F.col("id") % 40).alias("option_symbol"), F.date_add(F.lit("1999-01-01").cast("date"), (F.col("id") / 40).cast("int")).alias("date"),
        *[(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0).alias(s) for s in [*W.SIGNALS, "w_ret"]])
    frame = W.pooled_ic(rows, dt.date(2000, 1, 1))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "rangepartitioning" not in plan and "option_symbol" not in plan
    got = {(r.signal, r.horizon): r for r in frame.collect()}
    assert len(got) == 12 and got["delta_drift", "fwd_10"].n == 40 * 90
