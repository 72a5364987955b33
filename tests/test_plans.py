"""Whole analyses: invariants and brute force on small fixtures."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.operators import rolling as R
from barograph.plans import backtests as B
from barograph.plans import discovery as X
from barograph.plans import leadlag as L
from barograph.plans import signals as G


def test_no_lookahead(market):
    from barograph.catalog.rolling import features

    feat = features(market)
    cut = "1997-01-01"
    for signal in G.SIGNALS.values():
        full = {(r.symbol, r.t): r.score for r in signal(feat).where(F.col("date") < cut).collect()}
        short = {(r.symbol, r.t): r.score for r in signal(feat.where(F.col("date") < cut)).collect()}
        assert full == short


def test_unit_rank_range(market):
    from barograph.catalog.rolling import features

    low, high = G.volume_anomaly(features(market)).agg(F.min("score"), F.max("score")).first()
    assert low >= 0 and high <= 1


def test_block_correlation_matches_plain_formula(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(5, 200))
    data[4] = 0.0
    rows = [("g", f"S{i}", t, 200, float(data[i, t])) for i in range(5) for t in range(200) if rng.random() < 0.9 or not data[i].__setitem__(t, 0.0)]
    df = spark.createDataFrame(rows, "industry string, symbol string, t bigint, slots bigint, x double")
    got = {(r.leader, r.follower, r.lag_days): r.r for r in L.ccf(df, ["industry"], 4, block=2, chunk=32).collect()}
    assert len(got) == 100
    for (a, b, lag), r in got.items():
        x, y = data[int(a[1])][:-lag], data[int(b[1])][lag:]
        expected = 0.0 if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1]
        assert r == pytest.approx(expected, abs=1e-9)


def test_stability_invariants(market):
    from barograph.catalog.leadlag import MIN_R, ALPHA, returns

    rows = L.stability(returns(market, "train"), MIN_R, ALPHA, 5).collect()
    assert rows
    for r in rows:
        assert len(r.stability) == 5 and set(r.stability) <= {"0", "1"}
        assert r.n_stable == r.stability.count("1")
        assert r.recency_score == sum(int(b) * 2 ** i for i, b in enumerate(r.stability))


@pytest.mark.parametrize("n, k, spare", [(4, 4, 20), (30, 3, 6)])
def test_principal_factors(spark, n, k, spare):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(80, 3)) * [3, 2, 1] @ rng.normal(size=(3, n)) + 0.1 * rng.normal(size=(80, n)) + 5
    missing = rng.random(base.shape) < 0.05
    base[missing] = 0.0  # a missing value counts as zero
    base[:, n - 1] = 0.0  # and a symbol may have none at all
    names = [f"S{i:02d}" for i in range(n)]
    rows = [(names[i], dt.date(2020, 1, 1) + dt.timedelta(d), None if base[d, i] == 0 else float(base[d, i])) for d in range(80) for i in range(n)]
    panel = spark.createDataFrame(rows, "symbol string, date date, returns double")
    scores, explained, loadings, off = X.principal_factors(panel, panel, k, spare=spare, rounds=6)
    values = [r.explained for r in explained.orderBy("factor").collect()]
    centred = base - base.mean(0)
    s = np.linalg.svd(centred, compute_uv=False) ** 2
    assert values == pytest.approx(list((s / s.sum())[:k]), abs=1e-9)
    m = np.zeros((n, k))
    for r in loadings.collect():
        m[names.index(r.symbol), r.factor - 1] = r.loading
    assert np.allclose(m.T @ m, np.eye(k), atol=1e-8) and all(m[abs(m[:, j]).argmax(), j] > 0 for j in range(k))
    cov = centred.T @ centred / 79
    assert np.allclose(cov @ m, m * np.diag(m.T @ cov @ m), atol=1e-5 * np.trace(cov)) and off.max() < 1e-4 * np.trace(cov)
    got = {(r.date, r.factor): r.score for r in scores.collect()}
    want = base @ m
    assert all(got[dt.date(2020, 1, 1) + dt.timedelta(d), j + 1] == pytest.approx(want[d, j], abs=1e-8) for d in range(80) for j in range(k))


def test_grid_sweep_equals_single_runs(spark):
    rng = np.random.default_rng(11)
    panel = spark.createDataFrame(
        [(f"S{s}", t, dt.date(2020, 1, 1) + dt.timedelta(t), float(5 + rng.random()), float(5 + rng.random())) for s in range(4) for t in range(80) if rng.random() < 0.9],
        "symbol string, t bigint, date date, open double, close double")
    pairs = spark.createDataFrame(
        [("g", f"S{a}", f"S{b}", lag, round(float(rng.random()), 3), round(float(rng.random()), 3)) for a in range(4) for b in range(4) for lag in (1, 2, 5) if a != b],
        "industry string, leader string, follower string, lag_days int, train_r double, backtest_r double")
    grid = dict(train_grid=(0.2, 0.5), backtest_grid=(0.1, 0.6), lag_grid=(1, 2))
    swept = {(r.min_train_r, r.min_backtest_r, r.min_lag_days): r for r in B.grid_sweep(pairs, panel, **grid).collect()}
    assert len(swept) == 8
    configs = [B.PairConfig(f"{a}|{b}|{l}", a, b, l, True, True) for a in (0.2, 0.5) for b in (0.1, 0.6) for l in (1, 2)]
    from barograph.operators import ledger

    single = {r.config: r for r in ledger.summary(B.pair_ledger(B.pair_candidates(B.qualifying(pairs, configs), panel, 5)), ["config"]).collect()}
    for (a, b, l), r in swept.items():
        s = single.get(f"{a}|{b}|{l}")
        assert r.n_trades == (s.n_trades if s else 0)
        assert r.end_balance == pytest.approx(s.end_balance if s else 50000.0)


def test_catalogues_are_complete():
    assert [c.id for c in B.PAIR_CONFIGS] == ["v1", "v2", "v3", "v5", "v4", "v6", "v7", "v8"]
    assert len(B.FACTOR_CONFIGS) == 13 and len(B.TRAIN_R_GRID) * len(B.BACKTEST_R_GRID) * len(B.LAG_GRID) == 729
    assert R.slots(20) is not None


@pytest.mark.parametrize("chunk", [32, 1024])
def test_lead_lag_with_silent_symbols(spark, chunk):
    """Listed late, delisted early, traded briefly, never a return: every ordered pair has its sums."""
    rng = np.random.default_rng(0)
    x, live = rng.normal(size=(5, 200)), np.ones((5, 200), bool)
    live[1, :90] = live[2, 70:] = live[3, :100] = live[3, 140:] = live[4] = False
    rows = [("I", f"s{i}", t, 200, float(x[i, t]) if live[i, t] else None)
            for i in range(5) for t in range(200) if live[i, t] or (i, t) == (4, 3)]
    frame = spark.createDataFrame(rows, "industry string, symbol string, t long, slots long, x double")
    got = {(r["leader"], r["follower"], r["lag_days"]): r for r in L.lagged_moments(
        frame, ["industry"], 3, 64, chunk).collect()}
    z = np.where(live, x, 0)
    assert len(got) == 75
    for (i, j, k), r in got.items():
        a, b = z[int(i[1]), :200 - k], z[int(j[1]), k:]
        assert np.allclose([r[c] for c in ("sxy", "sx", "sxx", "sy", "syy")], [a @ b, a.sum(), a @ a, b.sum(), b @ b])


def _scores(spark, rows):
    return spark.createDataFrame(rows, "signal string, symbol string, date date, score double")


def test_books_and_their_combination(spark):
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    scores = _scores(spark, [
        ("a", "X", d1, 1.0), ("a", "Y", d2, 0.5), ("a", "Z", d2, 0.5), ("a", "W", d2, None), ("a", "V", d2, 0.9),
        ("b", "Z", d1, 0.1), ("b", "Q", d1, 0.7), ("b", "Y", d1, 0.2)])
    allowed = spark.createDataFrame([(s,) for s in "XYZWQ"], "symbol string")
    books = B.top_books(scores, allowed, 2)
    assert {(r.signal, r.symbol) for r in books.collect()} == {("a", "Y"), ("a", "Z"), ("b", "Q"), ("b", "Y")}
    one = {r.symbol: (r.source, r.score) for r in B.combined_book(books, ["b", "a"]).collect()}
    assert one == {"Q": ("b", 0.7), "Y": ("b", 0.2), "Z": ("a", 0.5)}
    assert B.top_books(scores.where("false"), allowed).count() == 0


def test_book_totals(spark):
    days = [dt.date(2020, 1, k) for k in (1, 2, 3)]
    held = spark.createDataFrame(
        [("b", "X", days[0], 100.0), ("b", "X", days[1], 110.0), ("b", "Y", days[0], None), ("b", "Y", days[1], 100.0), ("c", "Y", days[2], 90.0)],
        "book string, symbol string, date date, value double")
    index = spark.createDataFrame([(days[0], 50.0), (days[2], 60.0)], "date date, close double")
    got = [(r.book, r.date, r.invested, r.total, r.benchmark) for r in B.book_totals(held, index, 100.0).orderBy("book", "date").collect()]
    assert got == [("b", days[0], 200.0, 100.0, 200.0), ("b", days[1], 200.0, 210.0, 200.0), ("c", days[2], 100.0, 90.0, 100.0)]


def test_signal_risk_of_silent_and_single_signals(spark):
    day = [dt.date(2020, 1, k) for k in range(1, 6)]
    hits = spark.createDataFrame(
        [("a", "X", day[0], [0.1]), ("a", "X", day[1], [-0.3]), ("a", "Y", day[0], [0.1]), ("a", "Y", day[1], [None]), ("one", "X", day[0], [0.2])],
        "signal string, symbol string, date date, ahead array<double>")
    fitted = spark.createDataFrame([("a", 0.2, 0.8), ("one", None, 0.7), ("silent", 0.3, 0.8)], "signal string, ic_ir double, threshold double")
    got = {r.signal: r for r in B.signal_risk(hits, fitted).collect()}
    assert got["a"].n_triggers == 4 and got["a"].hit_rate == pytest.approx(2 / 3) and not got["a"].overfit
    assert got["a"].max_drawdown == pytest.approx(-0.3)
    assert got["one"].n_triggers == 1 and got["one"].sharpe is None and got["one"].max_drawdown is None
    assert got["silent"].n_triggers == 0 and got["silent"].p_value == 1.0 and got["silent"].hit_rate is None


@pytest.mark.parametrize("by", [(), ("signal",)])
def test_additive_drawdown(spark, by):
    rng = np.random.default_rng(2)
    rows = [(s, f"S{k}", dt.date(2020, 1, 1 + t), float(rng.normal())) for s in "ab" for k in range(5) for t in range(8)]
    want = {}
    for key in ("a", "b"):
        curve = np.cumsum([r[3] for r in rows if r[0] == key])
        want[key] = (curve - np.maximum.accumulate(curve)).min()
    frame = spark.createDataFrame(rows, "signal string, symbol string, date date, ret double")
    if by:
        got = {r.signal: r.dd for r in B.additive_drawdown(frame, by).collect()}
        assert got == pytest.approx(want)
    else:
        for key, low in want.items():
            assert B.additive_drawdown(frame.where(F.col("signal") == key)).first().dd == pytest.approx(low)


def test_table_version(spark, tmp_path):
    from barograph.sources.sinks import table_version

    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = table_version(spark, path, "setting 1")
    assert first == table_version(spark, path, "setting 1") != table_version(spark, path, "setting 2")
    spark.range(9).write.mode("append").parquet(path)
    assert table_version(spark, path, "setting 1") != first


def _reads_lines(df):
    return "l_shipdate" in df._jdf.queryExecution().optimizedPlan().toString()


def test_returns_of_pairs_read_written_prices(spark, market, monkeypatch):
    """Members, own prices and the index each joined all lines anew, in both spans."""
    from barograph.catalog import leadlag

    cut, seen = leadlag.cut_lineage, []
    monkeypatch.setattr(leadlag, "cut_lineage", lambda df: seen.append(_reads_lines(df)) or cut(df))
    for part in ("train", "backtest"):
        leadlag.returns(market, part)
    assert seen == [False, False]


def test_candidates_read_written_prices(spark, market):
    """Signals and exits each joined all lines anew."""
    from barograph.catalog import ledgers

    assert not _reads_lines(ledgers.candidates(market))


def test_recommendations_read_written_prices(spark):
    """The last day, its signals and the followers' closes each joined all lines anew."""
    from barograph import catalog
    from conftest import FOLDER

    assert not _reads_lines(catalog.queries()["bkt_09"](spark, FOLDER))


def test_option_rows_move_once(market):
    """Bars, options and the windows behind them moved the lines by part, supplier, option and underlying in turn."""
    from barograph.catalog import warrants

    bars = market.option_bars.withColumnRenamed("symbol", "option_symbol")
    want = bars.join(market.options.drop("fetched_at"), "option_symbol")
    got = market.option_days.where("close is not null").select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 1000
    moved = re.findall(r"Exchange hashpartitioning\((\w+)", warrants.scored(market)._jdf.queryExecution().executedPlan().toString())
    assert 1 <= moved.count("option_symbol") <= 2  # of lines, and of parts that are joined to them
    assert set(moved) <= {"option_symbol", "symbol", "date"}  # the others are of the underlyings' days


def test_option_days_with_unknown_suppliers(spark, tmp_path):
    """A line without a known supplier makes no price, but an option is its first supplier's and lasts to its last line."""
    from barograph.sources.market import Market

    day = lambda k: dt.datetime(1996, 1, k)
    lines = [(1, 3, 10, 2.0, 0.1, "N", day(1)), (2, 3, 11, 1.0, 0.0, "R", day(1)), (499, 3, 99, 1.0, 0.0, "N", day(2)), (3, 3, 12, 4.0, 0.0, "N", day(3)),
             (4, 5, 2, 1.0, 0.0, "N", day(1)), (5, 5, 10, 1.0, 0.0, "N", day(4)), (6, 77, 10, 1.0, 0.0, "N", day(1)), (7, None, 10, 1.0, 0.0, "N", day(1)), (8, 4, None, 1.0, 0.0, "N", day(1))]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string, l_shipdate timestamp"),
        "part": ([(3, 100.0), (4, 50.0), (5, 10.0)], "p_partkey long, p_retailprice double"),
        "supplier": ([(10, 1), (11, 2), (12, 1), (13, 8)], "s_suppkey long, s_nationkey long"),
        "nation": ([(1, "A"), (2, "B")], "n_nationkey long, n_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, Market(spark, str(tmp_path)).option_days.collect()), key=str)
    end = dt.date(1996, 1, 3) + dt.timedelta(90)
    assert got == [("P3OD", dt.date(1996, 1, 1), 0.05 * 280 / 3, "A", end, 100.0, "C"), ("P3OD", dt.date(1996, 1, 2), None, "A", end, 100.0, "C"),
                   ("P3OD", dt.date(1996, 1, 3), 5.0, "A", end, 100.0, "C")]
