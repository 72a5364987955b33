"""BKT, JOI-17: trade ledgers and evaluations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from barograph.catalog.aggregates import FIXTURE_FLOORS, bucket_sql, industry_means, market_caps
from barograph.catalog.base import query, view
from barograph.catalog.filters import closes
from barograph.catalog.joins import actuals, forecast_actual
from barograph.catalog.leadlag import both, stored
from barograph.catalog.rolling import features, holding_values, r6
from barograph.catalog.signals import ALL_FACTORS, factors
from barograph.catalog.sqlstats import binomial_tail_sql, t_tail_sql
from barograph.catalog.topk import eligible, top_eligible
from barograph.functions import scalars as S
from barograph.functions.stats import binomial_tail
from barograph.operators import aggregates as A
from barograph.operators import ledger as L
from barograph.plans import backtests as B
from barograph.plans import discovery as X
from barograph.plans import signals as G
from barograph.session import cut_lineage
from barograph.sources.market import CUT

# Thresholds at the scale of the derived pairs; same shape as the built-in catalogue.
CONFIGS = (
    B.PairConfig("v1", 0.02, 0.0, 1),
    B.PairConfig("v2", 0.02, 0.0, 2, True),
    B.PairConfig("v3", 0.01, 0.0, 1, True, True),
    B.PairConfig("v5", 0.0, 0.03, 2, True, True),
    B.PairConfig("v4", 0.03, 0.01, 2, True, True),
    B.PairConfig("v6", 0.01, 0.0, 5, True, True),
    B.PairConfig("v7", 0.01, 0.0, 5, True, True, ("ASIA", "AFRICA")),
    B.PairConfig("v8", 0.0, -1.0, 1, True, True, (), (("NATION_0", "NATION_5"), ("NATION_2", "NATION_7"), ("NATION_8", "NATION_18"))),
)
_CUT = "DATE '2000-07-01'"


def _cfg_sql(c: B.PairConfig) -> str:
    terms = [f"train_r > 0 AND train_r >= {c.min_train_r} AND backtest_r > {c.min_backtest_r} AND lag_days >= {c.min_lag}"]
    if c.industries:
        terms.append("industry IN (" + ", ".join(f"'{i}'" for i in c.industries) + ")")
    if c.pairs:
        terms.append("(leader, follower) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in c.pairs) + ")")
    body = f"SELECT *, '{c.id}' AS config, {c.no_overlap} AS no_overlap FROM m_both WHERE " + " AND ".join(terms)
    if c.dedup:
        body += (" QUALIFY row_number() OVER (PARTITION BY least(leader, follower), greatest(leader, follower) "
                 "ORDER BY abs(train_r) DESC, leader, follower, lag_days) = 1")
    return f"({body})"


view("m_both", """SELECT t.industry, t.leader, t.follower, t.lag_days, round(t.r, 6) AS train_r, round(b.r, 6) AS backtest_r
    FROM m_ccft t JOIN m_ccfb b USING (industry, leader, follower, lag_days) WHERE leader <> follower""")
view("m_q", " UNION ALL ".join(_cfg_sql(c) for c in CONFIGS))
view("m_bp", f"SELECT symbol, t, date, open, close FROM m_panel WHERE date >= {_CUT}")
view("m_cand", """
    SELECT q.config, q.no_overlap, q.leader, q.follower, q.lag_days, s.t AS signal_t, s.date AS signal_date, s.t + 1 AS buy_t, s.t + q.lag_days AS sell_t,
           b.date AS buy_date, b.open AS buy_price, x.date AS sell_date, x.close AS sell_price
    FROM m_q q JOIN m_bp s ON s.symbol = q.leader JOIN m_bp p ON p.symbol = q.leader AND p.t = s.t - 1
    JOIN m_bp b ON b.symbol = q.follower AND b.t = s.t + 1 JOIN m_bp x ON x.symbol = q.follower AND x.t = s.t + q.lag_days
    WHERE s.close / p.close - 1 > 0 AND b.open > 0""")


def economics_sql(src: str) -> str:
    return f"""SELECT *, proceeds - cost AS pnl FROM (
      SELECT *, shares * buy_price + greatest(6.0::DOUBLE, 0.0008::DOUBLE * (shares * buy_price)) AS cost,
             shares * sell_price - greatest(6.0::DOUBLE, 0.0008::DOUBLE * (shares * sell_price)) AS proceeds FROM (
        SELECT *, CAST(greatest(0, least(floor((1000 - 6.0) / buy_price), floor(1000 / (buy_price * (1 + 0.0008::DOUBLE))))) AS BIGINT) AS shares FROM {src}) WHERE shares >= 1)"""


def greedy_sql(src: str, key: list[str], order: str, carry: str = "*") -> str:
    """Walk along 'next candidate that starts at or after this one ends' pointers."""
    k = ", ".join(key)
    on = " AND ".join(f"a.{c} = b.{c}" for c in key)
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY buy_t, {order}) AS seq FROM {src}),
      heads AS MATERIALIZED (SELECT {k}, buy_t, min(seq) AS seq FROM o GROUP BY {k}, buy_t),
      ptr AS MATERIALIZED (SELECT {', '.join('a.' + c for c in key)}, a.seq, CASE WHEN a.sell_t <= a.buy_t THEN a.seq + 1 ELSE b.seq END AS nxt
              FROM o a ASOF LEFT JOIN heads b ON {on} AND b.buy_t >= a.sell_t),
      walk AS (SELECT {k}, seq, nxt FROM ptr WHERE seq = 1 UNION ALL SELECT {', '.join('b.' + c for c in key)}, b.seq, b.nxt FROM walk a JOIN ptr b ON {on} AND b.seq = a.nxt)
      SELECT o.* EXCLUDE (seq) FROM o JOIN walk USING ({k}, seq)"""


view("m_sized", economics_sql("m_cand"))
view("m_kept", greedy_sql("(SELECT * FROM m_sized WHERE no_overlap)", ["config", "follower"], "leader, lag_days"))
view("m_ledger", "SELECT * FROM m_sized WHERE NOT no_overlap UNION ALL SELECT * FROM m_kept")


def pairs(m):
    """Pairs that rise together in training, as every strategy asks; stored, so built once for all of them."""
    return stored(m, "rising", lambda: both(m).where((F.col("leader") != F.col("follower")) & (F.col("train_r") > 0)))


def panel(m):
    return m.panel.where(F.col("date") >= F.lit(CUT)).select("symbol", "date", "t", "open", "close", "valid")


def prices(m, *kinds):
    """The panel's columns of these prices, written once: signals, exits and the last day are read apart."""
    return cut_lineage(panel(m).select("symbol", "date", "t", *kinds))


def candidates(m, rows=None):
    rows = prices(m, "open", "close") if rows is None else rows
    return B.pair_candidates(B.qualifying(pairs(m), CONFIGS), rows, 20)


def ledger(m, rows=None):
    return B.pair_ledger(candidates(m, rows))


_TRADE = ("config", "leader", "follower", "lag_days", "signal_date", "buy_date", "sell_date", "buy_price", "sell_price")


@query("bkt_04", f"SELECT {', '.join(_TRADE)} FROM m_cand")
def _(m):
    return candidates(m).select(*_TRADE)


@query("bkt_05", f"SELECT {', '.join(_TRADE)} FROM m_kept")
def _(m):
    sized = L.economics(candidates(m).where("no_overlap"))
    return L.non_overlapping(sized, ["config", "follower"], "buy_t", "sell_t", ["leader", "lag_days"]).select(*_TRADE)


@query("bkt_06", """SELECT industry, leader, follower, lag_days, train_r FROM m_both WHERE train_r > 0 QUALIFY row_number() OVER
       (PARTITION BY least(leader, follower), greatest(leader, follower) ORDER BY abs(train_r) DESC, leader, follower, lag_days) = 1""")
def _(m):
    return L.undirected_best(pairs(m).where(F.col("train_r") > 0), [], "train_r", ["leader", "follower", "lag_days"]).select(
        "industry", "leader", "follower", "lag_days", "train_r")


_MONEY = ("shares", "cost", "proceeds", "pnl")


@query("bkt_07", f"SELECT {', '.join(_TRADE)}, {', '.join(_MONEY)} FROM m_ledger")
def _(m):
    return ledger(m).select(*_TRADE, *_MONEY)


@query("bkt_08", """
    SELECT config, CAST(n AS BIGINT) AS n_trades, CAST(w AS BIGINT) AS n_wins, CAST(n - w AS BIGINT) AS n_losses, round(100.0 * w / n, 4) AS win_rate, round(p / n, 4) AS avg_trade_pnl,
           round(f, 4) AS total_fees, round(p + 50000, 4) AS end_balance, round(p / 50000 * 100, 6) AS total_return_pct
    FROM (SELECT config, count(*) AS n, count(*) FILTER (pnl > 0) AS w, sum(pnl) AS p,
                 sum(cost - shares * buy_price + shares * sell_price - proceeds) AS f FROM m_ledger GROUP BY config)""")
def _(m):
    s = L.summary(ledger(m), ["config"])
    return s.select("config", "n_trades", "n_wins", "n_losses", r6("win_rate", "win_rate", 4), r6("avg_trade_pnl", "avg_trade_pnl", 4),
                    r6("total_fees", "total_fees", 4), r6("end_balance", "end_balance", 4), r6("total_return_pct", "total_return_pct"))


@query("bkt_08_series", f"""
    SELECT config, sell_date AS date, round(50000 + sum(dp) OVER (PARTITION BY config ORDER BY sell_date), 2) AS balance
    FROM (SELECT config, sell_date, sum(pnl) AS dp FROM m_ledger GROUP BY config, sell_date)
    UNION ALL SELECT config, (SELECT min(date) FROM m_bp), 50000.0::DOUBLE FROM (VALUES {', '.join(f"('{c.id}')" for c in CONFIGS)}) c(config)""")
def _(m):
    """Balance at the end of each day with a sale, after a row that opens every configuration."""
    rows = prices(m, "open", "close")
    days = L.daily_balance(ledger(m, rows), ["config"]).select("config", F.col("sell_date").alias("date"), r6("balance", "balance", 2))
    opening = rows.agg(F.min("date").alias("date")).select(
        F.explode(F.array(*[F.lit(c.id) for c in CONFIGS])).alias("config"), "date", F.lit(S.START_BALANCE).cast("double").alias("balance"))
    return days.unionByName(opening)


@query("bkt_09", """SELECT q.config, q.leader, q.follower, q.lag_days, q.train_r, q.backtest_r, s.date AS signal_date, round((s.close / p.close - 1) * 100, 2) AS leader_return_pct,
       f.close AS follower_last_close FROM m_q q JOIN m_bp s ON s.symbol = q.leader AND s.t = (SELECT max(t) FROM m_bp) JOIN m_bp p ON p.symbol = q.leader AND p.t = s.t - 1
       LEFT JOIN m_bp f ON f.symbol = q.follower AND f.t = s.t WHERE s.close / p.close - 1 > 0""")
def _(m):
    return B.recommendations(B.qualifying(pairs(m), CONFIGS), prices(m, "close")).select(
        "config", "leader", "follower", "lag_days", "train_r", "backtest_r", "signal_date", "leader_return_pct", "follower_last_close")


@query("bkt_11", """SELECT config, count(DISTINCT (leader, follower)) AS n_pairs, count(*) AS n_trades, round(sum(pnl), 4) AS pnl, min(buy_date) AS first_buy, max(sell_date) AS last_sell
       FROM m_ledger GROUP BY config""")
def _(m):
    """All pair configurations evaluated together, keyed by their id."""
    return ledger(m).groupBy("config").agg(
        F.countDistinct("leader", "follower").alias("n_pairs"), F.count(F.lit(1)).alias("n_trades"), r6(F.sum("pnl"), "pnl", 4),
        F.min("buy_date").alias("first_buy"), F.max("sell_date").alias("last_sell"))


# --- factor strategies ---------------------------------------------------------------------------

_LEGS = [(c.id, k, f, lag, side, c.top_n) for c in B.FACTOR_CONFIGS for k, (f, lag, side) in enumerate(c.legs)]
view("m_fbad", "SELECT p.*, b.bad FROM m_panel p JOIN m_bad b USING (symbol, date)")
view("m_frank", f"""
    WITH ok AS (SELECT symbol, date, t FROM (SELECT *, max(bad::INT) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS rb FROM m_fbad)
                WHERE rb = 0 AND date >= {_CUT}),
    v AS (SELECT o.symbol, o.date, o.t, c.config, c.leg, c.factor, c.lag, c.side, c.top_n, CASE c.factor {' '.join(f"WHEN '{f}' THEN round({f}, 8)" for f in ALL_FACTORS)} END AS value
          FROM ok o JOIN m_factor f USING (symbol, date) CROSS JOIN (VALUES {', '.join(f"('{i}', {k}, '{f}', {lag}, '{s}', {n})" for i, k, f, lag, s, n in _LEGS)}) c(config, leg, factor, lag, side, top_n))
    SELECT * FROM (SELECT *, count(*) OVER d AS n, row_number() OVER (PARTITION BY config, leg, date ORDER BY value, symbol) AS rn FROM v
                   WHERE value IS NOT NULL AND t + lag <= (SELECT max(t) FROM m_panel) WINDOW d AS (PARTITION BY config, leg, date))
    WHERE n >= 2 AND CASE side WHEN 'long_top' THEN rn > n - top_n ELSE rn <= top_n END""")
view("m_fcand", """
    SELECT r.config, r.leg, r.factor, r.symbol, r.date AS signal_date, r.t + 1 AS buy_t, r.t + r.lag AS sell_t, b.date AS buy_date, b.open AS buy_price,
           x.date AS sell_date, x.close AS sell_price, r.lag AS lag_days, r.value, (r.rn - 1)::DOUBLE / (r.n - 1) AS rank, r.rn
    FROM m_frank r JOIN m_panel b ON b.symbol = r.symbol AND b.t = r.t + 1 JOIN m_panel x ON x.symbol = r.symbol AND x.t = r.t + r.lag
    WHERE b.open > 0 AND NOT EXISTS (SELECT 1 FROM m_bad d WHERE d.symbol = r.symbol AND d.bad AND d.date BETWEEN b.date AND x.date)""")
view("m_fsized", economics_sql("m_fcand"))
view("m_fledger", greedy_sql("m_fsized", ["config", "symbol"], "leg, rn"))


def factor_ledger(m):
    bank = factors(m)
    rounded = bank.select("symbol", "date", *[F.round(c, 8).alias(c) for c in ALL_FACTORS])
    full = m.panel.select("symbol", "date", "t", "open", "close")
    return B.factor_ledger(B.factor_candidates(rounded, full, B.FACTOR_CONFIGS, CUT))


@query("bkt_10", """
    WITH s AS (SELECT config, count(*) AS n, count(*) FILTER (pnl > 0) AS w, sum(pnl) AS p FROM m_fledger GROUP BY config),
    d AS (SELECT config, sell_date, sum(pnl) AS dp FROM m_fledger GROUP BY 1, 2),
    b AS (SELECT *, 50000 + sum(dp) OVER (PARTITION BY config ORDER BY sell_date) AS bal FROM d),
    k AS (SELECT *, greatest(50000, max(bal) OVER (PARTITION BY config ORDER BY sell_date)) AS peak FROM b),
    r AS (SELECT config, CASE WHEN count(*) >= 5 AND stddev_pop(dp / 50000) > 0 THEN avg(dp / 50000) / stddev_pop(dp / 50000) * sqrt(252) END AS sharpe,
                 max((peak - bal) / peak * 100) AS dd FROM k GROUP BY config)
    SELECT config, n AS n_trades, w AS n_wins, round(p, 4) AS pnl, round(sharpe, 4) AS sharpe_ratio, round(dd, 5) AS max_drawdown_pct FROM s JOIN r USING (config)""")
def _(m):
    s = B.factor_summary(factor_ledger(m))
    return s.select("config", "n_trades", "n_wins", r6(F.col("end_balance") - 50000, "pnl", 4), r6("sharpe_ratio", "sharpe_ratio", 4),
                    r6("max_drawdown_pct", "max_drawdown_pct", 5))


_ALL = [c.id for c in (*CONFIGS, *B.FACTOR_CONFIGS)]


@query("bkt_11_all", f"""
    WITH t AS (SELECT config, count(DISTINCT (leader, follower)) AS n_traded, count(*) AS n_trades, sum(pnl) AS pnl, min(buy_date) AS first_buy, max(sell_date) AS last_sell
               FROM m_ledger GROUP BY config UNION ALL
               SELECT config, count(DISTINCT symbol), count(*), sum(pnl), min(buy_date), max(sell_date) FROM m_fledger GROUP BY config)
    SELECT config, coalesce(n_traded, 0) AS n_traded, coalesce(n_trades, 0) AS n_trades, round(coalesce(pnl, 0), 4) AS pnl, first_buy, last_sell
    FROM (VALUES {', '.join(f"('{c}')" for c in _ALL)}) c(config) LEFT JOIN t USING (config)""")
def _(m):
    """Both catalogues together, a row for each configuration; ``n_traded`` counts pairs or symbols."""
    def totals(trades, *what):
        return trades.groupBy("config").agg(
            F.countDistinct(*what).alias("n_traded"), F.count(F.lit(1)).alias("n_trades"), F.sum("pnl").alias("pnl"),
            F.min("buy_date").alias("first_buy"), F.max("sell_date").alias("last_sell"))

    both_kinds = totals(ledger(m), "leader", "follower").unionByName(totals(factor_ledger(m), "symbol"))
    names = m.panel.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, _ALL))).alias("config"))
    return names.join(both_kinds, "config", "left").fillna(0, ["n_traded", "n_trades"]).fillna(0.0, ["pnl"]).select(
        "config", "n_traded", "n_trades", r6("pnl", "pnl", 4), "first_buy", "last_sell")


_GRID = dict(train_grid=(0.0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.035, 0.04),
             backtest_grid=(-0.02, 0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07), lag_grid=B.LAG_GRID)


@query("joi_17", f"""SELECT a AS min_train_r, b AS min_backtest_r, CAST(l AS INTEGER) AS min_lag_days, count(*) AS n FROM m_both
       JOIN (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _GRID['train_grid'])}]) AS a) ON train_r >= a JOIN (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _GRID['backtest_grid'])}]) AS b) ON backtest_r > b
       JOIN (SELECT unnest([{', '.join(str(x) for x in B.LAG_GRID)}]) AS l) ON lag_days >= l WHERE train_r > 0 GROUP BY a, b, l""")
def _(m):
    """Pairs per combination: each row lists the grid values it satisfies."""
    def arr(g):
        return F.array(*[F.lit(x) for x in g])

    hits = pairs(m).where(F.col("train_r") > 0)
    hits = hits.withColumn("min_train_r", F.explode(F.filter(arr(_GRID["train_grid"]), lambda g: F.col("train_r") >= g)))
    hits = hits.withColumn("min_backtest_r", F.explode(F.filter(arr(_GRID["backtest_grid"]), lambda g: F.col("backtest_r") > g)))
    hits = hits.withColumn("min_lag_days", F.explode(F.filter(arr(B.LAG_GRID), lambda g: F.col("lag_days") >= g)))
    return hits.groupBy("min_train_r", "min_backtest_r", "min_lag_days").agg(F.count(F.lit(1)).alias("n"))


@query("bkt_12")
def _(m):
    g = B.grid_sweep(pairs(m), prices(m, "open", "close"), **_GRID)
    return g.select("min_train_r", "min_backtest_r", "min_lag_days", "n_pairs", "n_trades", r6("end_balance", "end_balance", 2),
                    r6("total_return_pct", "total_return_pct", 2), r6("win_rate", "win_rate", 1), r6("avg_pnl", "avg_pnl", 2), r6("total_fees", "total_fees", 2))


# --- signal evaluation --------------------------------------------------------------------------

_HORIZONS = (1, 3, 5, 10)
_THRESHOLD = 0.8
_BPT = f"SELECT * FROM m_panel WHERE date >= {_CUT}"


def _hit_sql(horizons=_HORIZONS) -> str:
    return f"""SELECT v.symbol, v.date, v.t, h AS horizon, x.close / p.close - 1 AS ret FROM m_sig_volume v JOIN ({_BPT}) p ON p.symbol = v.symbol AND p.t = v.t
        CROSS JOIN (SELECT unnest([{', '.join(map(str, horizons))}]) AS h) JOIN ({_BPT}) x ON x.symbol = v.symbol AND x.t = v.t + h WHERE v.score >= {_THRESHOLD}"""


view("m_hits", _hit_sql())


def hits(m, horizons=_HORIZONS):
    return B.triggers(G.volume_anomaly(features(m)), panel(m), _THRESHOLD, horizons)


@query("bkt_01", "SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(ret), 6) AS mean_return FROM m_hits GROUP BY horizon")
def _(m):
    return B.by_horizon(hits(m), _HORIZONS).select("horizon", "n", r6("hit_rate", "hit_rate"), r6("mean_return", "mean_return"))


_ICV = """SELECT date, corr(rx, ry) AS ic FROM (SELECT v.date, row_number() OVER (PARTITION BY v.date ORDER BY round(v.score, 8), v.symbol) AS rx,
        row_number() OVER (PARTITION BY v.date ORDER BY f.fwd, v.symbol) AS ry FROM m_sig_volume v JOIN m_fwd1 f ON f.symbol = v.symbol AND f.t = v.t + 1
        WHERE v.score IS NOT NULL AND f.fwd IS NOT NULL AND v.date < DATE '2000-06-28') GROUP BY date HAVING count(*) >= 8"""


@query("bkt_02", f"""SELECT n, round(ir, 6) AS ic_ir, CASE WHEN abs(coalesce(ir, 0)) > 0.10 THEN 0.80::DOUBLE WHEN abs(coalesce(ir, 0)) > 0.05 THEN 0.75::DOUBLE ELSE 0.70::DOUBLE END AS threshold,
       (SELECT min(date) FROM m_bp) >= {_CUT} AS after_cut FROM (SELECT count(ic) AS n, avg(ic) / (stddev_samp(ic) + 1e-10) AS ir FROM ({_ICV}))""")
def _(m):
    """Threshold fitted on training rows only; the evaluation panel must start after the cut.

    Training signals stop two market days early, so that no outcome reaches past it.
    """
    start = panel(m).agg(F.min("date")).scalar()
    return training_ic(m).select("n", r6("ic_ir", "ic_ir"), B.fit_threshold(F.col("ic_ir")).alias("threshold"), (start >= F.lit(CUT)).alias("after_cut"))


def training_ic(m):
    scores = G.volume_anomaly(features(m)).where((F.col("date") < "2000-06-28") & F.col("score").isNotNull()).withColumn("score", F.round("score", 8))
    fwd = m.panel.select("symbol", "date", "t", "valid", "close")
    with_fwd = fwd.withColumn("fwd1", F.round(_fwd1(), 9)).join(scores.select("symbol", "date", "score"), ["symbol", "date"], "left")
    return X.ic_stats(X.ic_series(with_fwd, ["score"], "fwd1", 1, 8), "feature", "lag")


def _fwd1():
    from barograph.operators.rolling import forward_return

    return forward_return("close", 1)


_B3 = """SELECT (SELECT count(*) FROM m_sig_volume v JOIN m_bp b ON b.symbol = v.symbol AND b.t = v.t WHERE v.score >= 0.8) AS n_triggers,
    (SELECT avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE FROM m_hits WHERE horizon = 1) AS hit_rate,
    (SELECT avg(ret) / (stddev_pop(ret) + 1e-10) * sqrt(252) FROM m_hits WHERE horizon = 1) AS sharpe,
    (SELECT min(c - k) FROM (SELECT c, max(c) OVER (ORDER BY symbol, date ROWS UNBOUNDED PRECEDING) AS k FROM
        (SELECT symbol, date, sum(ret) OVER (ORDER BY symbol, date ROWS UNBOUNDED PRECEDING) AS c FROM m_hits WHERE horizon = 1))) AS max_drawdown"""


@query("bkt_03", f"""SELECT n_triggers, round(hit_rate, 6) AS hit_rate, round(sharpe, 5) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(p, 6) AS p_value
       FROM ({binomial_tail_sql(_B3, 'CAST(floor(hit_rate * n_triggers) AS BIGINT)', 'n_triggers', 'p')})""")
def _(m):
    """One-day evaluation. The cumulative curve runs by symbol, then date: symbols are
    summed first, so the running maximum is taken per symbol and combined over totals."""
    found = hits(m, (1,)).select("symbol", "date", F.element_at("ahead", 1).alias("ret"))
    known = found.where(F.col("ret").isNotNull())
    risk = B.additive_drawdown(known)
    one = known.agg(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
                    (F.avg("ret") / (F.stddev_pop("ret") + 1e-10) * (252 ** 0.5)).alias("sharpe"))
    n = found.agg(F.count(F.lit(1)).alias("n_triggers"))
    row = one.withColumns({"n_triggers": n.scalar(), "max_drawdown": risk.scalar()})
    p = binomial_tail(F.floor(F.col("hit_rate") * F.col("n_triggers")), F.col("n_triggers"))
    return row.select("n_triggers", r6("hit_rate", "hit_rate"), r6("sharpe", "sharpe", 5), r6("max_drawdown", "max_drawdown"), r6(p, "p_value"))


def one_day(m):
    return hits(m, (1,)).select("symbol", F.element_at("ahead", 1).alias("ret")).where(F.col("ret").isNotNull())


@query("bkt_03_overfit", f"""SELECT round(ir, 6) AS train_ic_ir, round(hit, 6) AS hit_rate, coalesce(abs(ir) > 0.1 AND hit < 0.51, FALSE) AS overfit
       FROM (SELECT avg(ic) / (stddev_samp(ic) + 1e-10) AS ir FROM ({_ICV})), (SELECT avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit FROM m_hits WHERE horizon = 1)""")
def _(m):
    """Whether a signal that was strong in training hits fewer than 51 % of days afterwards."""
    hit = one_day(m).agg(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit"))
    row = training_ic(m).agg(F.max("ic_ir").alias("ir")).crossJoin(hit)  # a row on either side
    return row.select(r6("ir", "train_ic_ir"), r6("hit", "hit_rate"), F.coalesce(
        (F.abs("ir") > 0.1) & (F.col("hit") < 0.51), F.lit(False)).alias("overfit"))


@query("bkt_03_industry", """SELECT industry, CAST(sum(n) AS BIGINT) AS n, round(avg(hit), 6) AS hit_rate, round(avg(mean), 6) AS mean_return
       FROM (SELECT symbol, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit, avg(ret) AS mean FROM m_hits WHERE horizon = 1 GROUP BY symbol)
       JOIN m_symbols USING (symbol) GROUP BY industry""")
def _(m):
    return industry_means(one_day(m), m.symbols, "ret").select(
        "industry", "n", r6("hit_rate", "hit_rate"), r6("mean_return", "mean_return"))


@query("bkt_13", f"""
    WITH tr AS (SELECT * FROM m_forecasts WHERE date < {_CUT}), el AS (SELECT symbol FROM m_shorts WHERE date < {_CUT} GROUP BY symbol HAVING arg_max(short, date) >= 0.5),
    top AS (SELECT symbol, score FROM tr WHERE date = (SELECT max(date) FROM tr) AND symbol IN (SELECT symbol FROM el) ORDER BY score DESC, symbol LIMIT 10),
    h AS (SELECT b.symbol, arg_min(close, date) AS entry, arg_max(close, date) AS last, min(date) AS entry_date FROM m_bp b JOIN top USING (symbol) GROUP BY b.symbol)
    SELECT symbol, round(score, 4) AS score, entry_date, round(10000.0 * last / entry, 2) AS current_value, round((last / entry - 1) * 100, 2) AS pnl_pct FROM h JOIN top USING (symbol)""")
def _(m):
    """Buy-and-hold book of the best eligible names at the cut."""
    return book(m).groupBy("symbol", "score").agg(
        F.min("date").alias("entry_date"), F.max_by("value", "date").alias("v")).select(
        "symbol", r6("score", "score", 4), "entry_date", r6("v", "current_value", 2), r6((F.col("v") / 10000.0 - 1) * 100, "pnl_pct", 2))


def book(m):
    """Daily value of each of the ten holdings, 10,000 at its entry."""
    train = m.forecasts.where(F.col("date") < F.lit(CUT))
    top = top_eligible(train, eligible(m.shorts.where(F.col("date") < F.lit(CUT))), 10)
    return holding_values(m, 10000.0).join(F.broadcast(top), "symbol").where(F.col("value").isNotNull())  # ten names


@query("bkt_13_total", f"""
    WITH tr AS (SELECT * FROM m_forecasts WHERE date < {_CUT}), el AS (SELECT symbol FROM m_shorts WHERE date < {_CUT} GROUP BY symbol HAVING arg_max(short, date) >= 0.5),
    top AS (SELECT symbol FROM tr WHERE date = (SELECT max(date) FROM tr) AND symbol IN (SELECT symbol FROM el) ORDER BY score DESC, symbol LIMIT 10),
    g AS (SELECT c.date, top.symbol, b.close FROM (SELECT * FROM m_cal WHERE date >= {_CUT}) c CROSS JOIN top LEFT JOIN m_bp b ON b.symbol = top.symbol AND b.date = c.date),
    v AS (SELECT date, symbol, 10000.0 * last_value(close IGNORE NULLS) OVER w / first_value(close IGNORE NULLS) OVER w AS value
          FROM g WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT date, sum(value) AS total, 10000.0::DOUBLE * (SELECT count(DISTINCT symbol) FROM v WHERE value IS NOT NULL) AS invested FROM v GROUP BY date)
    SELECT date, round(invested, 2) AS invested, round(total, 2) AS total, round((total / invested - 1) * 100, 2) AS pnl_pct,
           round(invested * last_value(close IGNORE NULLS) OVER w / first_value(close IGNORE NULLS) OVER w, 2) AS benchmark
    FROM s LEFT JOIN m_index USING (date) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(m):
    """The book's total on each market day beside the index, scaled to the sum invested."""
    each = cut_lineage(book(m).select("symbol", "date", "value"))
    invested = each.agg(F.countDistinct("symbol") * F.lit(10000.0)).scalar()
    days = m.calendar.where(F.col("date") >= F.lit(CUT)).select("date")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # bounded: calendar days
    rows = days.join(each.groupBy("date").agg(F.sum("value").alias("total")), "date", "left").join(
        m.index.select("date", "close"), "date", "left").withColumn("invested", invested).where("invested > 0")
    return rows.select(
        "date", r6("invested", "invested", 2), r6("total", "total", 2), r6((F.col("total") / F.col("invested") - 1) * 100, "pnl_pct", 2),
        r6(F.col("invested") * F.last("close", True).over(w) / F.first("close", True).over(w), "benchmark", 2))


# --- all signals ------------------------------------------------------------------------------------

_SIGNALS = tuple(G.SIGNALS)
_TRAIN_END = "2000-06-28"  # two market days before the cut
view("m_sig_all", " UNION ALL ".join(f"SELECT '{n}' AS signal, symbol, date, t, score FROM {v} WHERE score IS NOT NULL" for n, v in (
    ("short_trend", "m_sig_trend"), ("short_squeeze", "m_sig_squeeze"), ("volume_anomaly", "m_sig_volume"))))
view("m_sig_fit", f"""
    WITH r AS (SELECT v.signal, v.date, row_number() OVER (PARTITION BY v.signal, v.date ORDER BY round(v.score, 8), v.symbol) AS rx,
                      row_number() OVER (PARTITION BY v.signal, v.date ORDER BY f.fwd, v.symbol) AS ry
               FROM m_sig_all v JOIN m_fwd1 f ON f.symbol = v.symbol AND f.t = v.t + 1 WHERE f.fwd IS NOT NULL AND v.date < DATE '{_TRAIN_END}'),
    i AS (SELECT signal, date, corr(rx, ry) AS ic FROM r GROUP BY signal, date HAVING count(*) >= 4),
    g AS (SELECT signal, count(ic) AS c, avg(ic) / (stddev_samp(ic) + 1e-10) AS q FROM i GROUP BY signal),
    k AS (SELECT signal, CASE WHEN c >= 5 THEN c ELSE 0 END AS n, CASE WHEN c >= 5 THEN q END AS ic_ir FROM g)
    SELECT signal, coalesce(n, 0) AS n, ic_ir, CASE WHEN abs(coalesce(ic_ir, 0)) > 0.10 THEN 0.80::DOUBLE
           WHEN abs(coalesce(ic_ir, 0)) > 0.05 THEN 0.75::DOUBLE ELSE 0.70::DOUBLE END AS threshold
    FROM (VALUES {', '.join(f"('{n}')" for n in _SIGNALS)}) s(signal) LEFT JOIN k USING (signal)""")
view("m_sig_trig", "SELECT v.* FROM m_sig_all v JOIN m_sig_fit USING (signal) JOIN m_bp b ON b.symbol = v.symbol AND b.t = v.t WHERE v.score >= threshold")
view("m_sig_hits", f"""
    SELECT v.signal, v.symbol, v.date, h AS horizon, x.close / p.close - 1 AS ret FROM m_sig_trig v JOIN m_bp p ON p.symbol = v.symbol AND p.t = v.t
    CROSS JOIN (SELECT unnest([{', '.join(map(str, _HORIZONS))}]) AS h) JOIN m_bp x ON x.symbol = v.symbol AND x.t = v.t + h""")


def all_scores(m):
    return G.signal_table(features(m))


def all_thresholds(m):
    """Fitted on training rows only; four names make a date here, as few symbols pass the squeeze's cut."""
    early = all_scores(m).where(F.col("date") < _TRAIN_END)
    return B.fitted_thresholds(early, m.panel.select("symbol", "date", "t", "valid", "close"), _SIGNALS, 4)


@query("bkt_02_signals", "SELECT signal, n, round(ic_ir, 6) AS ic_ir, threshold FROM m_sig_fit")
def _(m):
    return all_thresholds(m).select("signal", "n", r6("ic_ir", "ic_ir"), "threshold")


@query("bkt_01_signals", """SELECT signal, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
       round(avg(ret), 6) AS mean_return FROM m_sig_hits GROUP BY signal, horizon""")
def _(m):
    """Every signal after the cut, each over the threshold that its own training gave."""
    found = B.signal_triggers(all_scores(m), panel(m), all_thresholds(m), _HORIZONS)
    return B.signal_horizons(found, _HORIZONS).select("signal", "horizon", "n", r6("hit_rate", "hit_rate"), r6("mean_return", "mean_return"))


_RISK = """SELECT f.signal, f.threshold, f.ic_ir AS train_ic_ir, coalesce(n_triggers, 0) AS n_triggers, hit_rate, sharpe, max_drawdown
    FROM m_sig_fit f LEFT JOIN (SELECT signal, count(*) AS n_triggers FROM m_sig_trig GROUP BY signal) USING (signal)
    LEFT JOIN (SELECT signal, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_rate,
                      CASE WHEN count(*) > 1 THEN avg(ret) / (stddev_pop(ret) + 1e-10) * sqrt(252) END AS sharpe FROM m_sig_hits WHERE horizon = 1 GROUP BY signal) USING (signal)
    LEFT JOIN (SELECT signal, CASE WHEN count(*) > 1 THEN min(c - k) END AS max_drawdown FROM (
        SELECT signal, c, max(c) OVER (PARTITION BY signal ORDER BY symbol, date ROWS UNBOUNDED PRECEDING) AS k FROM (
          SELECT signal, symbol, date, sum(ret) OVER (PARTITION BY signal ORDER BY symbol, date ROWS UNBOUNDED PRECEDING) AS c
          FROM m_sig_hits WHERE horizon = 1)) GROUP BY signal) USING (signal)"""


@query("bkt_03_signals", f"""SELECT signal, threshold, round(train_ic_ir, 6) AS train_ic_ir, n_triggers, round(hit_rate, 6) AS hit_rate, round(sharpe, 5) AS sharpe,
       round(max_drawdown, 6) AS max_drawdown, round(coalesce(p, 1.0), 6) AS p_value, coalesce(abs(train_ic_ir) > 0.1 AND hit_rate < 0.51, FALSE) AS overfit
       FROM ({binomial_tail_sql(_RISK, 'CAST(floor(coalesce(hit_rate, 0) * n_triggers) AS BIGINT)', 'n_triggers', 'p')})""")
def _(m):
    fitted = cut_lineage(all_thresholds(m))
    found = B.signal_triggers(all_scores(m), panel(m), fitted, (1,))
    return B.signal_risk(found, fitted).select(
        "signal", "threshold", r6("train_ic_ir", "train_ic_ir"), "n_triggers", r6("hit_rate", "hit_rate"), r6("sharpe", "sharpe", 5),
        r6("max_drawdown", "max_drawdown"), r6("p_value", "p_value"), "overfit")


_BOOKS = (*_SIGNALS, "forecast")
_STAKE = 10000.0
view("m_books", f"""
    WITH s AS (SELECT signal, symbol, date, score FROM m_sig_all UNION ALL SELECT 'forecast', symbol, date, score FROM m_forecasts),
    tr AS (SELECT * FROM s WHERE date < {_CUT}), l AS (SELECT signal, max(date) AS date FROM tr GROUP BY signal),
    el AS (SELECT symbol FROM m_shorts WHERE date < {_CUT} GROUP BY symbol HAVING arg_max(short, date) >= 0.5)
    SELECT signal, symbol, score FROM tr JOIN l USING (signal, date) WHERE symbol IN (SELECT symbol FROM el)
    QUALIFY row_number() OVER (PARTITION BY signal ORDER BY score DESC, symbol) <= 10""")
view("m_combined", f"""SELECT symbol, arg_min(signal, list_position({list(_BOOKS)}, signal)) AS source, arg_min(score, list_position({list(_BOOKS)}, signal)) AS score
    FROM m_books GROUP BY symbol""")
view("m_held", f"""
    WITH b AS (SELECT signal AS book, symbol FROM m_books UNION ALL SELECT 'combined', symbol FROM m_combined),
    g AS (SELECT c.date, s.symbol, p.close FROM (SELECT * FROM m_cal WHERE date >= {_CUT}) c CROSS JOIN (SELECT DISTINCT symbol FROM b) s
          LEFT JOIN m_bp p ON p.symbol = s.symbol AND p.date = c.date),
    v AS (SELECT date, symbol, {_STAKE}::DOUBLE * last_value(close IGNORE NULLS) OVER w / first_value(close IGNORE NULLS) OVER w AS value
          FROM g WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
    SELECT book, symbol, date, value FROM b JOIN v USING (symbol) WHERE value IS NOT NULL""")


def books(m):
    """The ten best eligible symbols of each signal at the end of training, and of the forecast."""
    every = G.signal_table(features(m)).select("signal", "symbol", "date", "score").unionByName(
        m.forecasts.select(F.lit("forecast").alias("signal"), "symbol", "date", "score"))
    return cut_lineage(B.top_books(every.where(F.col("date") < F.lit(CUT)), eligible(m.shorts.where(F.col("date") < F.lit(CUT)))))


_CLOSED = "SELECT book, symbol, min(date) AS entry_date, arg_max(value, date) AS v FROM m_held GROUP BY book, symbol"


@query("bkt_13_signals", f"""SELECT signal, b.symbol, round(score, 4) AS score, entry_date, round(v, 2) AS current_value, round(v - {_STAKE}, 2) AS pnl, round((v / {_STAKE} - 1) * 100, 2) AS pnl_pct
       FROM m_books b JOIN ({_CLOSED}) h ON h.book = b.signal AND h.symbol = b.symbol""")
def _(m):
    """A buy-and-hold book for every signal."""
    return closing(m, books(m), "signal", "symbol", "score")


@query("bkt_13_combined", f"""SELECT b.symbol, source, round(score, 4) AS score, entry_date, round(v, 2) AS current_value, round(v - {_STAKE}, 2) AS pnl, round((v / {_STAKE} - 1) * 100, 2) AS pnl_pct
       FROM m_combined b JOIN ({_CLOSED}) h ON h.book = 'combined' AND h.symbol = b.symbol""")
def _(m):
    """All books as one, a symbol held once for the first signal that chose it."""
    return closing(m, B.combined_book(books(m), _BOOKS), "symbol", "source", "score")


def closing(m, chosen, *keys):
    worth = holding_values(m, _STAKE).where(F.col("value").isNotNull()).groupBy("symbol").agg(
        F.min("date").alias("entry_date"), F.max_by("value", "date").alias("v"))
    rows = worth.join(chosen, "symbol")
    return rows.select(*[r6("score", "score", 4) if k == "score" else k for k in keys], "entry_date", r6("v", "current_value", 2),
                       r6(F.col("v") - _STAKE, "pnl", 2), r6((F.col("v") / _STAKE - 1) * 100, "pnl_pct", 2))


@query("bkt_13_totals", f"""
    WITH i AS (SELECT book, {_STAKE}::DOUBLE * count(DISTINCT symbol) AS invested FROM m_held GROUP BY book),
    d AS (SELECT book, date, sum(value) AS total FROM m_held GROUP BY book, date)
    SELECT book, date, round(invested, 2) AS invested, round(total, 2) AS total, round((total / invested - 1) * 100, 2) AS pnl_pct,
           round(invested * last_value(x.close IGNORE NULLS) OVER w / first_value(x.close IGNORE NULLS) OVER w, 2) AS benchmark
    FROM d JOIN i USING (book) LEFT JOIN m_index x USING (date) WINDOW w AS (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(m):
    """Daily totals of each book and of the combined one beside the index."""
    single = books(m)
    every = single.select(F.col("signal").alias("book"), "symbol").unionByName(
        B.combined_book(single, _BOOKS).select(F.lit("combined").alias("book"), "symbol"))
    held = every.join(holding_values(m, _STAKE), "symbol")
    return B.book_totals(held, m.index, _STAKE).select(
        "book", "date", r6("invested", "invested", 2), r6("total", "total", 2), r6((F.col("total") / F.col("invested") - 1) * 100, "pnl_pct", 2),
        r6("benchmark", "benchmark", 2))


_SIZES = (1, 3, 5, 10, 20, 50)
_COST = 0.012
_PORT = f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rn FROM m_forecasts),
    p AS (SELECT n, r.date, avg(a.actual - {_COST}) AS net, count(*) AS names, count(*) FILTER (a.actual - {_COST} > 0) AS wins FROM r JOIN m_actual a ON a.symbol = r.symbol AND a.date = r.date
          JOIN (SELECT unnest([1, 3, 5, 10, 20, 50]) AS n) s ON rn <= n WHERE a.actual IS NOT NULL AND r.date >= {_CUT} GROUP BY n, r.date),
    e AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY n ORDER BY date)) AS equity FROM p),
    k AS (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY n ORDER BY date)) AS peak FROM e)
    SELECT n, count(*) AS n_dates, CAST(sum(names) AS BIGINT) AS n_trades, sum(wins)::DOUBLE / sum(names) AS hit_rate, avg(net) AS mean_return, stddev_samp(net) AS sd,
           arg_max(equity, date) AS final_equity, min((equity - peak) / (peak + 1e-10)) AS max_drawdown FROM k GROUP BY n"""


@query("bkt_14", f"""SELECT CAST(n AS INTEGER) AS n, n_dates, n_trades, round(hit_rate, 6) AS hit_rate, round(mean_return, 6) AS mean_return, round(mean_return / sd * sqrt(50.4), 4) AS sharpe,
       round(max_drawdown, 5) AS max_drawdown, round(ln(final_equity), 6) AS log_equity, round(p, 6) AS p_value
       FROM ({t_tail_sql(_PORT, 'mean_return / (sd / sqrt(n_dates))', 'n_dates - 1', 'p')})""")
def _(m):
    tested = m.forecasts.where(F.col("date") >= F.lit(CUT))
    s = B.portfolio_summary(B.equity(B.top_n_portfolios(tested, actuals(m), _SIZES, _COST)))
    return s.select("n", "n_dates", "n_trades", r6("hit_rate", "hit_rate"), r6("mean_return", "mean_return"), r6("sharpe", "sharpe", 4),
                    r6("max_drawdown", "max_drawdown", 5), r6(F.log("final_equity"), "log_equity"), r6("p_value", "p_value"))


@query("bkt_15", f"""SELECT threshold, bucket, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(avg(r), 5) AS mean_return,
       round(CASE WHEN count(*) > 1 THEN avg(r) / (stddev_pop(r) + 1e-10) * sqrt(252) END, 3) AS sharpe
       FROM (SELECT th AS threshold, {bucket_sql('cap')} AS bucket, a.actual AS r FROM m_forecasts f JOIN m_actual a ON a.symbol = f.symbol AND a.date = f.date LEFT JOIN m_caps c ON c.symbol = f.symbol
             JOIN (SELECT unnest([1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) AS th) ON f.score >= th WHERE a.actual IS NOT NULL) GROUP BY 1, 2""")
def _(m):
    grid = F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0))
    rows = forecast_actual(m).join(market_caps(m), "symbol", "left").withColumn("bucket", A.cap_bucket(F.col("cap"), FIXTURE_FLOORS))
    each = rows.select("bucket", F.col("actual").alias("ret"), F.explode(F.filter(grid, lambda g: F.col("score") >= g)).alias("threshold"))
    s = A.portfolio_stats(each, ["threshold", "bucket"])
    return s.select("threshold", "bucket", "n", r6("hit_rate", "hit_rate", 4), r6("mean_return", "mean_return", 5), r6("sharpe", "sharpe", 3))


_FIC = """SELECT date, count(*) AS n, corr(a, b) AS ic FROM (
    SELECT f.date, rank() OVER (PARTITION BY f.date ORDER BY f.score) + (count(*) OVER (PARTITION BY f.date, f.score) - 1) / 2.0 AS a,
           rank() OVER (PARTITION BY f.date ORDER BY x.actual) + (count(*) OVER (PARTITION BY f.date, x.actual) - 1) / 2.0 AS b
    FROM m_forecasts f JOIN m_actual x ON x.symbol = f.symbol AND x.date = f.date WHERE x.actual IS NOT NULL) GROUP BY date HAVING count(*) >= 10"""
_FICS = f"SELECT count(ic) AS n_dates, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t_stat FROM ({_FIC})"


@query("bkt_16", f"""SELECT n_dates, round(mean_ic, 6) AS mean_ic, round(std_ic, 6) AS std_ic, round(mean_ic / std_ic * sqrt(50.4), 6) AS ic_ir, round(t_stat, 6) AS t_stat, round(p, 6) AS p_value
       FROM ({t_tail_sql(_FICS, 't_stat', 'n_dates - 1', 'p')})""")
def _(m):
    s = B.forecast_ic_summary(B.forecast_ic(m.forecasts, actuals(m)))
    return s.select("n_dates", *[r6(c, c) for c in ("mean_ic", "std_ic", "ic_ir", "t_stat", "p_value")])
