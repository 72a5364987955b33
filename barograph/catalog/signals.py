"""SIG: signals, feature and factor banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.catalog.filters import closes
from barograph.catalog.rolling import _W5, fast_z_sql, features, r6, slope_sql, tail_slope_sql, tail_sql, tail_z_sql
from barograph.operators import rolling as R
from barograph.operators.latest import latest
from barograph.plans import signals as G


def rank_sql(inner: str, raw: str, extra: str = "", by: str = "date") -> str:
    return f"""SELECT symbol, date, t{extra}, CASE WHEN {raw} IS NOT NULL AND n >= 2 THEN (rn - 1)::DOUBLE / (n - 1) END AS score FROM (
        SELECT *, count({raw}) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by}, {raw} IS NULL ORDER BY {raw}, symbol) AS rn FROM ({inner}))"""


view("m_sig_trend", rank_sql(f"SELECT symbol, date, t, -({slope_sql('short_pct', 20)}) AS raw FROM m_feat", "raw"))
_MOM = f"CASE WHEN t >= 5 THEN sum(coalesce(returns, 0.0)) OVER {_W5} END"
view("m_sig_squeeze", f"""
    SELECT a.symbol, a.date, a.t, CASE WHEN a.score >= 0.8 THEN b.score END AS score
    FROM ({rank_sql("SELECT symbol, date, t, short_pct AS raw FROM m_feat", "raw")}) a
    JOIN ({rank_sql(f"SELECT symbol, date, t, {_MOM} AS raw FROM m_feat", "raw")}) b ON a.symbol = b.symbol AND a.t = b.t""")
view("m_lv", "SELECT *, ln(1 + volume) AS log_volume FROM m_feat")
view("m_sig_volume", rank_sql(f"SELECT symbol, date, t, ({fast_z_sql('log_volume', 20)}) * sign({_MOM}) AS raw FROM m_lv", "raw"))


@query("sig_02", "SELECT symbol, date, round(score, 6) AS score FROM m_sig_trend")
def _(m):
    return G.short_trend(features(m)).select("symbol", "date", r6("score", "score"))


@query("sig_03", "SELECT symbol, date, round(score, 6) AS score FROM m_sig_squeeze")
def _(m):
    return G.short_squeeze(features(m)).select("symbol", "date", r6("score", "score"))


@query("sig_04", "SELECT symbol, date, round(score, 6) AS score FROM m_sig_volume")
def _(m):
    return G.volume_anomaly(features(m)).select("symbol", "date", r6("score", "score"))


@query("sig_01", "SELECT symbol, date, round(score, 6) AS score FROM m_sig_volume WHERE date < DATE '1998-01-01'")
def _(m):
    """The contract: scores up to a date need no row after it."""
    panel = features(m).where(F.col("date") < "1998-01-01")
    return G.SIGNALS["volume_anomaly"](panel).select("symbol", "date", r6("score", "score"))


def bank_sql() -> dict[str, str]:
    return {
        "returns_1d": "returns", "returns_z20": fast_z_sql("returns", 20), "returns_z5": fast_z_sql("returns", 5),
        "returns_slope20": slope_sql("returns", 20), "log_volume": "log_volume", "volume_z20": fast_z_sql("log_volume", 20),
        "volume_z5": fast_z_sql("log_volume", 5), "short_pct": "short_pct", "short_z20": fast_z_sql("short_pct", 20),
        "short_slope20": slope_sql("short_pct", 20), "hl_spread": "hl_spread", "hl_z20": fast_z_sql("hl_spread", 20), "gap": "gap"}


view("m_bank", "SELECT symbol, date, t, valid, " + ", ".join(f"{sql} AS {name}" for name, sql in bank_sql().items()) + " FROM m_lv")


@query("sig_05", "SELECT symbol, date, " + ", ".join(f"round({c}, 4) AS {c}" for c in G.BANK) + " FROM m_bank")
def _(m):
    return G.feature_bank(features(m)).select("symbol", "date", *[r6(c, c, 4) for c in G.BANK])


_LASTFUND = "SELECT * FROM m_fundamentals QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"
view("m_factor", f"""
    WITH b AS (SELECT c.*, s.short, lag(close) OVER (PARTITION BY c.symbol ORDER BY c.date) AS prev FROM m_close c
               LEFT JOIN m_shorts s ON s.symbol = c.symbol AND s.date = c.date),
    r AS (SELECT *, close / prev - 1 AS ret FROM b),
    v AS (SELECT *, {tail_sql('ret', 24, 20)} AS tr, {tail_sql('volume', 25, 20)} AS v20, {tail_sql('volume', 25, 5)} AS v5, {tail_sql('short', 25, 20)} AS sv FROM r)
    SELECT v.symbol, v.date, short AS short_pct, (high - low) / close AS hl_spread, open / prev - 1 AS gap, close / prev - 1 AS returns_1d,
      {tail_z_sql('tr')} AS returns_z20, {tail_z_sql('v20')} AS volume_z20, {tail_z_sql('v5')} AS volume_z5, {tail_z_sql('sv')} AS short_z20,
      {tail_slope_sql('tr')} AS returns_slope20, {tail_slope_sql('sv')} AS short_slope20,
      f.trailing_pe AS f_trailing_pe, f.return_on_equity AS f_return_on_equity, f.dividend_yield AS f_dividend_yield, f.debt_to_equity AS f_debt_to_equity
    FROM v LEFT JOIN ({_LASTFUND}) f ON f.symbol = v.symbol""")
FUND = ("trailing_pe", "return_on_equity", "dividend_yield", "debt_to_equity")
ALL_FACTORS = (*G.FACTORS, *[f"f_{c}" for c in FUND])


def factors(m, bars=None):
    snapshot = latest(m.fundamentals, "symbol", "date", *FUND)
    return G.factor_bank(closes(m) if bars is None else bars, m.shorts, snapshot)


@query("sig_06", "SELECT symbol, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ALL_FACTORS) + " FROM m_factor")
def _(m):
    return factors(m).select("symbol", "date", *[r6(c, c) for c in ALL_FACTORS])


@query("sig_07", """SELECT v.symbol, v.date, round(v.score, 4) AS score, s.name, s.industry FROM m_sig_volume v LEFT JOIN m_symbols s USING (symbol)
       WHERE v.date = (SELECT max(date) FROM m_sig_volume) AND v.score IS NOT NULL""")
def _(m):
    return G.latest_scores(G.volume_anomaly(features(m)), m.symbols)


_MERGED = " UNION ALL ".join(f"SELECT symbol, '{n}' AS s, round(score, 4) AS score FROM {v} WHERE date = (SELECT max(date) FROM {v}) AND score IS NOT NULL"
                             for n, v in (("short_trend", "m_sig_trend"), ("short_squeeze", "m_sig_squeeze"), ("volume_anomaly", "m_sig_volume")))


@query("sig_08", f"""SELECT symbol, max(score) FILTER (s = 'short_trend') AS short_trend, max(score) FILTER (s = 'short_squeeze') AS short_squeeze,
       max(score) FILTER (s = 'volume_anomaly') AS volume_anomaly FROM ({_MERGED}) GROUP BY symbol""")
def _(m):
    return G.merged_latest(features(m), m.symbols)


@query("sig_09", """SELECT count(*) AS n, round(corr(s.score, f.fwd), 6) AS r FROM m_sig_volume s
       JOIN (SELECT a.symbol, a.t, b.close / a.close - 1 AS fwd FROM m_panel a JOIN m_panel b ON b.symbol = a.symbol AND b.t = a.t + 1) f
       ON f.symbol = s.symbol AND f.t = s.t + 1 WHERE s.score IS NOT NULL""")
def _(m):
    forward = m.panel.select("symbol", "t", R.forward_return("close", 1).alias("fwd"))
    return G.lookahead_correlation(G.volume_anomaly(features(m)), forward).select("n", r6("r", "r"))


@query("sig_10", """
    WITH c AS (SELECT CASE event_type WHEN 'click' THEN 'AFRICA' WHEN 'error' THEN 'AMERICA' WHEN 'purchase' THEN 'ASIA' WHEN 'signup' THEN 'EUROPE' ELSE 'MIDDLE EAST' END AS industry,
                      DATE '2001-10-01' + CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INT) AS date, event_type FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS ts FROM events)),
    p AS (SELECT id, DATE '2001-10-01' + CAST(date - DATE '2024-01-01' AS INT) AS date, price / lag(price, 5) OVER (PARTITION BY id ORDER BY date) - 1 AS m FROM m_series),
    i AS (SELECT DISTINCT industry, event_type FROM c)
    """ + rank_sql("SELECT b.symbol, b.date, b.t, p.m AS raw FROM m_panel b JOIN m_symbols s USING (symbol) JOIN i ON i.industry = s.industry JOIN p ON p.id = i.event_type AND p.date = b.date WHERE p.m IS NOT NULL", "raw").replace("SELECT symbol, date, t, CASE", "SELECT symbol, date, CASE", 1))
def _(m):
    """The derived series stand in for commodities, moved into the last weeks of the bars."""
    moved = F.date_add(F.lit("2001-10-01").cast("date"), F.datediff("date", F.lit("2024-01-01").cast("date")))
    prices = m.series.withColumn("date", moved)
    industry = (F.when(F.col("id") == "click", "AFRICA").when(F.col("id") == "error", "AMERICA")
                .when(F.col("id") == "purchase", "ASIA").when(F.col("id") == "signup", "EUROPE").otherwise("MIDDLE EAST"))
    sectors = m.series.select("id").distinct().select("id", industry.alias("industry"))
    return G.commodity_lead(m.panel, m.symbols, prices, sectors).select("symbol", "date", "score")


@query("sig_11", """SELECT f.symbol, f.date, round(f.score, 4) AS score, s.name, s.industry FROM m_forecasts f LEFT JOIN m_symbols s USING (symbol)
       WHERE f.date = (SELECT max(date) FROM m_forecasts)""")
def _(m):
    return G.latest_scores(m.forecasts, m.symbols)
