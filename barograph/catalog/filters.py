"""FIL: predicates and key filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.catalog.rolling import r6
from barograph.operators import filters as P
from barograph.sources.market import CUT

_CUT = "DATE '2000-07-01'"

view("m_close", "SELECT symbol, date, open, high, low, vwap AS close, volume FROM m_bars")


def closes(m):
    """Bars with the smooth close."""
    return m.bars.select("symbol", "date", "open", "high", "low", F.col("vwap").alias("close"), "volume")


@query("fil_01", f"""SELECT 'train' AS part, symbol, date FROM m_bars WHERE date < {_CUT}
       UNION ALL SELECT 'backtest', symbol, date FROM m_bars WHERE date >= {_CUT}
       UNION ALL SELECT 'all', symbol, date FROM m_bars""")
def _(m):
    keys = m.trading_days
    parts = [P.split(keys, part, CUT).select(F.lit(part).alias("part"), "symbol", "date")
             for part in ("train", "backtest", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("fil_02", "SELECT symbol, count(*) AS n FROM m_bars GROUP BY symbol HAVING count(*) >= 1400")
def _(m):
    return P.symbols_with_history(m.trading_days, 1400)


@query("fil_03", """SELECT symbol, date, close FROM m_close
       WHERE symbol IN (SELECT symbol FROM m_close GROUP BY symbol HAVING count(*) >= 1400)""")
def _(m):
    return P.with_history(closes(m).select("symbol", "date", "close"), 1400)


@query("fil_04", f"""
    WITH tr AS (SELECT * FROM m_close WHERE date < {_CUT})
    SELECT symbol, round(median(close * volume), 4) AS median_value, count(*) AS n_days FROM tr GROUP BY symbol
    HAVING median(close * volume) >= 20000 AND count(*) >= CAST(floor(0.5 * (SELECT count(DISTINCT date) FROM tr)) AS BIGINT)""")
def _(m):
    return P.liquid_symbols(P.split(closes(m), "train", CUT), 20000, 0.5).select(
        "symbol", r6("median_value", "median_value", 4), "n_days")


@query("fil_05", """
    SELECT 'price' AS kind, date, round(close, 6) AS value FROM m_close WHERE symbol = 'NATION_3' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
    UNION ALL SELECT 'index', date, round(close, 6) FROM m_index WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
    UNION ALL SELECT 'short', date, short FROM m_shorts WHERE symbol = 'NATION_3' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
    UNION ALL SELECT 'event', date, ratio FROM m_events WHERE symbol = 'NATION_3' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def _(m):
    span = F.col("date").between("1997-01-01", "1998-12-31")
    own = F.col("symbol") == "NATION_3"

    def pick(df, kind, value):
        return df.where(span).select(F.lit(kind).alias("kind"), "date", F.col(value).alias("value"))

    return (
        pick(closes(m).where(own).withColumn("close", F.round("close", 6)), "price", "close")
        .unionByName(pick(m.index.withColumn("close", F.round("close", 6)), "index", "close"))
        .unionByName(pick(m.shorts.where(own), "short", "short"))
        .unionByName(pick(m.events.where(own), "event", "ratio"))
    )


@query("fil_06", """SELECT symbol, date, close FROM m_close WHERE symbol IN ('NATION_1', 'NATION_2', 'NATION_9')
       AND date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'""")
def _(m):
    return closes(m).where(
        F.upper(F.trim("symbol")).isin("NATION_1", "NATION_2", "NATION_9")
        & F.col("date").between("1999-01-01", "1999-12-31")).select("symbol", "date", "close")


@query("fil_11", "SELECT symbol, name, industry FROM m_symbols WHERE contains(lower(industry), 'asi') ORDER BY symbol LIMIT 500")
def _(m):
    return m.symbols.where(F.lower("industry").contains("ASI".lower())).select(
        "symbol", "name", "industry").orderBy("symbol").limit(500)


@query("fil_12", """SELECT symbol, name FROM m_symbols s WHERE EXISTS
       (SELECT 1 FROM m_bars b, m_asof WHERE b.symbol = s.symbol AND b.date >= as_of - 14)""")
def _(m):
    recent = m.trading_days.where(F.col("date") >= F.date_sub(m.as_of(), 14))
    return m.symbols.select("symbol", "name").join(recent, "symbol", "left_semi")


@query("fil_13", """SELECT symbol, name FROM m_symbols WHERE upper(name) NOT LIKE '%OPTION%' AND upper(name) NOT LIKE '%WARRANT%'
       AND symbol NOT IN (SELECT option_symbol FROM m_options)""")
def _(m):
    name = F.upper("name")
    plain = m.symbols.where(~name.like("%OPTION%") & ~name.like("%WARRANT%"))
    codes = m.options.select(F.col("option_symbol").alias("symbol"))
    return plain.select("symbol", "name").join(codes, "symbol", "left_anti")


@query("fil_14", """
    WITH st AS (SELECT symbol, count(*) AS n, max(date) AS last_date, max(mv) AS max_move FROM
      (SELECT symbol, date, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS mv FROM m_close) GROUP BY symbol)
    SELECT st.symbol, n, last_date, round(max_move, 6) AS max_move FROM st JOIN m_symbols USING (symbol), m_asof
    WHERE current AND n >= 520 AND last_date >= as_of - 60 AND coalesce(max_move, 0) <= 12.0""")
def _(m):
    return P.modelling_universe(closes(m), m.symbols, m.as_of(), 520, 60, 12.0).select(
        "symbol", "n", "last_date", r6("max_move", "max_move"))


view("m_bad", """SELECT *, coalesce(close / prev > 4 OR close / prev < 0.25, FALSE) AS bad
    FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM m_close)""")


@query("fil_15", "SELECT symbol, date, close FROM m_bad WHERE bad")
def _(m):
    return P.with_bad_price_flag(closes(m)).where("bad").select("symbol", "date", "close")


@query("fil_16", """SELECT symbol, date FROM (SELECT symbol, date, max(bad::INT) OVER
       (PARTITION BY symbol ORDER BY date ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS b FROM m_bad) WHERE b = 0""")
def _(m):
    return P.without_recent_bad(P.with_bad_price_flag(closes(m))).select("symbol", "date")


@query("fil_17", """
    WITH tr AS (SELECT a.symbol, a.date AS buy_date, b.date AS sell_date FROM m_panel a JOIN m_panel b
                ON a.symbol = b.symbol AND b.t = a.t + 5)
    SELECT symbol, buy_date, sell_date FROM tr WHERE NOT EXISTS
      (SELECT 1 FROM m_bad d WHERE d.symbol = tr.symbol AND d.bad AND d.date BETWEEN tr.buy_date AND tr.sell_date)""")
def _(m):
    """Trades of five slots whose span holds no bad date (counted with a running total,
    so no trade-by-bad-date range join is needed)."""
    return spans_without_bad(m, 5)


def spans_without_bad(m, horizon):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("t")
    flagged = P.with_bad_price_flag(m.panel).withColumn("bad", F.col("bad").cast("int"))
    total = F.sum("bad").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = flagged.select("symbol", "t", "date", "bad", total.alias("total"))
    at = w.rangeBetween(horizon, horizon)
    spans = rows.select(
        "symbol", F.col("date").alias("buy_date"), F.first("date").over(at).alias("sell_date"),
        (F.first("total").over(at) - F.col("total") + F.col("bad")).alias("inside"))
    return spans.where(F.col("sell_date").isNotNull() & (F.col("inside") == 0)).drop("inside")


@query("fil_18", """SELECT symbol, arg_max(short, date) AS short FROM m_shorts WHERE short IS NOT NULL AND short < 100
       GROUP BY symbol HAVING arg_max(short, date) >= 0.5""")
def _(m):
    known = m.shorts.where(F.col("short") < 100)
    return known.groupBy("symbol").agg(F.max_by("short", "date").alias("short")).where(F.col("short") >= 0.5)


_HOLIDAYS = ", ".join(f"'{d}'" for d in P.SAMPLE_HOLIDAYS)


@query("fil_19", f"""SELECT date, strftime(date, '%Y-%m-%d') IN ({_HOLIDAYS}) AS closed, isodow(date) >= 6 AS weekend FROM m_cal""")
def _(m):
    return m.calendar.select("date", P.market_closed(F.col("date"), P.SAMPLE_HOLIDAYS).alias("closed"),
                             P.weekend(F.col("date")).alias("weekend"))
