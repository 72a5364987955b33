"""SET: unions, differences, intersections and priority merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.base import query
from barograph.operators import sets as S
from barograph.sources.market import CUT


@query("set_01", "SELECT symbol, name, 'share' AS kind FROM m_symbols UNION ALL SELECT option_symbol, share_symbol, 'option' FROM m_options")
def _(m):
    return S.union_named(
        m.symbols.select("symbol", "name", F.lit("share").alias("kind")),
        m.options.select(F.col("option_symbol").alias("symbol"), F.col("share_symbol").alias("name"), F.lit("option").alias("kind")))


@query("set_02", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN
       (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')""")
def _(m):
    asked = m.table("customer").select("c_custkey")
    got = m.table("orders").where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("c_custkey"))
    return S.missing_from(asked, got, "c_custkey")


@query("set_03", """SELECT DISTINCT date FROM m_bars WHERE symbol = 'NATION_1' INTERSECT SELECT DISTINCT date FROM m_bars WHERE symbol = 'NATION_2'""")
def _(m):
    def dates(symbol):
        return m.trading_days.where(F.col("symbol") == symbol).select("date")

    return dates("NATION_1").intersect(dates("NATION_2"))


@query("set_04", """
    WITH a AS (SELECT symbol, date, short AS v FROM m_shorts WHERE short > 0),
    b AS (SELECT symbol, date, close AS v FROM m_close WHERE date >= DATE '2001-01-01' AND close > 0)
    SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.date, b.date) AS date, coalesce(a.v, b.v) AS v,
           CASE WHEN a.v IS NOT NULL THEN 'primary' ELSE 'fallback' END AS source
    FROM a FULL JOIN b ON a.symbol = b.symbol AND a.date = b.date""")
def _(m):
    primary = m.shorts.withColumnRenamed("short", "v")
    fallback = m.bars.where(F.col("date") >= "2001-01-01").select("symbol", "date", F.col("vwap").alias("v"))
    return S.source_priority(primary, fallback, ["symbol", "date"], "v")


@query("set_05", """
    SELECT symbol, arg_min(signal, row(prio, rn)) AS signal, arg_min(score, row(prio, rn)) AS score FROM (
      SELECT 1 AS prio, 'forecast' AS signal, symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS rn
      FROM m_forecasts WHERE date = (SELECT max(date) FROM m_forecasts)
      UNION ALL SELECT 2, 'short', symbol, short, row_number() OVER (ORDER BY short DESC, symbol) FROM m_shorts WHERE date = (SELECT max(date) FROM m_shorts))
    WHERE rn <= 10 GROUP BY symbol""")
def _(m):
    books = []
    for prio, (signal, rows, value) in enumerate((("forecast", m.forecasts, "score"), ("short", m.shorts, "short")), 1):
        last = rows.agg(F.max("date")).scalar()
        top = rows.where(F.col("date") == last).orderBy(F.col(value).desc(), "symbol").limit(10)
        books.append(top.select("symbol", F.col(value).alias("score"), F.lit(signal).alias("signal"),
                                F.lit(prio).alias("prio"), (-F.col(value)).alias("order")))
    return S.first_wins(books[0].unionByName(books[1]), "symbol", ["prio", "order", "symbol"], "signal", "score")
