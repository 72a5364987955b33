"""TOP: sorting, limits and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.base import query
from barograph.catalog.rolling import r6
from barograph.operators.latest import first_n
from barograph.sources.market import CUT


@query("top_01", """SELECT f.symbol, f.date, f.score FROM m_forecasts f JOIN m_symbols s USING (symbol)
       WHERE s.industry = 'ASIA' ORDER BY f.score DESC, f.date, f.symbol LIMIT 20""")
def _(m):
    wanted = m.symbols.where(F.col("industry") == "ASIA").select("symbol")
    return m.forecasts.join(wanted, "symbol", "left_semi").select("symbol", "date", "score").orderBy(
        F.col("score").desc(), "date", "symbol").limit(20)


@query("top_02", """
    SELECT side, date, symbol, score, rn FROM (
      SELECT 'long_top' AS side, date, symbol, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol DESC) AS rn FROM m_forecasts
      UNION ALL SELECT 'long_bottom', date, symbol, score, row_number() OVER (PARTITION BY date ORDER BY score, symbol) FROM m_forecasts)
    WHERE rn <= 3""")
def _(m):
    top = first_n(m.forecasts, ["date"], [F.col("score").desc(), F.col("symbol").desc()], 3).withColumn("side", F.lit("long_top"))
    low = first_n(m.forecasts, ["date"], ["score", "symbol"], 3).withColumn("side", F.lit("long_bottom"))
    return top.unionByName(low).select("side", "date", "symbol", "score", F.col("rn").cast("long").alias("rn"))


@query("top_03", """SELECT symbol, ex_date, amount, rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ex_date DESC) AS rn
       FROM m_dividends) WHERE rn <= 6""")
def _(m):
    return first_n(m.dividends, ["symbol"], [F.col("ex_date").desc()], 6).withColumn("rn", F.col("rn").cast("long"))


@query("top_04", """
    WITH d AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM m_shorts) ORDER BY date DESC LIMIT 2)
    SELECT s.symbol, max(s.short) FILTER (k = 1) AS short, max(s.short) FILTER (k = 2) AS prev_short, max(m.name) AS name,
           max(s.date) FILTER (k = 1) AS date
    FROM m_shorts s JOIN d USING (date) LEFT JOIN m_symbols m ON m.symbol = s.symbol WHERE length(s.symbol) = 9
    GROUP BY s.symbol HAVING max(s.short) FILTER (k = 1) IS NOT NULL""")
def _(m):
    return latest_reports(m.shorts, m.symbols, 9)


def latest_reports(shorts, symbols, code_length):
    """Latest two report dates side by side for codes of one length."""
    dates = shorts.select("date").distinct().orderBy(F.col("date").desc()).limit(2)
    newest = shorts.agg(F.max("date")).scalar()
    rows = shorts.where(F.length("symbol") == code_length).join(F.broadcast(dates), "date")  # two dates
    on_newest = F.col("date") == newest
    wide = rows.groupBy("symbol").agg(
        F.max(F.when(on_newest, F.col("short"))).alias("short"),
        F.max(F.when(~on_newest, F.col("short"))).alias("prev_short"),
        F.max(F.when(on_newest, F.col("date"))).alias("date"))
    return wide.where(F.col("date").isNotNull()).join(symbols.select("symbol", "name"), "symbol", "left").select(
        "symbol", "short", "prev_short", "name", "date").orderBy(F.col("short").desc(), "symbol")


@query("top_05", """
    WITH tr AS (SELECT * FROM m_forecasts WHERE date < DATE '2000-07-01'),
    el AS (SELECT symbol FROM m_shorts WHERE date < DATE '2000-07-01' GROUP BY symbol HAVING arg_max(short, date) >= 0.5)
    SELECT symbol, score FROM tr WHERE date = (SELECT max(date) FROM tr) AND symbol IN (SELECT symbol FROM el)
    ORDER BY score DESC, symbol LIMIT 10""")
def _(m):
    train = m.forecasts.where(F.col("date") < F.lit(CUT))
    return top_eligible(train, eligible(m.shorts.where(F.col("date") < F.lit(CUT))), 10)


def eligible(shorts, least: float = 0.5):
    return shorts.where(F.col("short").isNotNull()).groupBy("symbol").agg(
        F.max_by("short", "date").alias("last")).where(F.col("last") >= least).select("symbol")


def top_eligible(scores, allowed, n):
    last = scores.agg(F.max("date")).scalar()
    return scores.where((F.col("date") == last) & F.col("score").isNotNull()).join(allowed, "symbol", "left_semi").select(
        "symbol", "score").orderBy(F.col("score").desc(), "symbol").limit(n)


@query("top_06", """
    SELECT symbol, name, current FROM (
      SELECT symbol, name, current, CASE WHEN symbol LIKE 'NATION_1%' THEN 0 ELSE 1 END AS prio FROM m_symbols
      WHERE (symbol LIKE 'NATION_1%' OR upper(name) LIKE '%NATION_1%') AND current
      UNION ALL SELECT option_symbol, share_symbol || ' option exp ' || strftime(expiry, '%Y-%m-%d'), TRUE,
             CASE WHEN option_symbol LIKE 'NATION_1%' THEN 0 ELSE 1 END FROM m_options WHERE option_symbol LIKE 'P1%')
    ORDER BY prio, symbol LIMIT 10""")
def _(m):
    return search(m.symbols.where("current"), m.options, "NATION_1", "P1", 10)


def search(symbols, options, text, option_text, n):
    """Prefix hits first, then names containing the text, options appended."""
    hit = F.col("symbol").startswith(text)
    shares = symbols.where(hit | F.upper("name").contains(text)).select(
        "symbol", "name", "current", F.when(hit, 0).otherwise(1).alias("prio"))
    contracts = options.where(F.col("option_symbol").startswith(option_text)).select(
        F.col("option_symbol").alias("symbol"),
        F.concat("share_symbol", F.lit(" option exp "), F.date_format("expiry", "yyyy-MM-dd")).alias("name"),
        F.lit(True).alias("current"), F.when(F.col("option_symbol").startswith(text), 0).otherwise(1).alias("prio"))
    return shares.unionByName(contracts).orderBy("prio", "symbol").limit(n).drop("prio")
