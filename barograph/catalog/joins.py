"""JOI: every logical join, by key, by time and by interval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.catalog.filters import closes
from barograph.catalog.rolling import features, r6
from barograph.operators import asof
from barograph.operators import rolling as R
from barograph.operators.latest import last_two, latest


@query("joi_01", "SELECT s.symbol, s.date, s.short, m.name FROM m_shorts s LEFT JOIN m_symbols m ON m.symbol = s.symbol AND m.current")
def _(m):
    names = m.symbols.where("current").select("symbol", "name")  # at most one row per nation
    return m.shorts.join(names, "symbol", "left").select("symbol", "date", "short", "name")


@query("joi_02", """SELECT e.symbol, e.date, e.ratio, s.industry FROM m_events e JOIN m_symbols s USING (symbol)
       WHERE e.date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def _(m):
    return m.events.where(F.col("date").between("1996-01-01", "1999-12-31")).join(
        m.symbols.select("symbol", "industry"), "symbol").select("symbol", "date", "ratio", "industry")


@query("joi_03", """
    SELECT p.symbol, p.date, p.close, p.volume, s.short, f.trailing_pe FROM
      (SELECT * FROM m_close QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) p
    LEFT JOIN (SELECT * FROM m_shorts QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) s ON s.symbol = p.symbol
    LEFT JOIN (SELECT * FROM m_fundamentals QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) f ON f.symbol = p.symbol""")
def _(m):
    price = latest(closes(m), "symbol", "date", "close", "volume")
    short = latest(m.shorts, "symbol", "date", "short").drop("date")
    fund = latest(m.fundamentals, "symbol", "date", "trailing_pe").drop("date")
    return price.join(short, "symbol", "left").join(fund, "symbol", "left")


@query("joi_04", """
    SELECT symbol, max(date) FILTER (rn = 1) AS date, max(close) FILTER (rn = 1) AS price, max(close) FILTER (rn = 2) AS prev
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM m_close) GROUP BY symbol""")
def _(m):
    return last_two(closes(m), "symbol", "date", "close")


@query("joi_05", "SELECT option_symbol, share_symbol FROM m_options WHERE share_symbol IN (SELECT symbol FROM m_events WHERE ratio > 1)")
def _(m):
    split = m.events.where(F.col("ratio") > 1).select(F.col("symbol").alias("share_symbol"))
    return m.options.select("option_symbol", "share_symbol").join(split, "share_symbol", "left_semi")


@query("joi_06", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def _(m):
    large = m.table("orders").where(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return m.table("customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@query("joi_07", """
    WITH pts AS (SELECT symbol, CAST(d AS DATE) AS boundary FROM (SELECT DISTINCT symbol FROM m_bars)
                 CROSS JOIN range(DATE '1995-02-01', DATE '2001-12-31', INTERVAL 1 MONTH) r(d))
    SELECT p.symbol, p.boundary, arg_max(b.close, b.date) AS close, max(b.date) AS close_date
    FROM pts p JOIN m_close b ON b.symbol = p.symbol AND b.date <= p.boundary AND b.date >= p.boundary - 10
    GROUP BY 1, 2""")
def _(m):
    points = m.symbols.select("symbol", F.explode(F.sequence(
        F.to_date(F.lit("1995-02-01")), F.to_date(F.lit("2001-12-01")), F.expr("INTERVAL 1 MONTH"))).alias("boundary"))
    return asof.backward_within(points, closes(m), "symbol", "boundary", "date", "close", 10)


@query("joi_08", """
    WITH t AS (SELECT * FROM (VALUES (31), (365), (1095)) v(days))
    SELECT symbol, days, coalesce(arg_min(close, date) FILTER (date >= as_of - days), arg_max(close, date)) AS ref
    FROM m_monthend, m_asof, t GROUP BY symbol, days""")
def _(m):
    from barograph.operators.merge import month_ends

    ends = month_ends(closes(m))
    looks = (31, 365, 1095)
    wide = ends.groupBy("symbol").agg(F.max_by("close", "date").alias("last"), *[
        F.min_by("close", F.when(F.col("date") >= F.date_sub(m.as_of(), d), F.col("date"))).alias(f"d{d}") for d in looks])
    return wide.select("symbol", F.explode(F.array(*[
        F.struct(F.lit(d).alias("days"), F.coalesce(f"d{d}", "last").alias("ref")) for d in looks])).alias("x")
    ).select("symbol", "x.days", "x.ref")


@query("joi_09", "SELECT symbol, date, short_pct FROM m_short_fill")
def _(m):
    return features(m).select("symbol", "date", "short_pct")


view("m_aligned", """SELECT o.symbol AS option_symbol, p.share_symbol, o.date, o.close AS w_close, b.close AS u_close, b.volume AS u_volume
    FROM m_option_bars o JOIN m_options p ON p.option_symbol = o.symbol
    JOIN m_close b ON b.symbol = p.share_symbol AND b.date = o.date""")


def aligned(m):
    """Warrant rows with the underlying's row of the same date."""
    warrants = m.option_bars.select(F.col("symbol").alias("option_symbol"), "date", F.col("close").alias("w_close"))
    under = closes(m).select(F.col("symbol").alias("share_symbol"), "date", F.col("close").alias("u_close"),
                             F.col("volume").alias("u_volume"))
    return warrants.join(m.options.select("option_symbol", "share_symbol"), "option_symbol").join(
        under, ["share_symbol", "date"])


@query("joi_10", "SELECT option_symbol, share_symbol, date, w_close, u_close FROM m_aligned")
def _(m):
    return aligned(m).select("option_symbol", "share_symbol", "date", "w_close", "u_close")


@query("joi_11", """SELECT b.symbol, b.date, b.close, coalesce(s.short, 0.0) AS shorts_pct FROM m_close b
       LEFT JOIN m_shorts s ON s.symbol = b.symbol AND s.date = b.date""")
def _(m):
    return closes(m).join(m.shorts, ["symbol", "date"], "left").select(
        "symbol", "date", "close", F.coalesce("short", F.lit(0.0)).alias("shorts_pct"))


@query("joi_12", """SELECT b.symbol, b.date, round(b.close / i.close - 1, 6) AS excess FROM m_close b LEFT JOIN m_index i USING (date)""")
def _(m):
    index = m.index.select("date", F.col("close").alias("index_close"))  # one row per day
    return closes(m).join(F.broadcast(index), "date", "left").select(
        "symbol", "date", r6(F.col("close") / F.col("index_close") - 1, "excess"))


@query("joi_13", """
    SELECT sa.symbol AS leader, sb.symbol AS follower, CAST(k AS INTEGER) AS lag_days, round(coalesce(sum(a.returns * b.returns), 0.0), 6) AS sxy
    FROM m_symbols sa JOIN m_symbols sb ON sb.industry = sa.industry JOIN range(1, 21) r(k) ON TRUE
    LEFT JOIN m_feat a ON a.symbol = sa.symbol LEFT JOIN m_feat b ON b.symbol = sb.symbol AND b.t = a.t + k
    GROUP BY 1, 2, 3""")
def _(m):
    """Series i at t against series j at t + 1..20 inside each industry, 0 for pairs that never meet. The logical
    self-join is summed by blocks, so no pair of rows is ever formed."""
    from barograph.plans.leadlag import lagged_moments

    rows = R.with_step_features(m.panel).join(m.symbols.select("symbol", "industry"), "symbol").select(
        "industry", "symbol", "t", m.calendar.agg(F.count(F.lit(1))).scalar().alias("slots"), F.col("returns").alias("x"))
    return lagged_moments(rows, ["industry"], 20).select("leader", "follower", "lag_days", r6("sxy", "sxy"))


@query("joi_14", """SELECT o.option_symbol, o.share_symbol, o.fetched_at, e.date AS event_date, e.ratio
       FROM m_options o JOIN m_events e ON e.symbol = o.share_symbol AND e.date > o.fetched_at""")
def _(m):
    events = m.events.select(F.col("symbol").alias("share_symbol"), F.col("date").alias("event_date"), "ratio")
    # one event a day and underlying at most, of a fixed number of underlyings; options stay spread by their own key
    return m.options.select("option_symbol", "share_symbol", "fetched_at").join(F.broadcast(events), "share_symbol").where(
        F.col("event_date") > F.col("fetched_at"))


@query("joi_15", """
    WITH fy AS (SELECT symbol, y::BIGINT AS fy_year, make_date(y - 1, 7, 1) AS a, make_date(y, 6, 30) AS b
                FROM (SELECT DISTINCT symbol FROM m_bars) CROSS JOIN range(1996, 2002) r(y))
    SELECT symbol, fy_year, EXISTS (SELECT 1 FROM m_events e WHERE e.symbol = fy.symbol AND e.date BETWEEN a AND b) AS has_event FROM fy""")
def _(m):
    """Interval containment: fiscal years do not overlap, so the containing year is a
    function of the event date and the range join becomes an equi-join."""
    years = m.symbols.select("symbol", F.explode(F.sequence(F.lit(1996).cast("long"), F.lit(2001).cast("long"))).alias("fy_year"))
    fy = (F.year("date") + F.when(F.month("date") >= 7, 1).otherwise(0)).cast("long")
    hit = m.events.select("symbol", fy.alias("fy_year")).distinct().withColumn("hit", F.lit(True))
    return years.join(hit, ["symbol", "fy_year"], "left").select(
        "symbol", "fy_year", F.col("hit").isNotNull().alias("has_event"))


@query("joi_16", """
    SELECT s.symbol, s.date AS signal_date, b.date AS buy_date, x.date AS sell_date, b.open AS buy_price, x.close AS sell_price
    FROM m_panel s JOIN m_panel b ON b.symbol = s.symbol AND b.t = s.t + 1 JOIN m_panel x ON x.symbol = s.symbol AND x.t = s.t + 3""")
def _(m):
    w = R.series()

    def at(col, k):
        return F.first(col).over(w.rangeBetween(k, k))

    rows = m.panel.select(
        "symbol", F.col("date").alias("signal_date"), at("date", 1).alias("buy_date"), at("date", 3).alias("sell_date"),
        at("open", 1).alias("buy_price"), at("close", 3).alias("sell_price"))
    return rows.where(F.col("buy_date").isNotNull() & F.col("sell_date").isNotNull())


@query("joi_19", """SELECT symbol AS old, arg_max(ratio, date) AS ratio, max(date) AS effective_date FROM m_events GROUP BY symbol""")
def _(m):
    return m.events.groupBy(F.col("symbol").alias("old")).agg(
        F.max_by("ratio", "date").alias("ratio"), F.max("date").alias("effective_date"))


view("m_actual", """
    SELECT symbol, date, t, lead(close, 5) OVER w / close - 1 AS actual FROM m_panel WINDOW w AS (PARTITION BY symbol ORDER BY t)""")


def actuals(m):
    """Return from each row to the symbol's fifth next row."""
    return m.panel.select("symbol", "date", (F.lead("close", 5).over(R.series()) / F.col("close") - 1).alias("actual"))


def forecast_actual(m):
    return m.forecasts.join(actuals(m), ["symbol", "date"]).where(F.col("actual").isNotNull())


@query("joi_20", """SELECT f.symbol, f.date, f.score, round(a.actual, 6) AS actual FROM m_forecasts f
       JOIN m_actual a ON a.symbol = f.symbol AND a.date = f.date WHERE a.actual IS NOT NULL""")
def _(m):
    return forecast_actual(m).select("symbol", "date", "score", r6("actual", "actual"))
