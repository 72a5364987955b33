"""MRG: table maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barograph.catalog.base import query
from barograph.catalog.filters import closes
from barograph.operators import merge as M
from barograph.sources.market import CUT

_K = "symbol, date"


def base(m):
    return closes(m).select("symbol", "date", "close")


def old(m):
    return base(m).where(F.col("date") < "2000-02-01")


def new(m):
    return base(m).where(F.col("date") >= "2000-01-01").withColumn("close", F.col("close") + 1)


_OLD = "(SELECT symbol, date, close FROM m_close WHERE date < DATE '2000-02-01')"
_NEW = "(SELECT symbol, date, close + 1 AS close FROM m_close WHERE date >= DATE '2000-01-01')"


@query("mrg_01", f"SELECT symbol, date, coalesce(n.close, o.close) AS close FROM {_OLD} o FULL JOIN {_NEW} n USING (symbol, date)")
def _(m):
    return M.upsert(old(m), new(m), ["symbol", "date"])


@query("mrg_02", f"SELECT symbol, date, coalesce(o.close, n.close) AS close FROM {_OLD} o FULL JOIN {_NEW} n USING (symbol, date)")
def _(m):
    return M.insert_or_ignore(old(m), new(m), ["symbol", "date"])


@query("mrg_03", """SELECT option_symbol, CASE WHEN o.option_symbol IS NULL THEN n.exercise WHEN o.note LIKE '%(was %)' OR n.option_symbol IS NULL THEN o.exercise ELSE n.exercise END AS exercise,
       CASE WHEN o.option_symbol IS NULL THEN n.note WHEN o.note LIKE '%(was %)' OR n.option_symbol IS NULL THEN o.note ELSE n.note END AS note
       FROM (SELECT option_symbol, exercise, CASE WHEN note = 'P' THEN 'C (was P)' ELSE note END AS note FROM m_options WHERE fetched_at < DATE '1999-01-01') o
       FULL JOIN (SELECT option_symbol, exercise * 2 AS exercise, note FROM m_options WHERE fetched_at >= DATE '1996-06-01') n USING (option_symbol)""")
def _(m):
    """Rows corrected by hand carry '(was …)' in the note and are kept."""
    note = F.when(F.col("note") == "P", "C (was P)").otherwise(F.col("note"))
    have = m.options.where(F.col("fetched_at") < "1999-01-01").select("option_symbol", "exercise", note.alias("note"))
    incoming = m.options.where(F.col("fetched_at") >= "1996-06-01").select(
        "option_symbol", (F.col("exercise") * 2).alias("exercise"), "note")
    return M.conditional_upsert(have, incoming, "option_symbol", F.col("note").like("%(was %)"))


@query("mrg_04", """SELECT symbol, date, close FROM m_close WHERE date > DATE '1999-12-31'
       UNION ALL SELECT symbol, date, close + 1 FROM m_close WHERE date <= DATE '1999-12-31' AND date >= DATE '1999-01-01'""")
def _(m):
    incoming = base(m).where(F.col("date").between("1999-01-01", "1999-12-31")).withColumn("close", F.col("close") + 1)
    return M.replace_until(base(m), incoming)


@query("mrg_05", """SELECT symbol, date, close FROM m_close WHERE date < DATE '2001-06-01'
       UNION ALL SELECT symbol, date, close + 1 FROM m_close WHERE date >= DATE '2001-06-01'""")
def _(m):
    incoming = base(m).where(F.col("date") >= "2001-01-01").withColumn("close", F.col("close") + 1)
    return M.replace_from(base(m), incoming, dt.date(2001, 6, 1))


@query("mrg_06", """SELECT symbol, date, close FROM m_close WHERE symbol NOT IN (SELECT symbol FROM m_events WHERE ratio > 1 AND date >= DATE '1999-01-01')
       UNION ALL SELECT symbol, date, close / 2 FROM m_close WHERE symbol IN (SELECT symbol FROM m_events WHERE ratio > 1 AND date >= DATE '1999-01-01')""")
def _(m):
    split = m.events.where((F.col("ratio") > 1) & (F.col("date") >= "1999-01-01")).select("symbol")
    restated = base(m).join(split, "symbol", "left_semi").withColumn("close", F.col("close") / 2)
    return M.replace_keys(base(m), restated, "symbol")


@query("mrg_07", """SELECT s.industry, c.symbol, c.date, CASE WHEN s.industry = 'ASIA' THEN c.close * 2 ELSE c.close END AS close FROM m_close c JOIN m_symbols s USING (symbol)
       WHERE s.industry <> 'ASIA' OR c.date >= DATE '2000-07-01'""")
def _(m):
    """One industry's rows replaced as a whole (the sink overwrites only its partition)."""
    table = base(m).join(m.symbols.select("symbol", "industry"), "symbol").select("industry", "symbol", "date", "close")
    fresh = table.where((F.col("industry") == "ASIA") & (F.col("date") >= F.lit(CUT))).withColumn("close", F.col("close") * 2)
    return M.replace_keys(table, fresh, "industry")


@query("mrg_08", "SELECT date AS generated_at, symbol, CASE WHEN date < DATE '2001-01-01' THEN score ELSE score + 10 END AS score FROM m_forecasts")
def _(m):
    runs = m.forecasts.select(F.col("date").alias("generated_at"), "symbol", "score")
    have = runs.where(F.col("generated_at") < "2001-01-01")
    return M.append_new_runs(have, runs.withColumn("score", F.col("score") + 10), "generated_at")


@query("mrg_09", """SELECT id, date, price FROM m_series s WHERE date > (SELECT max(date) FROM m_series x WHERE x.id = s.id AND (hash_day(x.date) OR x.date < DATE '2024-01-10') AND x.id <> 'view')
       OR id = 'view'""".replace("(hash_day(x.date) OR x.date < DATE '2024-01-10')", "x.date < (CASE x.id WHEN 'click' THEN DATE '2024-01-20' ELSE DATE '2024-01-10' END)"))
def _(m):
    limit = F.when(F.col("id") == "click", "2024-01-20").otherwise("2024-01-10").cast("date")
    have = m.series.where((F.col("date") < limit) & (F.col("id") != "view"))
    return M.after_high_water(have, m.series, "id").select("id", "date", "price")


@query("mrg_10", "SELECT symbol, name, current AND symbol IN (SELECT symbol FROM m_close, m_asof WHERE date >= as_of - 2) AS current FROM m_symbols")
def _(m):
    return M.refresh_current(m.symbols, m.trading_days, m.as_of(), 2).select("symbol", "name", "current")


@query("mrg_11", "SELECT symbol, name, 'ASX' AS exchange, 0::DOUBLE AS beta FROM m_symbols")
def _(m):
    return M.add_missing_columns(m.symbols.select("symbol", "name"), {"name": "", "exchange": "ASX", "beta": 0.0})


@query("mrg_12", "SELECT date, count(*) AS n, max(score) AS best FROM m_forecasts WHERE date >= DATE '2001-01-01' GROUP BY date")
def _(m):
    """Evaluation dates without a result yet are the only ones evaluated."""
    done = m.forecasts.where(F.col("date") < "2001-01-01").select("date")
    todo = M.resume(done, m.forecasts, "date")
    return todo.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
