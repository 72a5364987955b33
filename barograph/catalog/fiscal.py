"""FYR: fiscal-year seasonality."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.aggregates import market_caps
from barograph.catalog.base import query, view
from barograph.catalog.filters import closes
from barograph.catalog.rolling import r6
from barograph.catalog.sqlstats import corr_t_sql, fdr_sql, t_tail_sql
from barograph.functions.dates import last_complete_fiscal_year
from barograph.plans import fiscal as Y

LEAST = 4  # the derived data spans six fiscal years before exclusions

view("m_fy", """
    SELECT symbol, y::BIGINT AS fy_year, CAST(y - 1 AS VARCHAR) || '-' || right(CAST(y AS VARCHAR), 2) AS fy, make_date(y - 1, 7, 1) AS q13_start,
           make_date(y, 3, 31) AS q13_end, make_date(y, 4, 1) AS q4_start, make_date(y, 6, 30) AS q4_end
    FROM (SELECT DISTINCT symbol FROM m_bars), (SELECT CASE WHEN as_of < make_date(c, 6, 30) + 5 THEN c - 1 ELSE c END AS top
          FROM (SELECT as_of, year(as_of) - CASE WHEN month(as_of) >= 7 THEN 0 ELSE 1 END AS c FROM m_asof)), range(1989, 2100) r(y) WHERE y <= top""")


def _at(points: str) -> str:
    return f"""SELECT p.symbol, p.fy_year, p.kind, p.k, arg_max(b.close, b.date) AS close FROM ({points}) p
        JOIN m_close b ON b.symbol = p.symbol AND b.date <= p.boundary AND b.date >= p.boundary - 10 GROUP BY 1, 2, 3, 4"""


view("m_fyr", f"""
    SELECT *, reason IS NOT NULL AS excluded FROM (SELECT symbol, fy_year, fy, q13_return, q4_return,
      CASE WHEN abs(q13_return) > 3 OR abs(q4_return) > 3 THEN 'outlier'
           WHEN EXISTS (SELECT 1 FROM m_events e WHERE e.symbol = x.symbol AND e.date BETWEEN x.q13_start AND x.q4_end) THEN 'corporate_event' END AS reason
      FROM (SELECT f.*, b / a - 1 AS q13_return, d / c - 1 AS q4_return FROM m_fy f JOIN (
        SELECT symbol, fy_year, max(close) FILTER (k = 0) AS a, max(close) FILTER (k = 1) AS b, max(close) FILTER (k = 2) AS c, max(close) FILTER (k = 3) AS d
        FROM ({_at("SELECT symbol, fy_year, 'f' AS kind, unnest([0, 1, 2, 3]) AS k, unnest([q13_start, q13_end, q4_start, q4_end]) AS boundary FROM m_fy")}) GROUP BY 1, 2) z
        USING (symbol, fy_year) WHERE a > 0 AND b IS NOT NULL AND c > 0 AND d IS NOT NULL) x)""")


def symbol_years(m):
    return Y.years(m.symbols, last_complete_fiscal_year(m.as_of()))


def records(m):
    return Y.returns(symbol_years(m), closes(m), m.events)


@query("fyr_01", "SELECT symbol, fy_year, q13_start, q13_end, q4_start, q4_end FROM m_fy")
def _(m):
    return Y.boundaries(symbol_years(m))


@query("fyr_02", "SELECT symbol, fy_year, fy, round(q13_return, 6) AS q13_return, round(q4_return, 6) AS q4_return FROM m_fyr")
def _(m):
    return records(m).select("symbol", "fy_year", "fy", r6("q13_return", "q13_return"), r6("q4_return", "q4_return"))


@query("fyr_03", "SELECT symbol, fy_year, excluded, reason FROM m_fyr")
def _(m):
    return records(m).select("symbol", "fy_year", "excluded", "reason")


_CORR = """SELECT symbol{w}, count(*) AS n_years, corr(q13_return, {y}) AS r, avg(q13_return) AS mean_q13, avg({y}) AS mean_other, stddev_samp(q13_return) AS std_q13,
    stddev_samp({y}) AS std_other, arg_min(fy, fy_year) AS first_fy, arg_max(fy, fy_year) AS last_fy
    FROM {src} GROUP BY symbol{w} HAVING count(*) >= {least} AND corr(q13_return, {y}) IS NOT NULL AND NOT isnan(corr(q13_return, {y}))"""
view("m_fyc", f"""SELECT * EXCLUDE (part) FROM ({t_tail_sql(_CORR.format(w='', y='q4_return', src='(SELECT * FROM m_fyr WHERE NOT excluded)', least=LEAST), corr_t_sql('r', 'n_years'), 'n_years - 2', 'p_value')})
    JOIN (SELECT symbol, count(*) FILTER (excluded) AS n_excluded FROM m_fyr GROUP BY symbol) USING (symbol)""")
_COLS = ("r", "p_value", "mean_q13", "mean_other", "std_q13", "std_other")


@query("fyr_04", "SELECT symbol, n_years, first_fy, last_fy, n_excluded, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COLS) + " FROM m_fyc")
def _(m):
    return Y.symbol_correlations(records(m), LEAST).select(
        "symbol", "n_years", "first_fy", "last_fy", "n_excluded", *[r6(c, c) for c in _COLS])


view("m_fyrun", fdr_sql("""SELECT c.*, s.industry, cap, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM m_fyc c
    JOIN (SELECT symbol, industry FROM m_symbols WHERE current AND industry <> 'Index') s USING (symbol) LEFT JOIN m_caps USING (symbol)""", "p_value", "fdr_p"))


def run(m):
    return Y.run(records(m), m.symbols, market_caps(m), LEAST)


@query("fyr_05", "SELECT symbol, industry, round(cap, 2) AS market_cap, direction, n_years, round(r, 6) AS r, round(p_value, 6) AS p_value, round(fdr_p, 6) AS fdr_p FROM m_fyrun")
def _(m):
    return run(m).select("symbol", "industry", r6("cap", "market_cap", 2), "direction", "n_years", r6("r", "r"), r6("p_value", "p_value"), r6("fdr_p", "fdr_p"))


@query("fil_08", """SELECT symbol, industry, round(r, 6) AS r, n_years FROM m_fyrun WHERE (r >= 0.1 OR r <= -0.1) AND n_years >= 4 AND fdr_p <= 1.0
       AND cap BETWEEN 1e6 AND 5e7 AND industry IN ('ASIA', 'EUROPE', 'AFRICA') AND direction = 'positive'""")
def _(m):
    wanted = ((F.col("r") >= 0.1) | (F.col("r") <= -0.1)) & (F.col("n_years") >= 4) & (F.col("fdr_p") <= 1.0)
    wanted = wanted & F.col("cap").between(1e6, 5e7) & F.col("industry").isin("ASIA", "EUROPE", "AFRICA") & (F.col("direction") == "positive")
    return run(m).where(wanted).select("symbol", "industry", r6("r", "r"), "n_years")


@query("top_10", "SELECT symbol, round(r, 6) AS r FROM m_fyrun ORDER BY abs(r) DESC, symbol LIMIT 10")
def _(m):
    return run(m).orderBy(F.abs("r").desc(), "symbol").limit(10).select("symbol", r6("r", "r"))


view("m_fyw", f"""
    SELECT r.symbol, r.fy_year, r.fy, r.q13_return, z.a, z.b, z.c FROM m_fyr r JOIN (
      SELECT symbol, fy_year, max(close) FILTER (kind = 'A' AND k = 1) / max(close) FILTER (kind = 'A' AND k = 0) - 1 AS a,
        max(close) FILTER (kind = 'B' AND k = 1) / max(close) FILTER (kind = 'B' AND k = 0) - 1 AS b,
        max(close) FILTER (kind = 'C' AND k = 1) / max(close) FILTER (kind = 'C' AND k = 0) - 1 AS c
      FROM ({_at("SELECT symbol, fy_year, unnest(['A', 'A', 'B', 'B', 'C', 'C']) AS kind, unnest([0, 1, 0, 1, 0, 1]) AS k, unnest([q4_start + 56, q4_start + 70, q4_start + 70, q4_end, q4_end + 1, q4_end + 43]) AS boundary FROM m_fy")})
      GROUP BY 1, 2) z USING (symbol, fy_year) WHERE NOT r.excluded AND a IS NOT NULL AND b IS NOT NULL""")
_LONGW = """(SELECT symbol, fy_year, fy, q13_return, "window", ret FROM (SELECT *, unnest(['A', 'B', 'C']) AS "window", unnest([a, b, c]) AS ret FROM m_fyw
    WHERE symbol IN (SELECT symbol FROM m_fyw GROUP BY symbol HAVING count(*) >= {least})) WHERE ret IS NOT NULL)""".format(least=LEAST)
view("m_fywrun", fdr_sql(f"""SELECT w.*, s.industry, cap FROM ({t_tail_sql(_CORR.format(w=', "window"', y='ret', src=_LONGW, least=LEAST), corr_t_sql('r', 'n_years'), 'n_years - 2', 'p_value')}) w
    JOIN (SELECT symbol, industry FROM m_symbols WHERE current AND industry <> 'Index') s USING (symbol) LEFT JOIN m_caps USING (symbol)""", "p_value", "fdr_p", '"window"'))


def window_run(m):
    base = records(m)
    return Y.window_run(Y.window_returns(symbol_years(m), base, closes(m)), m.symbols, market_caps(m), LEAST)


@query("fyr_06", """SELECT symbol, "window", n_years, first_fy, last_fy, """ + ", ".join(f"round({c}, 6) AS {c}" for c in (*_COLS, "fdr_p")) + " FROM m_fywrun")
def _(m):
    return window_run(m).select("symbol", "window", "n_years", "first_fy", "last_fy", *[r6(c, c) for c in (*_COLS, "fdr_p")])


_WEEKS = ", ".join(["'q4'"] * 14 + ["'post'"] * 7)
_WK = ", ".join(str(k) for k in [*range(14), *range(7)])
_WB = ", ".join([f"q4_start + {7 * k}" for k in range(14)] + [f"q4_end + {1 + 7 * k}" for k in range(7)])
_POOL = f"""
    SELECT week, count(*) AS n, CASE WHEN count(*) >= 5 THEN corr(q13_return, ret) END AS r FROM (
      SELECT symbol, fy_year, CAST(CASE kind WHEN 'q4' THEN k + 1 ELSE k + 14 END AS INTEGER) AS week, ret, kind, count(*) OVER (PARTITION BY symbol, fy_year, kind) AS present
      FROM (SELECT a.symbol, a.fy_year, a.kind, a.k, b.close / a.close - 1 AS ret FROM m_fywk a JOIN m_fywk b
            ON a.symbol = b.symbol AND a.fy_year = b.fy_year AND a.kind = b.kind AND b.k = a.k + 1)) x
    JOIN m_fyr r USING (symbol, fy_year) WHERE NOT r.excluded AND (kind = 'post' OR present = 13) GROUP BY week"""
view("m_fywk", _at(f"SELECT symbol, fy_year, unnest([{_WEEKS}]) AS kind, unnest([{_WK}]) AS k, unnest([{_WB}]) AS boundary FROM m_fy"))


@query("fyr_07", f"""SELECT week, n, round(r, 6) AS r, round(p, 6) AS p_value,
       CASE WHEN p IS NULL THEN NULL WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars
       FROM ({t_tail_sql(_POOL, corr_t_sql('r', 'n'), 'n - 2', 'p')})""")
def _(m):
    return Y.weekly_breakdown(symbol_years(m), records(m), closes(m)).select("week", "n", r6("r", "r"), r6("p_value", "p_value"), "stars")


@query("fyr_08", """SELECT symbol, fy, round(q13_return, 6) AS q13_return, round(q4_return, 6) AS q4_return, round(slope, 5) AS slope,
       round(intercept, 5) AS intercept, round(slope * q13_return + intercept, 5) AS fitted
       FROM m_fyr JOIN (SELECT symbol, CASE WHEN count(*) >= 2 THEN regr_slope(q4_return, q13_return) END AS slope, CASE WHEN count(*) >= 2 THEN regr_intercept(q4_return, q13_return) END AS intercept
                        FROM m_fyr WHERE NOT excluded GROUP BY symbol) USING (symbol) WHERE NOT excluded""")
def _(m):
    return Y.details(records(m)).select("symbol", "fy", r6("q13_return", "q13_return"), r6("q4_return", "q4_return"),
                                        r6("slope", "slope", 5), r6("intercept", "intercept", 5), r6("fitted", "fitted", 5))


@query("fyr_09", """SELECT v.w AS "window", v.s AS start_day, v.e AS end_day, v.l AS label, coalesce(n_tested, 0) AS n_tested, coalesce(n_significant, 0) AS n_significant
       FROM (VALUES ('A', 57, 70, 'Late May (day 57-70)'), ('B', 71, 91, 'Rest of Q4 (day 71-91, to Jun 30)'), ('C', 1, 42, 'New FY (Jul 1 - Aug 11)')) v(w, s, e, l)
       LEFT JOIN (SELECT "window", count(*) AS n_tested, count(*) FILTER (fdr_p < 0.05) AS n_significant FROM m_fywrun GROUP BY 1) r ON r."window" = v.w""")
def _(m):
    return Y.window_definitions(window_run(m))
