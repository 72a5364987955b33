"""Registry and the shared SQL definitions of the derived market tables."""

from __future__ import annotations

import re
from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return register


VIEWS: dict[str, str] = {
    "m_ticks": """
        SELECT n_name AS symbol, CAST(l_shipdate AS DATE) AS date,
               p_retailprice * (1 - l_discount) * CASE WHEN l_orderkey % 499 = 0 THEN 10.0 ELSE 1.0 END AS px,
               l_quantity AS q, l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "m_bars": """
        SELECT symbol, date,
               arg_min(px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, q, px)) AS open,
               max(px) AS high, min(px) AS low,
               arg_max(px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, q, px)) AS close,
               sum(q) AS volume, sum(CAST(round(px * 10000) AS BIGINT) * CAST(q AS BIGINT))::DOUBLE / (sum(q) * 10000.0) AS vwap,
               100 * sum(CASE WHEN l_returnflag = 'R' THEN q ELSE 0.0 END) / sum(q) AS short_raw
        FROM m_ticks GROUP BY symbol, date""",
    "m_cal": """
        SELECT date, row_number() OVER (ORDER BY date) - 1 AS t
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""",
    "m_asof": "SELECT CAST(max(l_shipdate) AS DATE) AS as_of FROM lineitem",
    "m_symbols": """
        SELECT n_name AS symbol,
               n_name || ' ' || CASE WHEN n_nationkey % 12 = 11 THEN 'WARRANT TRUST'
                                     WHEN n_nationkey % 12 = 10 THEN 'OPTION FUND'
                                     ELSE r_name || ' HOLDINGS' END AS name,
               r_name AS industry, 1000.0 * (1 + n_nationkey)::DOUBLE AS shares,
               last_date >= as_of - 90 AS current
        FROM nation JOIN region ON n_regionkey = r_regionkey
        JOIN (SELECT symbol, max(date) AS last_date FROM m_ticks GROUP BY symbol) x ON x.symbol = n_name
        CROSS JOIN m_asof""",
    "m_index": "SELECT date, avg(vwap) AS close FROM m_bars GROUP BY date",
    "m_shorts": """
        SELECT symbol, date, short_raw AS short FROM m_bars JOIN m_cal USING (date) WHERE t % 2 = 0""",
    "m_events": """
        SELECT n_name AS symbol, CAST(o_orderdate AS DATE) AS date,
               arg_max(CASE WHEN o_orderstatus = 'F' THEN 2.0::DOUBLE ELSE 0.1::DOUBLE END, o_orderkey) AS ratio
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_totalprice > 495000 GROUP BY 1, 2""",
    "m_dividends": """
        SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS ex_date,
               max(o_totalprice) / 1e6 AS amount FROM orders GROUP BY 1, 2""",
    "m_financials": """
        SELECT n_name AS symbol, make_date(year(l_shipdate), 6, 30) AS fiscal_year_end,
               round(sum(l_extendedprice), 2) AS total_revenue,
               round(sum(l_extendedprice * l_discount), 4) AS net_income,
               round(sum(l_extendedprice * l_tax), 4) AS free_cashflow,
               sum(l_quantity) * 1000 AS stockholders_equity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2""",
    "m_fundamentals": """
        SELECT n_name AS symbol, max(CAST(l_shipdate AS DATE)) AS date,
               round(sum(l_extendedprice) / nullif(sum(l_extendedprice * l_discount), 0), 6) AS trailing_pe,
               round(sum(l_extendedprice * l_discount) / (sum(l_quantity) * 1000), 6) AS return_on_equity,
               sum(CAST(round(l_tax * 100) AS BIGINT))::DOUBLE / (count(*) * 100.0::DOUBLE) AS dividend_yield,
               round(sum(l_extendedprice * l_tax) / (sum(l_quantity) * 100), 6) AS debt_to_equity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY n_name, date_trunc('quarter', l_shipdate)""",
    "m_series": """
        SELECT event_type AS id, CAST(ts AS DATE) AS date, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (count(*) * 100.0::DOUBLE) AS price
        FROM events GROUP BY 1, 2""",
    "m_options": """
        SELECT 'P' || l_partkey || 'O' || substr('ABCD', CAST(l_partkey % 4 + 1 AS INT), 1) AS option_symbol,
               n_name AS share_symbol, last_ship + 90 AS expiry, p_retailprice AS exercise,
               CASE l_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'P' END AS note,
               DATE '1996-01-01' + CAST(l_partkey % 1500 AS INT) AS fetched_at
        FROM (SELECT l_partkey, min(l_suppkey) AS sk, max(CAST(l_shipdate AS DATE)) AS last_ship
              FROM lineitem GROUP BY 1)
        JOIN supplier ON sk = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN part ON l_partkey = p_partkey""",
    "m_option_bars": """
        SELECT 'P' || l_partkey || 'O' || substr('ABCD', CAST(l_partkey % 4 + 1 AS INT), 1) AS symbol,
               date, 0.05::DOUBLE * (sum(CAST(round(px * 10000) AS BIGINT) * CAST(q AS BIGINT))::DOUBLE / (sum(q) * 10000.0)) AS close
        FROM m_ticks GROUP BY l_partkey, date""",
    "m_panel": """
        SELECT symbol, date, open, high, low, vwap AS close, volume,
               vwap IS NOT NULL AND volume > 0 AS valid, t
        FROM m_bars JOIN m_cal USING (date)""",
    "m_forecasts": """
        SELECT date, symbol, round(((CAST(floor(close * 100) AS BIGINT) + 13 * t) % 97) / 97.0::DOUBLE * 8 - 4, 6) AS score
        FROM m_panel WHERE t % 5 = 0""",
}


def view(name: str, sql: str) -> None:
    """Add a shared SQL view used by several statements of one section."""
    VIEWS[name] = sql


def _uses(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]


def full_sql(sql: str) -> str:
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text):
            if name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    body = sql.strip()
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'^WITH\s+RECURSIVE', '', body, count=1, flags=re.I)}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {ctes},\n{re.sub(r'^WITH', '', body, count=1, flags=re.I)}"
    return f"WITH {ctes}\n{body}"
