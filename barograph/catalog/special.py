"""UDX-01..04 on their own: tail probabilities, greedy selection, block correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.catalog.base import query
from barograph.catalog.leadlag import returns
from barograph.catalog.rolling import r6
from barograph.catalog.sqlstats import binomial_tail_sql, t_tail_sql
from barograph.functions.stats import binomial_tail, t_tail
from barograph.operators.ledger import non_overlapping
from barograph.plans.leadlag import ccf

_T = "SELECT event_id, value / 40 AS t, 1 + event_id % 300 AS dof FROM events"


@query("udx_01", f"SELECT event_id, round(p, 9) AS p FROM ({t_tail_sql(_T, 't', 'dof', 'p')})")
def _(m):
    rows = m.table("events").select("event_id", (F.col("value") / 40).alias("t"), (1 + F.col("event_id") % 300).alias("dof"))
    return rows.select("event_id", r6(t_tail(F.col("t"), F.col("dof")), "p", 9))


_B = "SELECT event_id, event_id % 200 AS k, 200 + event_id % 37 AS n FROM events"


@query("udx_02", f"SELECT event_id, round(p, 9) AS p FROM ({binomial_tail_sql(_B, 'k', 'n', 'p')})")
def _(m):
    rows = m.table("events").select("event_id", (F.col("event_id") % 200).alias("k"), (200 + F.col("event_id") % 37).alias("n"))
    return rows.select("event_id", r6(binomial_tail(F.col("k"), F.col("n")), "p", 9))


@query("udx_03", """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, b, e, row_number() OVER (PARTITION BY user_id ORDER BY b, event_id) AS seq FROM
        (SELECT user_id, event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS b, CAST(floor(epoch(ts) / 3600) AS BIGINT) + event_id % 40 AS e FROM events)),
    h AS MATERIALIZED (SELECT user_id, b, min(seq) AS seq FROM o GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT a.user_id, a.seq, a.event_id, CASE WHEN a.e <= a.b THEN a.seq + 1 ELSE x.seq END AS nxt FROM o a ASOF LEFT JOIN h x ON a.user_id = x.user_id AND x.b >= a.e),
    w AS (SELECT user_id, seq, nxt, event_id FROM p WHERE seq = 1 UNION ALL SELECT b.user_id, b.seq, b.nxt, b.event_id FROM w a JOIN p b ON a.user_id = b.user_id AND b.seq = a.nxt)
    SELECT user_id, event_id FROM w""")
def _(m):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    rows = m.table("events").select("user_id", "event_id", hour.alias("b"), (hour + F.col("event_id") % 40).alias("e"))
    return non_overlapping(rows, ["user_id"], "b", "e", ["event_id"]).select("user_id", "event_id")


@query("udx_04", "SELECT industry, leader, follower, lag_days, round(r, 6) AS r FROM m_ccfb")
def _(m):
    """Small blocks and chunks, so that every seam of the kernel is crossed."""
    return ccf(returns(m, "backtest"), ["industry"], block=2, chunk=64).select("industry", "leader", "follower", "lag_days", r6("r", "r"))
