"""STR: batch runs of the streaming jobs (the streams themselves run in the tests)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barograph.catalog.base import query, view
from barograph.catalog.rolling import r6
from barograph.session import shared_folder
from barograph.streaming import jobs as J

view("m_tk", "SELECT event_id, ts, user_id AS key, value FROM events")


def ticks(m):
    return m.table("events").select("event_id", "ts", F.col("user_id").alias("key"), "value")


@query("str_01", """SELECT key, date_trunc('day', ts)::DATE AS day, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM m_tk GROUP BY 1, 2""")
def _(m):
    return J.bars(ticks(m)).select("key", F.col("start").cast("date").alias("day"), "open", "high", "low", "close", "n")


@query("str_02", """SELECT key, CAST(date_trunc('day', ts) AS DATE) - k AS day, count(*) AS n, round(sum(value), 4) AS total FROM m_tk, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY 1, 2""")
def _(m):
    return J.activity(ticks(m)).select("key", F.col("start").cast("date").alias("day"), "n", r6("total", "total", 4))


@query("str_03", "SELECT event_id, key, value FROM m_tk")
def _(m):
    """Every event delivered twice."""
    return J.deduplicated(ticks(m).unionByName(ticks(m))).select("event_id", "key", "value")


@query("str_04", """
    WITH a AS (SELECT DISTINCT key, CAST(ts AS DATE) AS day FROM m_tk), c AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM (SELECT DISTINCT day FROM a)),
    l AS (SELECT key, max(t) AS t, max(day) AS last_active FROM a JOIN c USING (day) GROUP BY key), e AS (SELECT max(t) AS ft, max(day) AS fd FROM c)
    SELECT key, ft - t AS consecutive_misses, (SELECT day FROM c WHERE c.t = l.t + 1) AS first_miss_date, fd AS last_miss_date, ft - t >= 2 AND last_active <= fd - 1 AS flagged
    FROM l, e WHERE t < ft""")
def _(m):
    return J.miss_state(ticks(m), threshold=2, recent_days=1)


@query("str_05", """SELECT key, day, CASE WHEN day >= DATE '2024-01-15' THEN round(total * 2, 4) ELSE round(total, 4) END AS total FROM
       (SELECT key, CAST(ts AS DATE) AS day, sum(value) AS total FROM m_tk GROUP BY 1, 2)""")
def _(m):
    """Second version restates the later days; the sink's view keeps the newest."""
    daily = ticks(m).groupBy("key", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("total"))
    path = f"{shared_folder(m.spark)}/upsert-{uuid.uuid4().hex}"
    write = J.upsert_sink(path, ["key", "day"])
    write(daily.where(F.col("day") < "2024-01-20"), 0)
    write(daily.where(F.col("day") >= "2024-01-15").withColumn("total", F.col("total") * 2), 1)
    return J.current(m.spark.read.parquet(path), ["key", "day"]).select("key", "day", r6("total", "total", 4))


@query("str_06", """
    SELECT key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) > INTERVAL 12 HOURS THEN 1 ELSE 0 END AS fresh FROM m_tk))
    GROUP BY key, s""")
def _(m):
    return J.sessions_batch(ticks(m), 12 * 3600)


@query("str_07", "SELECT event_id, key, value, c_mktsegment AS segment FROM m_tk LEFT JOIN customer ON c_custkey = key")
def _(m):
    static = m.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return J.enriched(ticks(m), static).select("event_id", "key", "value", "segment")


@query("str_08", """
    WITH p AS (SELECT key, arg_max(value, row(ts, event_id)) AS price FROM m_tk GROUP BY key),
    c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'price_above' ELSE 'price_below' END AS kind, (c_custkey % 50)::DOUBLE AS level FROM customer)
    SELECT key, kind, level, price FROM c JOIN p USING (key) WHERE CASE kind WHEN 'price_above' THEN price >= level ELSE price <= level END""")
def _(m):
    latest = ticks(m).groupBy("key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    kind = F.when(F.col("c_custkey") % 2 == 0, "price_above").otherwise("price_below")
    conditions = m.table("customer").select(F.col("c_custkey").alias("key"), kind.alias("kind"), (F.col("c_custkey") % 50).cast("double").alias("level"))
    return J.alerts(latest, conditions).select("key", "kind", "level", "price")
