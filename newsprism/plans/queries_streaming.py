"""Registered streaming queries: each runs its stream over the given table to completion
(``availableNow``) and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.plans.catalog import register
from newsprism.plans.queries_state import EV_SNAP
from newsprism.streaming import jobs as J


def st1_fresh_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.run_in_time_order(spark, sf_dir, "events", "ts", lambda d, base: J.fresh_arrivals(J.events_arrival_stream(spark, d), spark, base), "fresh")
    return out.select(F.col("key").alias("url"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"))


register("st1_fresh_arrivals", f"""
WITH RECURSIVE ev AS MATERIALIZED (SELECT url, fetched_at FROM ({EV_SNAP})),
r(url, t) AS (SELECT url, min(fetched_at) FROM ev GROUP BY url
  UNION ALL SELECT r.url, min(ev.fetched_at) FROM r JOIN ev ON ev.url = r.url AND ev.fetched_at > r.t + INTERVAL 24 HOUR GROUP BY r.url, r.t)
SELECT url, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at FROM r""")(st1_fresh_arrivals)


def st2_failure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_in_time_order(spark, sf_dir, "events", "ts", lambda d, base: J.failure_state(J.events_log_stream(spark, d), spark, base), "levels")


register("st2_failure_state", """
WITH l AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq, event_type <> 'error' AS ok FROM events),
i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS isl FROM l)
SELECT key, seq, ok, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY key, isl ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level
FROM i""")(st2_failure_state)


def st3_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = J.run_upsert(J.events_snapshot_stream(spark, sf_dir), spark)
    return store.select("url", "response_body", "status_code", "seq")


register("st3_stream_upsert", f"""
SELECT url, response_body, status_code, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, seq DESC) AS rn
  FROM ({EV_SNAP}) WHERE status_code = 200) WHERE rn = 1""")(st3_stream_upsert)
