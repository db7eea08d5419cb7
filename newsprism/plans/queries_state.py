"""Registered queries over ``events`` as a fetch log and snapshot feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions.urls import log_domain
from newsprism.operators import fetchlog as FL
from newsprism.operators.dedup import first_wins
from newsprism.plans import sqlgen as S
from newsprism.plans.catalog import register
from newsprism.session import scratch_path
from newsprism.sources import snapshots as SN
from newsprism.sources import store as ST
from newsprism.sources.tables import read_table

AS_OF = "2024-01-31 00:00:00"
SPLIT = "2024-01-16 00:00:00"


def _as_of():
    return F.to_timestamp(F.lit(AS_OF))


EV_URL = "('https://u' || CAST(user_id AS VARCHAR) || '.example.org:8443/feed')"
EV_SNAP = f"""SELECT {EV_URL} AS url, props AS response_body,
  CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'signup' THEN 301 ELSE 200 END AS status_code,
  ts AS fetched_at, CAST(floor(value) AS INTEGER) AS ttl_hours, event_id AS seq FROM events"""
LATEST = f"""SELECT url, response_body, status_code, fetched_at, ttl_hours, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, seq DESC) AS rn FROM ({EV_SNAP})) WHERE rn = 1"""
AGE = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(fetched_at)) / 3600000000.0)"


def s10_snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = SN.events_snapshots(spark, sf_dir)
    frontier = snaps.select("url").distinct()
    return SN.lookup(frontier, snaps, _as_of())


register("s10_snapshot_lookup", f"""
SELECT f.url, h.response_body, h.status_code FROM (SELECT DISTINCT url FROM ({EV_SNAP})) f
LEFT JOIN (SELECT url, response_body, status_code FROM ({LATEST}) WHERE {AGE} <= ttl_hours) h ON f.url = h.url""")(
    s10_snapshot_lookup)


def s11_snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = SN.events_snapshots(spark, sf_dir)
    cut = F.to_timestamp(F.lit(SPLIT))
    current = snaps.filter((F.col("fetched_at") < cut) & (F.col("status_code") == 200))
    merged = SN.upsert(SN.latest(current), snaps.filter(F.col("fetched_at") >= cut))
    return merged.select("url", "response_body", "status_code", "seq")


register("s11_snapshot_upsert", f"""
SELECT url, response_body, status_code, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, seq DESC) AS rn
  FROM ({EV_SNAP}) WHERE status_code = 200) WHERE rn = 1""")(s11_snapshot_upsert)


def s12_snapshot_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """size, what clear_expired deletes, and what stays -- one aggregate pass over the store."""
    store = SN.newest(SN.events_snapshots(spark, sf_dir), ["ttl_hours"])
    old = SN.age_hours(_as_of()) > F.col("ttl_hours")
    return store.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(old).alias("n_expired"),
                     F.count_if(~old).alias("n_left"))


register("s12_snapshot_expire", f"""
SELECT count(*) AS n_total, count(*) FILTER (WHERE {AGE} > ttl_hours) AS n_expired,
       count(*) FILTER (WHERE {AGE} <= ttl_hours) AS n_left FROM ({LATEST})""")(s12_snapshot_expire)


def s12_snapshot_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written to a store, expired and purged: after each step, what was deleted and what is left."""
    rows = SN.events_snapshots(spark, sf_dir)
    store = ST.snapshot_store(spark, scratch_path(spark, "purge"), rows.schema)
    ST.put(store, rows)
    steps = [("put", 0, store.size())]
    steps.append(("expire", ST.expire(store, _as_of()), store.size()))
    steps.append(("purge", ST.purge(store), store.size()))
    return spark.createDataFrame(steps, "step string, n_deleted long, n_left long")


_OK_LATEST = f"""SELECT fetched_at, ttl_hours FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, seq DESC) AS rn FROM ({EV_SNAP}) WHERE status_code = 200) WHERE rn = 1"""
register("s12_snapshot_purge", f"""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {AGE} > ttl_hours) AS old FROM ({_OK_LATEST}))
SELECT 'put' AS step, 0::BIGINT AS n_deleted, n AS n_left FROM c
UNION ALL SELECT 'expire', old, n - old FROM c UNION ALL SELECT 'purge', n - old, 0 FROM c""")(s12_snapshot_purge)


def j3_fetch_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = SN.events_snapshots(spark, sf_dir)
    frontier = read_table(spark, sf_dir, "pages").select("url").unionByName(snaps.select("url")).distinct()
    return SN.to_fetch(frontier, snaps, _as_of())


register("j3_fetch_frontier", f"""
SELECT url FROM (SELECT url FROM pages UNION SELECT url FROM ({EV_SNAP}))
WHERE url NOT IN (SELECT url FROM ({LATEST}) WHERE {AGE} <= ttl_hours)""")(j3_fetch_frontier)


def _fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("key"), "ts", (F.col("event_type") != "error").alias("ok"),
                     F.col("event_id").alias("seq"), F.col("event_type").alias("method"),
                     SN.event_url(F.col("user_id")).alias("url"))


def w5_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = FL.failure_levels(_fetch_log(spark, sf_dir))
    out = FL.endpoint_health(FL.domain_backoff(lv))
    return out.select("key", "seq", "ok", "level", "skip", "delay_s", "disabled")


register("w5_failure_runs", """
WITH l AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS seq, event_type <> 'error' AS ok FROM events),
i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS isl FROM l),
v AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY key, isl ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level FROM i)
SELECT key, seq, ok, level, level > 3 AS skip,
  CAST(CASE WHEN level = 1 THEN 15.0 WHEN level = 2 THEN 30.0 WHEN level = 3 THEN 60.0 ELSE 0.0 END AS DOUBLE) AS delay_s,
  level >= 3 AS disabled FROM v""")(w5_failure_runs)


def a5_last_good_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.last_good_method(_fetch_log(spark, sf_dir), log_domain(F.col("url")))


register("a5_last_good_method", f"""
SELECT {S.log_domain(EV_URL)} AS domain, arg_max(event_type, (ts, event_id)) AS method
FROM events WHERE event_type <> 'error' GROUP BY 1""")(a5_last_good_method)


def a4_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return first_wins(ev.withColumn("ord", F.col("event_id")), ["user_id", "event_type"]).drop("ord")


register("a4_first_wins", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")(
    a4_first_wins)
