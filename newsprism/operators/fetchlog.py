"""Fetch-log state: consecutive-failure runs (W5) and last good method per domain (A5).

Fetch log schema: ``key string, ts timestamp, ok boolean`` (+ a tiebreak ``seq``).

W5 is a running count that restarts at every success.  A plain window over
``partitionBy(key)`` puts all rows of a key into one task, so a key with a third
of all rows would be one task.  Instead the timeline of each key is cut into
time buckets and scanned in three steps (a segmented scan):

1. per (key, bucket), ordered: running failures and running failures at the last
   success; per bucket summaries (failures, tail after its last success) follow;
2. per key, over its buckets (few rows): the level carried into each bucket;
3. the carry joins back on (key, bucket), the partitioning the rows already have.

Rows are only ordered within one bucket of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Backoff delays per level for domains; endpoints are disabled at this many failures.
BACKOFF_SECONDS = [15.0, 30.0, 60.0]
ENDPOINT_MAX_FAILS = 3
DEFAULT_BUCKET_SECONDS = 3600


def failure_levels(log: DataFrame, key: str = "key", ts: str = "ts", ok: str = "ok", seq: str = "seq",
                   bucket_seconds: int = DEFAULT_BUCKET_SECONDS, start: DataFrame | None = None) -> DataFrame:
    """Add ``level``: consecutive failures up to and including this row (0 after a success).

    ``start`` (key, start_level: one row per key) goes before a key's first row: the level it had."""
    b = F.floor(F.unix_seconds(F.col(ts)) / F.lit(bucket_seconds)).cast("bigint")
    d = log.withColumn("_b", b).withColumn("_f", (~F.col(ok)).cast("int"))
    # 1. inside each (key, bucket): failures so far, and failures so far at the last success so far.
    wi = Window.partitionBy(key, "_b").orderBy(F.col(ts), F.col(seq)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_cf", F.sum("_f").over(wi))
    d = d.withColumn("_okcf", F.max(F.when(F.col(ok), F.col("_cf"))).over(wi))
    # per bucket: its failures, and failures after its last success (the tail) when it has one
    summ = d.groupBy(key, "_b").agg(F.max("_cf").alias("_nfail"), F.max("_okcf").alias("_okend"),
                                    F.max(F.col(ok).cast("int")).alias("_hasok"))
    summ = summ.withColumn("_tail", F.col("_nfail") - F.coalesce(F.col("_okend"), F.lit(0)))
    # 2. carry into each bucket (few rows per key): failures since the last success before it.
    wk = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summ = (summ.withColumn("_lob", F.max(F.when(F.col("_hasok") == 1, F.col("_b"))).over(wk))
            .withColumn("_cum_before", F.coalesce(F.sum("_nfail").over(wk), F.lit(0))))
    lob = summ.select(key, F.col("_b").alias("_lob"), (F.col("_cum_before") + F.col("_nfail")).alias("_lob_cum"),
                      F.col("_tail").alias("_lob_tail"))
    summ = summ.join(lob, [key, "_lob"], "left")
    before = F.col("_cum_before")
    if start is not None:
        summ = summ.join(start.select(key, "start_level"), key, "left")
        before = before + F.coalesce(F.col("start_level"), F.lit(0))
    carry = F.when(F.col("_lob").isNull(), before).otherwise(
        F.col("_lob_tail") + F.col("_cum_before") - F.col("_lob_cum"))
    summ = summ.select(key, "_b", carry.alias("_carry"))
    # 3. rows keep their (key, bucket) partitioning; the carry joins in.
    level = F.when(F.col("_okcf").isNull(), F.col("_carry") + F.col("_cf")).otherwise(F.col("_cf") - F.col("_okcf"))
    return (d.join(summ, [key, "_b"]).withColumn("level", level.cast("bigint"))
            .drop("_b", "_f", "_carry", "_cf", "_okcf"))


def domain_backoff(levels: DataFrame) -> DataFrame:
    """Domain rules: skip when level > 3; otherwise the delay of the level (0 = no backoff)."""
    lv = F.col("level")
    delay = F.element_at(F.array(*[F.lit(x) for x in BACKOFF_SECONDS]), F.least(F.greatest(lv, F.lit(1)), F.lit(3)).cast("int"))
    return (levels.withColumn("skip", lv > len(BACKOFF_SECONDS))
            .withColumn("delay_s", F.when((lv >= 1) & (lv <= len(BACKOFF_SECONDS)), delay).otherwise(F.lit(0.0))))


def endpoint_health(levels: DataFrame) -> DataFrame:
    """Endpoint rules: disabled once the failure count reaches 3; a success re-enables."""
    return levels.withColumn("disabled", F.col("level") >= ENDPOINT_MAX_FAILS)


def last_good_method(log: DataFrame, domain: Column, method: str = "method", ts: str = "ts",
                     seq: str = "seq", ok: str = "ok") -> DataFrame:
    """A5: per domain, the method of the latest successful fetch (partial ``max_by``)."""
    return (log.filter(F.col(ok)).withColumn("domain", domain)
            .groupBy("domain").agg(F.max_by(F.col(method), F.struct(F.col(ts), F.col(seq))).alias("method")))
