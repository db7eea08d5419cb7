"""Structured Streaming twins of the stateful behaviours (ST1-ST3), as ``foreachBatch`` jobs.

* ST1 -- arrivals of a url, one per time to live by *event time*: an arrival is emitted if the last
  emitted one of its url is older than the ttl.  State: the time of the last emitted arrival per url.
* ST2 -- consecutive-failure level per key over a live fetch log.  State: one level per key, which goes
  before the key's first row of a batch in the segmented scan of ``operators.fetchlog``.
* ST3 -- snapshot upsert from a stream (S11 on the buckets that a batch touches).

All three keep their state in a ``sources.store``: its manifest is committed after the batch's output
is written and names the batch, so that a batch that dies is redone from the state before it and one
that is committed is skipped.  Batch results do not depend on how an ordered input is cut.
No Python runs per row; a key with a third of all rows is spread over slices of its time.

Streaming state, progress and store versions live under the session's reliable
checkpoint directory (``spark.checkpoint.dir`` on a cluster).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsprism.operators.fetchlog import failure_levels
from newsprism.session import ensure_checkpoint_dir, is_folder
from newsprism.sources import snapshots as SN
from newsprism.sources import store as ST


def stream_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 64) -> DataFrame:
    """A file stream over one table of ``sf_dir``; NTZ timestamps become instants."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    # A table is one file or a folder of files.
    df = r.parquet(path) if is_folder(spark, path) else r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz"
                       else F.col(f.name) for f in df.schema.fields])


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], base: str) -> None:
    """Feed ``sink`` until the available input is consumed; a given ``base`` continues the query that ran there."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start()
    q.awaitTermination()


def run_in_time_order(spark: SparkSession, sf_dir: str, table: str, ts: str, run: Callable[[str, str], DataFrame], name: str,
                      max_files: int = 64) -> DataFrame:
    """``run(folder, base)`` (a stream over the table in a folder, run to completion) over a table whose files
    may each span any time; returns what it wrote.

    A table of at most ``max_files`` files is one batch.  A larger one is copied into slices of its
    event time, as many as it has ``max_files`` files; each slice is appended to the stream's
    folder when the ones before it are consumed, so that batches follow event time.  Equal times
    are in one slice; rows without a time are in the first."""
    whole = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    cuts = -(-len(whole.inputFiles()) // max_files)
    base = stream_dir(spark, name)
    if cuts <= 1:
        return run(sf_dir, base)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    bounds = whole.select(F.percentile_approx(micros, [c / cuts for c in range(1, cuts)], 100 * cuts)).first()[0] or []
    part = F.lit(0)
    for b in sorted(set(bounds)):
        part = part + F.coalesce((micros > b).cast("int"), F.lit(0))
    whole.withColumn("_slice", part).repartitionByRange(8 * cuts, "_slice", ts).write.partitionBy("_slice").parquet(f"{base}/slices")
    for c in range(len(set(bounds)) + 1):
        rows = spark.read.parquet(f"{base}/slices").where(F.col("_slice") == c).drop("_slice")
        rows.coalesce(max_files).write.mode("append").parquet(f"{base}/in/{table}.parquet")
        out = run(f"{base}/in", base)
    return out


def _replaced(new: DataFrame, key: str) -> Callable[[DataFrame], DataFrame]:
    """State change: the keys of ``new`` get its rows, others keep theirs."""
    return lambda current: current.join(new.select(key), key, "left_anti").unionByName(new.select(*current.columns))


# --- ST1 --------------------------------------------------------------------------------

def interval_starts(arrivals: DataFrame, last: DataFrame, ttl: int) -> DataFrame:
    """key, us of the arrivals (key, us: microseconds) that start a time to live: each key's chain of "first
    arrival later than the last start + ttl", from ``last`` (key, us: earlier starts) or its first arrival.

    Time is cut into slices of a ttl, so that a chain has at most one start per slice.  The arrival
    after each arrival's ttl lies in the next slice (found by a running ``last`` over the two slices'
    times, in falling order) or is the first of the next slice that has any.  The chain is followed by
    doubling these pointers: the starts known so far jump 1, 2, 4 ... links, log2(slices) rounds.
    """
    length = max(ttl, 1)
    nodes = arrivals.select("key", "us", F.lit(1).alias("arrived")).unionByName(last.select("key", "us", F.lit(0).alias("arrived")))
    # An arrival at the time of an earlier start is no start.
    nodes = nodes.groupBy("key", "us").agg(F.min("arrived").alias("arrived")).withColumn("k", F.floor(F.col("us") / F.lit(length)).cast("long"))
    nodes = nodes.checkpoint()
    target = F.when(F.col("arrived") == 1, F.col("us"))
    asked = nodes.select("key", (F.col("k") + 1).alias("k"), (F.col("us") + ttl).alias("at"), F.lit(0).alias("kind"), "us", F.lit(None).cast("long").alias("to"))
    there = nodes.select("key", "k", F.col("us").alias("at"), F.lit(1).alias("kind"), "us", target.alias("to"))
    falling = Window.partitionBy("key", "k").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = asked.unionByName(there).withColumn("near", F.last("to", ignorenulls=True).over(falling)).where("kind = 0").select("key", "us", "near")
    slices = nodes.groupBy("key", "k").agg(F.min(target).alias("first"))
    along = Window.partitionBy("key").orderBy("k")
    far = F.when(F.lead("k").over(along) > F.col("k") + 1, F.lead("first").over(along)).otherwise(F.lead("first", 2).over(along))
    links = nodes.join(near, ["key", "us"]).join(slices.select("key", "k", far.alias("far")), ["key", "k"]) \
        .select("key", "us", F.coalesce("near", "far").alias("to")).where("to IS NOT NULL")
    links = links.checkpoint()
    begin = nodes.groupBy("key").agg(F.max(F.when(F.col("arrived") == 0, F.col("us"))).alias("s"), F.min(target).alias("f"))
    known = begin.select("key", F.coalesce("s", "f").alias("us"))
    most = slices.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < most:
        jump = known.join(links, ["key", "us"]).select("key", F.col("to").alias("us"))
        known = known.unionByName(jump).distinct().checkpoint()
        twice = links.alias("a").join(links.alias("b"), F.expr("a.key = b.key AND a.to = b.us")).selectExpr("a.key", "a.us", "b.to AS to")
        links = twice.checkpoint()
        reach *= 2
    return known.join(nodes.where("arrived = 1").select("key", "us"), ["key", "us"], "left_semi")


LAST_SCHEMA = StructType().add("key", "string").add("us", "long")


def fresh_sink(spark: SparkSession, base: str, ttl_hours: float = 24, late_hours: float = 24) -> Callable[[DataFrame, int], None]:
    """ST1 on batches of (key, ts, seq): writes those that start a time to live below ``base``/out.

    Arrivals more than ``late_hours`` behind the newest one of earlier batches are dropped; so is, when its
    bucket is next written, the state of a key whose ttl ended before that."""
    store = ST.Store(spark, f"{base}/state", LAST_SCHEMA, "key")
    ttl, late = int(ttl_hours * 3_600_000_000), int(late_hours * 3_600_000_000)

    def run(batch: DataFrame, batch_id: int) -> None:
        before = store.manifest()
        if before["txn"] >= batch_id:
            return
        mark = before["note"].get("newest")
        rows = batch.select("key", "ts", "seq", F.unix_micros("ts").alias("us")).where("key IS NOT NULL AND us IS NOT NULL")
        if mark is not None:
            rows = rows.where(F.col("us") >= mark - late)
        rows = rows.groupBy("key", "ts", "us").agg(F.min("seq").alias("seq")).checkpoint()
        touched = store.buckets_of(rows)
        if not touched:
            return
        last = store.read(only=touched).join(rows.select("key").distinct(), "key", "left_semi")
        starts = rows.join(interval_starts(rows, last, ttl), ["key", "us"], "left_semi")
        out = f"{base}/out/batch={batch_id}"
        starts.select("key", "ts", "seq").write.mode("overwrite").parquet(out)
        newest = max(rows.agg(F.max("us")).first()[0], mark or 0)
        new = spark.read.schema("key string, ts timestamp, seq long").parquet(out).groupBy("key").agg(F.max(F.unix_micros("ts")).alias("us"))
        live = lambda d: d.where(F.col("us") + ttl >= (newest if mark is None else mark) - late)
        store.change(touched, lambda current: live(_replaced(new, "key")(current)), batch_id, {"newest": newest})
        store.vacuum()
    return run


def fresh_arrivals(stream: DataFrame, spark: SparkSession, base: str, ttl_hours: float = 24, late_hours: float = 24) -> DataFrame:
    """Run ST1 over ``stream`` (key, ts, seq) to the end of its input; all starts so far."""
    run_batches(stream, fresh_sink(spark, base, ttl_hours, late_hours), base)
    return _committed(spark, base, "key string, ts timestamp, seq long")


# --- ST2 --------------------------------------------------------------------------------

LEVEL_SCHEMA = StructType().add("key", "string").add("start_level", "long")


def levels_sink(spark: SparkSession, base: str) -> Callable[[DataFrame, int], None]:
    """ST2 on batches of (key, ts, seq, ok): writes each event with its level below ``base``/out."""
    store = ST.Store(spark, f"{base}/state", LEVEL_SCHEMA, "key")

    def run(batch: DataFrame, batch_id: int) -> None:
        if store.manifest()["txn"] >= batch_id:
            return
        rows = batch.select("key", "ts", "seq", "ok").checkpoint()
        touched = store.buckets_of(rows)
        if not touched:
            return
        out = f"{base}/out/batch={batch_id}"
        failure_levels(rows, start=store.read(only=touched)).select("key", "ts", "seq", "ok", "level").write.mode("overwrite").parquet(out)
        done = spark.read.schema("key string, ts timestamp, seq long, ok boolean, level long").parquet(out)
        new = done.groupBy("key").agg(F.max_by("level", F.struct("ts", "seq")).alias("start_level"))
        store.change(touched, _replaced(new, "key"), batch_id)
        store.vacuum()
    return run


def failure_state(stream: DataFrame, spark: SparkSession, base: str) -> DataFrame:
    """Run ST2 over ``stream`` (key, ts, seq, ok) to the end of its input; all events so far with their levels."""
    run_batches(stream, levels_sink(spark, base), base)
    return _committed(spark, base, "key string, ts timestamp, seq long, ok boolean, level long").drop("ts")


def _committed(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The output of the batches whose state is committed; a batch that died is not seen."""
    store = ST.Store(spark, f"{base}/state", StructType())
    if not store.versions():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{base}/out").where(F.col("batch") <= store.manifest()["txn"])
    return rows.drop("batch")


# --- ST3 --------------------------------------------------------------------------------

def upsert_sink(store: ST.Store) -> Callable[[DataFrame, int], None]:
    """ST3: the buckets that the batch touches get S11's upsert of their rows and the batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if store.manifest()["txn"] >= batch_id:
            return
        rows = batch.select(*SN.SNAPSHOT_COLUMNS).persist()
        try:
            ST.put(store, rows, batch_id)
            store.vacuum()
        finally:
            rows.unpersist()
    return run


def run_upsert(stream: DataFrame, spark: SparkSession, initial: DataFrame | None = None, buckets: int = ST.BUCKETS,
               base: str | None = None) -> DataFrame:
    """Run ST3 to the end of the input; the store's rows."""
    base = base or stream_dir(spark, "upsert")
    store = ST.snapshot_store(spark, f"{base}/store", stream.schema, buckets)
    if initial is not None and not store.versions():
        ST.put(store, initial)
    run_batches(stream, upsert_sink(store), base)
    return store.read()


# --- the given tables as streams ------------------------------------------------------------

def events_snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table_stream(spark, sf_dir, "events")
    return ev.select(SN.event_url(F.col("user_id")).alias("url"), F.col("props").alias("response_body"),
                     SN.event_status(F.col("event_type")).alias("status_code"), F.col("ts").alias("fetched_at"),
                     F.floor(F.col("value")).cast("int").alias("ttl_hours"), F.col("event_id").alias("seq"))


def events_arrival_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table_stream(spark, sf_dir, "events")
    return ev.select(SN.event_url(F.col("user_id")).alias("key"), "ts", F.col("event_id").alias("seq"))


def events_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table_stream(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"),
                     (F.col("event_type") != "error").alias("ok"))


__all__ = ["failure_state", "fresh_arrivals", "interval_starts", "run_in_time_order", "run_upsert", "table_stream"]
