"""Shared helpers: written scratch tables, size-checked broadcasts, Arrow batch bounds.

Scratch tables are Parquet folders below the reliable checkpoint folder of the session
(``spark.checkpoint.dir``), so that every executor and the driver can read them and a lost
executor costs a retry, not the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.session import ensure_checkpoint_dir, remove_path

#: Rows of a narrow table (a few longs each) that a broadcast may hold: about 100 MB.
MAX_BROADCAST_ROWS = 1_000_000
#: Bounds of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at a time small: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return stored(spark, path, df.schema)


def stored(spark: SparkSession, path: str, schema, *parts: str) -> DataFrame:
    """The scratch table below ``path`` (of its folders ``parts``, if given)."""
    out = spark.read.schema(schema).parquet(*[f"{path}/{x}" for x in parts] or [path])
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables, as ``written`` returned them, that nothing reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t.scratch_path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go when it ends; else they stay until the driver happens
    to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_side(df: DataFrame, rows: int | None = None, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (written, narrow) table has at most ``most`` rows; else leave the
    choice to Spark, which then shuffles both sides."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
