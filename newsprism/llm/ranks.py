"""Ranks without a global window: rows are range-sorted into files once, and a row's rank within its
class is its place in the file plus the counts of the files before it.

The order is that of the written files, so a recomputed task, or a second pass over the table, sees
the same ranks.  No class needs to fit a task: one of a third of all rows is many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.scratch import scratch_path


def placed(df: DataFrame) -> DataFrame:
    """A table read from Parquet files of one job, with ``_file`` (its number) and ``_row`` (place in it)."""
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long") * 1_000_000 \
        + F.coalesce(F.nullif(F.regexp_extract(name, r"-c(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    return df.select("*", number.alias("_file"), F.col("_metadata.row_index").alias("_row"))


def range_sorted(df: DataFrame, keys: list[str | Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` written in the order of ``keys``, with ``_file`` and ``_row``.  Keys should tell rows apart:
    rows with equal keys go to one task.  ``df`` is read twice (Spark samples it for the bounds)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)).sortWithinPartitions(*keys).write.parquet(path)
    return placed(spark.read.schema(df.schema).parquet(path))


def segments(table: DataFrame, by: str) -> DataFrame:
    """by, _file, _first (row of the class's first row in the file), _here (its rows there), _before (its
    rows in earlier files), _all; at most a row per file and one per class, if ``by`` leads the order."""
    here = table.groupBy(by, "_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_here"))
    w = Window.partitionBy(by)
    before = F.coalesce(F.sum("_here").over(w.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return here.select("*", before.alias("_before"), F.sum("_here").over(w).alias("_all"))


def ranked(table: DataFrame, pieces: DataFrame, by: str, rank: str) -> DataFrame:
    """``table`` with ``rank`` (from 0, within ``by``); ``pieces``: what ``segments`` gave, hinted at will."""
    joined = table.join(pieces, [by, "_file"])
    return joined.withColumn(rank, F.col("_row") - F.col("_first") + F.col("_before"))
