"""Readers for the parquet tables the jobs start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Tables whose rows carry whole pages or texts (every row costs several regex passes),
# with their unique id.
TEXT_TABLES = {"pages": "page_id", "documents": "doc_id"}


#: Session setting: partitions to spread narrow inputs over before CPU-heavy work per row (0: never).
SPREAD = "spark.newsprism.spreadPartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` on ``key`` (a unique id) into as many partitions as the session sets in
    SPREAD.  Off by default: an input of many files has its own splits, and whole texts would be
    shuffled for nothing.  Meant for inputs of one row group, as in a local benchmark."""
    n = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(n, key) if n > 0 else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; wall-clock NTZ timestamps become UTC instants (watermarks need them).

    A text table is spread over partitions first if the session asks for it (see ``spread``).
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:
        df = spread(df, TEXT_TABLES[name])
    casts = [F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, TimestampNTZType)
             else F.col(f.name) for f in df.schema.fields]
    if any(isinstance(f.dataType, TimestampNTZType) for f in df.schema.fields):
        df = df.select(*casts)
    return df
