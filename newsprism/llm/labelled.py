"""The labelled rows that the two learned operators are fitted on: all (operator 10) or a bounded sample (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.scratch import written

#: Labelled rows that operator 7 is fitted on at most, those with the smallest hash of their doc_id.
FIT_ROWS = 20_000


def held_out(doc_id: Column, parts: int, held: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is ``held``; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % parts == held, F.lit(False))


def training_ids(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """doc_id, label (0 or 1) of all labelled ids outside the held-out part; an id that has both labels counts as 1."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")) \
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, held)) \
        .groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, label of the rows of at most ``most`` of the ``training_ids``.

    The sample of ids is of a fixed bound, so it is broadcast to the scan of the texts.
    """
    ids = training_ids(labels, label, parts, held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(ids), "doc_id"), f"fit-{label}")
