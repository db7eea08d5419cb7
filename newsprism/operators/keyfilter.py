"""A Bloom filter over keys as a small table, probed where the wide rows are scanned.

The filter has WORDS words of 64 bits; a key sets two bits of one word.  It is built inside the plan
by one aggregate over narrow keys (``bit_or`` per word) and broadcast: at most WORDS rows of two longs,
whatever the number of keys.  Rows that fail it can't match and need no shuffle; those that pass are
joined exactly afterwards.  False positives: 0.1 % at 1 M keys, 1.4 % at 4 M, 15 % at 16 M; beyond
that the filter lets most rows pass and only the join that follows it works (results are the same).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20


def _hash(cols: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (WORDS.bit_length() - 1))


def _mask(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(63)).cast("int")))


def key_filter(keys: DataFrame, cols: list[str]) -> DataFrame:
    """_word, _bits: the filter of the keys' ``cols``."""
    h = keys.select(_hash(cols).alias("_h"))
    return h.select(_word(F.col("_h")).alias("_word"), _mask(F.col("_h")).alias("_m")).groupBy("_word").agg(F.bit_or("_m").alias("_bits"))


def flagged(rows: DataFrame, keys: DataFrame, cols: list[str], out: str = "_maybe") -> DataFrame:
    """``rows`` with ``out``: whether the row's ``cols`` may be among ``keys``.  No shuffle of ``rows``."""
    h = rows.withColumn("_h", _hash(cols)).withColumn("_word", _word(F.col("_h")))
    joined = h.join(F.broadcast(key_filter(keys, cols)), "_word", "left")
    m = _mask(F.col("_h"))
    return joined.withColumn(out, F.coalesce(F.col("_bits").bitwiseAND(m) == m, F.lit(False))).drop("_h", "_word", "_bits")


def maybe_in(rows: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """The rows whose ``cols`` may be among ``keys``: all that are, and few others."""
    h = rows.withColumn("_h", _hash(cols)).withColumn("_word", _word(F.col("_h")))
    joined = h.join(F.broadcast(key_filter(keys, cols)), "_word")
    m = _mask(F.col("_h"))
    return joined.where(F.col("_bits").bitwiseAND(m) == m).select(*rows.columns)
