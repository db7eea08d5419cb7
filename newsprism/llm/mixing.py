"""Mixing sources to target weights (operator 1).

* **Shares.**  Tokens (words) per source, aggregated with partial sums.
* **Exponent.**  Weights are p^a normalised, over the source shares p.  The entropy of the weights
  falls as a grows, and so does the largest number of passes over a source.  The exponent is the
  smallest one that keeps every source at ``max_repeat`` passes at most, but no smaller than
  what the target entropy asks for (a = 1 if the corpus has it already).  It is found by
  bisection: each round evaluates ``SECTIONS - 1`` inner points in one aggregate over the table of
  sources, so the sources never leave the cluster.
* **Realisation.**  The budget (all tokens of the corpus) times a source's weight, over its
  tokens, is its number of passes e.  A source is dealt into blocks of about ``block_rows``
  documents by a seeded hash, so a hot source is many blocks.  Inside a block documents stand in a
  seeded order (the permutation); whole passes give a copy each, and of the last, partial pass a block gives the documents
  up to its share of tokens, a document being taken if more than half of it lies below the mark.
  Blocks need nothing from each other, and each one is within half a document of its budget.

Edge cases: a null source is the source ``""``; a null or empty text counts no tokens: such rows
take part with every whole pass, and with the last one if their place in the block is below the
mark; repeated doc_ids are rows of their own, told apart by text; sources without tokens get weight
0; an empty table gives an empty result; extra columns of documents are carried only on demand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.scratch import small_side, written

SECTIONS, ROUNDS = 64, 8
BLOCK_ROWS = 1024
#: Target entropy as a share of the entropy of equal weights, and passes over a source at most.
ENTROPY, MAX_REPEAT = 0.97, 4.0
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(*parts: Column) -> Column:
    """60 bits of a seeded md5 (also to be had in other engines)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def share_table(docs: DataFrame) -> DataFrame:
    """source, tokens, n_docs."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))


def bisected(sources: DataFrame, entropy: float = ENTROPY, max_repeat: float = MAX_REPEAT) -> float:
    """The exponent (see the module's text)."""
    some = sources.where("tokens > 0")
    total, n = some.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0
    target = entropy * math.log(n)
    at = some.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def points(lo: float, hi: float) -> list[tuple[float, float, float]]:
        """(exponent, entropy, most passes) at the inner points of [lo, hi] and at its ends."""
        grid = F.array(*(F.lit(lo + (hi - lo) * i / SECTIONS) for i in range(SECTIONS + 1)))
        rows = at.select("p", F.explode(grid).alias("a")).select("a", "p", F.pow("p", "a").alias("w"))
        sums = rows.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.ln("w")).alias("s"), F.max(F.col("w") / F.col("p")).alias("m"))
        return [tuple(r) for r in sums.select("a", F.ln("z") - F.col("s") / F.col("z"), F.col("m") / F.col("z")).orderBy("a").collect()]

    # The entropy condition picks the largest exponent that still has the target; the limit may ask
    # for a larger one.  Both are monotone, so each is bisected on its own.
    def last_true(good, lo: float = 0.0, hi: float = 1.0) -> float:
        for _ in range(ROUNDS):
            rows = points(lo, hi)
            below = [a for a, h, m in rows if good(h, m)]
            if len(below) == len(rows):
                return hi
            if not below:
                return lo
            lo, hi = max(below), min(a for a, h, m in rows if not good(h, m))
        return lo

    by_entropy = last_true(lambda h, m: h >= target)
    by_limit = last_true(lambda h, m: m > max_repeat)
    return max(by_entropy, by_limit)


def weighted(sources: DataFrame, exponent: float) -> DataFrame:
    """source, tokens, n_docs, weight, passes (rounded to nine digits): shares to the exponent, normalised."""
    total = float(sources.agg(F.sum("tokens")).first()[0] or 1)
    power = sources.withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(exponent))))
    z = float(power.agg(F.sum("w")).first()[0] or 1)
    weight = F.coalesce(F.col("w") / F.lit(z), F.lit(0.0))
    return power.select("source", "tokens", "n_docs", F.round(weight, 9).alias("weight"),
                        F.round(F.when(F.col("tokens") > 0, weight * F.lit(total) / F.col("tokens")).otherwise(F.lit(1.0)), 6).alias("passes"))


def mixed(docs: DataFrame, entropy: float = ENTROPY, max_repeat: float = MAX_REPEAT, block_rows: int = BLOCK_ROWS,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, epoch (0..), block, place (in the block, from 0), n_tokens, weight, passes and
    the columns of ``carry``: one row per copy of a document that the mixture takes."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                      n_words(F.col("text")).alias("n_tokens"), F.xxhash64(F.col("text").cast("string")).alias("tie"),
                      *(F.col(c).alias(f"_{c}") for c in carry))
    sources = written(share_table(own.select("source", "n_tokens")), "sources")
    n = sources.count()
    plan = written(weighted(sources, bisected(sources, entropy, max_repeat)), "weights")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = own.join(small_side(plan.select("source", "n_docs", "weight", "passes"), n), "source")
    rows = rows.withColumn("block", order_key(F.lit("block"), key) % F.ceil(F.col("n_docs") / block_rows)) \
        .withColumn("turn", order_key(F.lit("turn"), key))
    # One block is one group; the source is split over its blocks.
    within = Window.partitionBy("source", "block")
    order = within.orderBy("turn", "doc_id", "tie")
    rows = rows.withColumns({
        "place": (F.row_number().over(order) - 1).cast("long"),
        "upto": F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "held": F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    whole = F.floor("passes")
    partial = (2 * F.col("upto") - F.col("n_tokens")) < 2 * (F.col("passes") - whole) * F.col("held")
    copies = (whole + F.when(partial, 1).otherwise(0)).cast("int")
    out = rows.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.select("doc_id", "source", F.col("epoch").cast("long").alias("epoch"), F.col("block").cast("long").alias("block"), "place",
                      "n_tokens", "weight", "passes", *(F.col(f"_{c}").alias(c) for c in carry))
