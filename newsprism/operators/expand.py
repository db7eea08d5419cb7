"""Merging and widening a result: U1, U2, L1, J1 (title expansion), J2 (low-visibility outlets).

Order is data: every row carries ``ord`` (bigint).  Layout, high to low bits:
segment (appended block, bits 60-62) | group rank inside the block (expansion
title or outlet domain, bits 40-59) | strategy rank (bits 32-39) | position.
"Base rows first, then expansion rows, title by title" is then just an order
by ``ord``; nothing is renumbered by a global window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.functions.urls import outlet_domain
from newsprism.operators.dedup import dedup_articles
from newsprism.operators.select import term_hits, query_terms
from newsprism.session import scratch_path

SEGMENT_SHIFT = 1 << 60
GROUP_SHIFT = 1 << 40
LOW_MASK = GROUP_SHIFT - 1
GROUPS = SEGMENT_SHIFT // GROUP_SHIFT
#: Rows that one search call can have at most (ten pages of results).
CALL_SPAN = 4096
# How many leading articles are expanded by default and the minimum title length.
MAX_TITLES_TO_EXPAND = 5
MIN_EXPAND_TITLE_CHARS = 20


def segment(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return df.withColumn(order, F.lit(n * SEGMENT_SHIFT) + F.col(order).bitwiseAND(F.lit(LOW_MASK)))


def append(base: DataFrame, extra: DataFrame, n: int = 1, order: str = "ord") -> DataFrame:
    """``base + extra`` in list order."""
    return append_segment(base, segment(extra, n, order))


def merge_sources(parts: list[tuple[int, DataFrame]], order: str = "ord",
                  position: str = "overall_position") -> DataFrame:
    """Union in strategy order; ord = (strategy rank, run of the search call, overall position).

    A row whose place does not fit its field raises an error instead of running into the next one."""
    def ranked(rank: int, p: DataFrame) -> DataFrame:
        at = F.col(position).cast("bigint")
        if "run" in p.columns:
            at = _within(at, CALL_SPAN, "position in a search call") + F.col("run").cast("bigint") * F.lit(CALL_SPAN)
        return p.withColumn(order, F.lit(rank).cast("bigint") * F.lit(1 << 32) + _within(at, 1 << 32, "position in a source")).drop("run")

    return reduce(DataFrame.unionByName, [ranked(rank, p) for rank, p in parts])


def _within(value: Column, limit: int, what: str) -> Column:
    return F.when(value < F.lit(limit), value).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} does not fit below {limit}: "), value.cast("string"))).cast("bigint"))


def top_n(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """L1: first ``n`` rows by order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(order).limit(n)


def top_k_per_group(df: DataFrame, groups: list[str], order: str, k: int) -> DataFrame:
    """First ``k`` rows per group by ``order``, skew-safe: Spark's window group limit keeps the
    first ``k`` of a group per task before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def positions(df: DataFrame, col: str, out: str = "pos", partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ``col`` order (ties in any order), without a single-partition window.

    The column is range-sorted into files once; a position is the place in the file plus the rows of the
    files before it.  The order is that of the stored files: a task that is computed again, or a
    second pass, sees the same positions."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, narrow = scratch_path(spark, "positions"), df.select(col)
    narrow.repartitionByRange(n, col).sortWithinPartitions(col).write.parquet(path)
    name = F.col("_metadata.file_name")
    rows = spark.read.schema(narrow.schema).parquet(path).select(
        col, F.col("_metadata.row_index").alias("_at"), F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("_part"), name.alias("_file"))
    counts = rows.groupBy("_part", "_file").agg(F.count(F.lit(1)).alias("_n"))  # a row per file
    before = F.sum("_n").over(Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1))
    offs = counts.select("_file", F.coalesce(before, F.lit(0)).alias("_off"))
    return rows.join(F.broadcast(offs), "_file").select(col, (F.col("_off") + F.col("_at")).cast("bigint").alias(out))


def global_rank(df: DataFrame, col: str, out: str = "rank", partitions: int | None = None) -> DataFrame:
    """0-based rank of the distinct sorted values of ``col`` (no single-partition window)."""
    return positions(df.select(col).distinct(), col, out, partitions)


#: Parts that a round of the selection cuts the remaining values into, and rounds of it.
RADIX, RADIX_ROUNDS = 1 << 16, 5


def _selection(vals: DataFrame, rank: Column) -> DataFrame:
    """_v: the value of 0-based ``rank`` (an expression over ``n``, the number of rows) among ``vals`` (_v), as a
    plan of one row.  Each round counts the values left in at most RADIX parts (signs and binary
    exponents first, then equal parts of what is left) and keeps the part that holds the rank: a
    float has 52 bits below its exponent, so that the last round's parts hold equal values."""
    size = F.abs("_v")
    parts = F.when(size == float("inf"), F.lit(4000.0)).when(size == 0, F.lit(0.0)).otherwise(F.floor(F.log2(size)) + 2000.0)
    left = vals.select("_v", (F.signum("_v") * parts).alias("_b"))
    pick = vals.agg(F.count(F.lit(1)).alias("n")).select(rank.cast("long").alias("_r"))
    for i in range(RADIX_ROUNDS):
        if i:
            at = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RADIX)
            inside = vals.join(F.broadcast(pick), (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
            left = inside.select("_v", F.when(F.col("_lo") == F.col("_hi"), F.lit(0)).otherwise(F.least(at, F.lit(RADIX - 1))).alias("_b"))
        counts = left.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most RADIX rows
        held = counts.withColumn("_before", before)
        pick = held.join(F.broadcast(pick.select("_r")), (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_n"))) \
            .select("_lo", "_hi", (F.col("_r") - F.col("_before")).alias("_r"))
    return pick.select(F.col("_lo").alias("_v"))


def exact_quantile(df: DataFrame, col: str, q: float) -> Column:
    """Exact linear-interpolation quantile of the non-null, non-NaN values, as a scalar of the plan (null if there
    are none): nothing runs before the action, and no task holds more than RADIX counts (Spark's
    ``percentile`` merges every distinct value in one task)."""
    vals = df.select((F.col(col).cast("double") + F.lit(0.0)).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    pos = F.lit(q) * (F.col("n") - 1)
    low = _selection(vals, F.floor(pos)).select(F.col("_v").alias("_low"))
    # Of the upper neighbour it is enough to know how many values are no larger than the lower one.
    around = vals.select("_v", low.scalar().alias("_low")).groupBy("_low").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") <= F.col("_low")).alias("upto"), F.min(F.when(F.col("_v") > F.col("_low"), F.col("_v"))).alias("next"))
    high = F.when(F.col("upto") > F.ceil(pos), F.col("_low")).otherwise(F.col("next"))
    # the same arithmetic as Spark's percentile aggregate
    mixed = (F.ceil(pos) - pos) * F.col("_low") + (pos - F.floor(pos)) * high
    return around.select(F.when((F.floor(pos) == F.ceil(pos)) | (high == F.col("_low")), F.col("_low")).otherwise(mixed).alias("q")).scalar()


def expansion_titles(articles: DataFrame, n: int = MAX_TITLES_TO_EXPAND, order: str = "ord") -> DataFrame:
    """The first ``n`` articles by order, then those with titles longer than 20 (slice, then filter).

    At most ``n`` rows, so numbering them with an unpartitioned window is bounded.
    """
    first = top_n(articles, n, order).select("title", order)
    ranked = first.withColumn("_xr", F.row_number().over(Window.orderBy(order)) - 1)
    return ranked.filter(F.length("title") > MIN_EXPAND_TITLE_CHARS).select(F.col("title").alias("_xq"), "_xr")


def title_searches(titles: DataFrame, searches: DataFrame) -> DataFrame:
    """Archived first result pages of the searches for the given titles (equi-join on the query)."""
    return searches.filter(F.col("page") == 1).join(titles, F.col("query") == F.col("_xq"))


def expand_with_titles(base: DataFrame, searches: DataFrame, order: str = "ord", n_titles: int = MAX_TITLES_TO_EXPAND) -> DataFrame:
    """Each of the first ``n_titles`` titles is looked up in every source, one page each
    (``searches``: article rows of archived searches with their ``query``, ``page`` and order); hits are tagged,
    appended after the base rows (title by title, source by source) and the whole list is
    deduplicated again."""
    hits = title_searches(expansion_titles(base, n_titles, order), searches)
    hits = hits.withColumn(order, F.lit(SEGMENT_SHIFT) + _within(F.col("_xr").cast("bigint"), GROUPS, "title") * F.lit(GROUP_SHIFT)
                           + (F.col(order).bitwiseAND(F.lit(LOW_MASK))))
    tagged = hits.withColumn("source_type", F.lit("google_search_expansion"))
    return dedup_articles(append_segment(base, tagged), order)


def append_segment(base: DataFrame, tagged: DataFrame) -> DataFrame:
    """``base`` followed by rows whose order already lies in a later segment."""
    return base.unionByName(tagged.select(*base.columns))


def first_available(strategies: list[str], available: list[str]) -> str | None:
    for s in strategies:
        if s in available:
            return s
    return None


def search_small_media(base: DataFrame, corpus: DataFrame, domains: DataFrame, query: str,
                       strategy: str, order: str = "ord", per_domain: int | None = None) -> DataFrame:
    """For every low-visibility domain (sorted), the query restricted to that site on the
    first available source only; hits tagged ``from_media_list``, appended domain by domain,
    deduplicated again.

    The site restriction is a join on the outlet domain of the url (``source`` may hold a
    display name); the domain list can be any size, so Spark picks the join strategy.
    ``per_domain`` keeps the first so many hits of a domain (None: all of them).
    """
    terms = query_terms(query)
    hits = corpus.filter(F.col("source_type") == strategy)
    if terms:
        hits = hits.filter(term_hits(terms) >= 1)
    ranked = global_rank(domains, "domain", "_dr")
    hits = hits.withColumn("domain", outlet_domain(F.col("url"))).join(ranked, "domain")
    if per_domain is not None:
        hits = top_k_per_group(hits, ["domain"], order, per_domain)
    hits = hits.withColumn(order, F.lit(2 * SEGMENT_SHIFT) + _within(F.col("_dr"), GROUPS, "domain rank") * F.lit(GROUP_SHIFT)
                           + F.col(order).bitwiseAND(F.lit(LOW_MASK)))
    tagged = hits.withColumn("source_type", F.lit("from_media_list"))
    return dedup_articles(append_segment(base, tagged), order)


__all__ = ["append", "merge_sources", "top_n", "top_k_per_group", "global_rank", "expand_with_titles",
           "search_small_media", "first_available"]
