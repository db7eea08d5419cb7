"""Article rows derived from the archived ``pages`` table.

``pages(page_id, url, html)`` plays the archive of fetched result pages: the
title comes from ``<title>``, the snippet from the first paragraph, ``ord`` is
``page_id``.  ``https`` rows play the metasearch source and ``http`` rows the
web-search source, so the union has two sources in strategy order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions.html import FIRST_P_RE, strip_noise
from newsprism.functions.text import clean_snippet, collapse_ws, decode_entities
from newsprism.functions.urls import decode_idn, source_domain_raw
from newsprism.sources.tables import read_table

TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
RESULTS_PER_PAGE = 10

# Strategy order used when sources are merged (U1); fixed as in the reference.
STRATEGY_ORDER = ["searxng", "google_search", "google_news", "yandex"]


def strategy_ord(rank, position) -> F.Column:
    """U1 order without a global window: strategy rank in the high bits, position below."""
    return (rank.cast("bigint") * F.lit(1 << 32) + position.cast("bigint")).cast("bigint")


def page_title(html) -> F.Column:
    return collapse_ws(decode_entities(F.regexp_replace(F.regexp_extract(html, TITLE_RE, 1), r"<[^>]*>", "")))


def first_paragraph(html) -> F.Column:
    """Text of the first ``<p>`` of the noise-stripped page, up to the next block boundary."""
    first = F.regexp_extract(strip_noise(html), FIRST_P_RE, 1)
    return collapse_ws(decode_entities(F.regexp_replace(first, r"<[^>]*>", "")))


def pages_articles(spark: SparkSession, sf_dir: str, as_of: str = "2024-02-01 00:00:00",
                   with_html: bool = False, materialize: bool = False) -> DataFrame:
    """Article table (reference schema + ``ord``) built from ``pages``.

    ``materialize=True`` parses once and keeps the (narrow) article table as a reliable
    checkpoint, for jobs that read it several times (dedup rounds, widening).
    """
    pages = read_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    cols = [
        F.col("url"),
        page_title(F.col("html")).alias("title"),
        source_domain_raw(F.col("url")).alias("source"),
        F.to_timestamp(F.lit(as_of)).alias("date"),
        clean_snippet(first_paragraph(F.col("html"))).alias("body"),
        F.expr(f"page_id div {RESULTS_PER_PAGE} + 1").cast("bigint").alias("page"),
        (F.pmod(pid, F.lit(RESULTS_PER_PAGE)) + 1).cast("int").alias("position"),
        (pid + 1).cast("bigint").alias("overall_position"),
        F.lit("").alias("article_text"),
        F.when(F.col("url").startswith("https:"), F.lit("searxng")).otherwise(F.lit("google_search")).alias("source_type"),
        strategy_ord(F.when(F.col("url").startswith("https:"), F.lit(0)).otherwise(F.lit(1)), pid).alias("ord"),
    ]
    if with_html:
        cols.append(F.col("html"))
    out = pages.select(*cols)
    if not materialize:
        return out
    return decode_idn(out.checkpoint(eager=True), "source")


ARTICLE_COLUMNS = ["url", "title", "source", "date", "body", "page", "position", "overall_position",
                   "article_text", "source_type"]
