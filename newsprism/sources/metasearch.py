"""Archived metasearch JSON pages -> articles.

Archive schema (one row per fetched result page)::

    query string, engine string, page int, status int, body string (JSON), fetched_at timestamp

Paging rules of the reference, per search call (query, engine and, where the archive holds
several fetch runs of a query, the run):

* pages are read in order; the first page whose ``results`` is empty stops paging
  and later archived pages are ignored (W3);
* a non-200 status or a body that is not a JSON object, on a page before that
  stop, fails the whole search: the source contributes nothing (W4-style);
* ``position`` is the 1-based index in ``results`` (W2) and ``overall_position``
  the running number over all kept rows of the search (W1).

A search call has at most ``max_pages`` result pages, so the windows below, over narrow
article rows, are bounded by that, whatever the size of the archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from newsprism.functions.dates import parse_date
from newsprism.functions.text import clean_snippet
from newsprism.functions.urls import metasearch_url, source_domain_raw
from newsprism.plans.articles import first_paragraph, page_title
from newsprism.sources.tables import read_table

#: Columns that name a search call, as far as an archive has them.
SEARCH = ("query", "engine", "run")
RESULT = StructType([StructField(n, StringType()) for n in
                     ("url", "title", "content", "publishedDate", "engine", "category")])
PAYLOAD = StructType([StructField("query", StringType()), StructField("results", ArrayType(RESULT))])


def frontier(queries: DataFrame, engines: list[str], max_pages: int) -> DataFrame:
    """Query x engine x page, by exploding literal arrays (no cross join)."""
    return (queries.withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))
            .withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages)))))


def search_columns(archive: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in SEARCH if c in archive.columns)


def ingest(archive: DataFrame, as_of=None, source_type: str = "searxng",
           search: tuple[str, ...] | None = None) -> DataFrame:
    """Archived JSON result pages -> article rows (reference schema + the search columns).

    ``search`` names the columns of one search call (default: those of SEARCH that the archive
    has); paging windows never span more than one call.  Bodies are parsed once, where they are
    read; only the narrow result rows are shuffled, once.
    """
    search = search or search_columns(archive)
    ts = as_of if as_of is not None else F.col("fetched_at")
    valid_obj = F.coalesce(F.try_parse_json(F.col("body")).isNotNull()
                           & F.startswith(F.ltrim(F.col("body")), F.lit("{")), F.lit(False))
    pages = archive.select(*search, "page", "fetched_at", ((F.col("status") != 200) | ~valid_obj).alias("_bad"),
                           F.from_json(F.col("body"), PAYLOAD)["results"].alias("_rs"))
    # A page without results stays as one row: it may be the one that stops the paging.
    rows = pages.select(*search, "page", "fetched_at", "_bad", F.coalesce(F.size("_rs"), F.lit(0)).alias("_n"),
                        F.posexplode_outer(F.when(~F.col("_bad"), F.col("_rs"))).alias("_i", "r"))
    url = F.coalesce(F.col("r.url"), F.lit(""))
    arts = rows.select(
        *search, "_bad", "_n", F.col("r").isNotNull().alias("_row"),
        url.alias("url"),
        F.coalesce(F.col("r.title"), F.lit("")).alias("title"),
        source_domain_raw(url).alias("source"),
        parse_date(F.coalesce(F.col("r.publishedDate"), F.lit("")), ts).alias("date"),
        clean_snippet(F.coalesce(F.col("r.content"), F.lit(""))).alias("body"),
        F.col("page").cast("int").alias("page"),
        (F.col("_i") + 1).cast("int").alias("position"),
        F.lit("").alias("article_text"),
        F.lit(source_type).alias("source_type"),
        F.lit(True).alias("source_from_url"))
    w = Window.partitionBy(*search)
    # First page that is good and empty; W4-style: a bad page before it voids the search.
    arts = arts.withColumn("_stop", F.min(F.when(~F.col("_bad") & (F.col("_n") <= 0), F.col("page"))).over(w))
    reached = F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))
    arts = arts.withColumn("_void", F.max((F.col("_bad") & reached).cast("int")).over(w) == 1)
    arts = arts.filter(reached & ~F.col("_void") & F.col("_row"))
    number = F.row_number().over(w.orderBy("page", "position"))
    return arts.withColumn("overall_position", number.cast("int")).drop("_bad", "_n", "_row", "_stop", "_void")


# --- an archive built by Spark from the given ``pages`` table -----------------------

ARCHIVE_PAGE_IDS = 40
CALL_PAGE_IDS = 400
FAILED_MARK = "cheap-pills"
BASE_TS = "2024-01-01 00:00:00"


def pages_serp_archive(spark: SparkSession, sf_dir: str, max_pages: int = 10,
                       engine: str = "searxng", base_url: str = "http://localhost:8080",
                       language: str = "en") -> DataFrame:
    """A metasearch archive derived from ``pages``.

    Query = the language segment of the url path; a search call = that query in a run of 400
    page ids; result page = a window of 40 page ids; results in page-id order.  The number of
    calls grows with the table, ten pages each.  A page whose first result is a url with
    ``cheap-pills`` was archived as a failed fetch (status 503, empty body).
    Pages of the frontier with no rows were archived as empty result pages.
    """
    pages = read_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    base = F.to_timestamp(F.lit(BASE_TS))
    stamp = F.timestamp_micros(F.unix_micros(base) + pid * F.lit(3_600_000_000))
    published = (F.when(F.pmod(pid, F.lit(3)) == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                 .when(F.pmod(pid, F.lit(3)) == 1, F.date_format(stamp, "MMM d, yyyy"))
                 .otherwise(F.concat((F.pmod(pid, F.lit(48)) + 1).cast("string"), F.lit(" hours ago"))))
    para = first_paragraph(F.col("html"))
    content = F.when(F.pmod(pid, F.lit(2)) == 0,
                     F.concat(F.date_format(stamp, "d MMM yyyy"), F.lit(" — "), para)).otherwise(para)
    res = pages.select(
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("query"),
        F.expr(f"page_id div {CALL_PAGE_IDS}").alias("run"),
        F.expr(f"page_id % {CALL_PAGE_IDS} div {ARCHIVE_PAGE_IDS} + 1").cast("int").alias("page"),
        F.struct(pid.alias("pid"), F.col("url"), page_title(F.col("html")).alias("title"),
                 content.alias("content"), published.alias("publishedDate"),
                 F.lit("bing").alias("engine"), F.lit("news").alias("category")).alias("r"))
    res = res.filter(F.col("query") != "")
    grouped = (res.groupBy("query", "run", "page")
               .agg(F.array_sort(F.collect_list("r")).alias("rs"))
               .withColumn("failed", F.contains(F.col("rs")[0]["url"], F.lit(FAILED_MARK))))
    payload = F.to_json(F.struct(F.col("query"), F.size("rs").alias("number_of_results"),
                                 F.transform("rs", lambda r: r.dropFields("pid")).alias("results")))
    got = grouped.select("query", "run", "page", F.when(F.col("failed"), F.lit(503)).otherwise(F.lit(200)).alias("status"),
                         F.when(F.col("failed"), F.lit("")).otherwise(payload).alias("body"))
    front = frontier(res.select("query", "run").distinct(), [engine], max_pages)
    empty = F.to_json(F.struct(F.col("query"), F.lit(0).alias("number_of_results"),
                               F.array().cast(ArrayType(RESULT)).alias("results")))
    out = front.join(got, ["query", "run", "page"], "left")
    return out.select(
        "query", "engine", "run", "page",
        F.coalesce(F.col("status"), F.lit(200)).alias("status"),
        F.coalesce(F.col("body"), empty).alias("body"),
        F.to_timestamp(F.lit("2024-01-20 00:00:00")).alias("fetched_at"),
        metasearch_url(F.lit(base_url), F.col("query"), F.lit(language), F.col("page")).alias("request_url"))


__all__ = ["ingest", "frontier", "pages_serp_archive"]
