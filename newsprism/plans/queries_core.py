"""Core registered queries: dedup, relevance, text cascade and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions.text import title_key
from newsprism.functions.urls import url_key
from newsprism.operators import extract as X
from newsprism.operators.dedup import dedup_articles
from newsprism.operators.select import filter_relevant, query_terms
from newsprism.plans import sqlgen as S
from newsprism.plans.articles import pages_articles
from newsprism.plans.catalog import register
from newsprism.sources.snapshots import pages_snapshots
from newsprism.sources.tables import read_table

FLAGSHIP_QUERY = "tion que news"


def _sql_terms_hits(terms: list[str]) -> str:
    hay = "lower(coalesce(title, '') || ' ' || coalesce(body, ''))"
    return " + ".join(f"(CASE WHEN contains({hay}, {S.lit(t)}) THEN 1 ELSE 0 END)" for t in terms) or "0"


ART = S.pages_articles_sql()
ART_KEYS = f"SELECT ord, {S.title_key('title')} AS tkey, {S.url_key('url')} AS ukey FROM ({ART})"
KEPT = S.greedy_dedup_sql(ART_KEYS)
CLEAN_PAGES = f"SELECT page_id, c, {S.main_region('c')} AS r FROM (SELECT page_id, {S.strip_noise('html')} AS c FROM pages)"


# --- D1 -----------------------------------------------------------------------

def d1_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = pages_articles(spark, sf_dir, materialize=True)
    kept = dedup_articles(arts)
    return kept.select("ord", "url", "title", title_key("title").alias("tkey"), url_key("url").alias("ukey"))


register("d1_greedy_dedup", f"""
SELECT a.ord, a.url, a.title, {S.title_key('a.title')} AS tkey, {S.url_key('a.url')} AS ukey
FROM ({ART}) a WHERE a.ord IN ({KEPT})""")(d1_greedy_dedup)


# --- F1 / F2 keys ---------------------------------------------------------------

def f1_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_articles(spark, sf_dir).select("ord", "title", title_key("title").alias("tkey"))


register("f1_title_key", f"SELECT ord, title, {S.title_key('title')} AS tkey FROM ({ART})")(f1_title_key)


def f2_url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", "url", url_key("url").alias("ukey"))


register("f2_url_key", f"SELECT page_id, url, {S.url_key('url')} AS ukey FROM pages")(f2_url_key)


# --- P1 -------------------------------------------------------------------------

def p1_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_relevant(pages_articles(spark, sf_dir), FLAGSHIP_QUERY).select("ord", "title", "body")


register("p1_relevance", f"""
SELECT ord, title, body FROM ({ART}) WHERE {_sql_terms_hits(query_terms(FLAGSHIP_QUERY))} >= 1""")(p1_relevance)


# --- X1 -------------------------------------------------------------------------

def x1_text_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.with_clean_html(read_table(spark, sf_dir, "pages"))
    c, r = F.col("_clean"), F.col("_region")
    return pages.select("page_id", X.cascade_pick(c, r).alias("x")).select("page_id", "x.extractor", F.col("x.text").alias("article_text"))


register("x1_text_cascade", f"""
SELECT page_id, {S.cascade_winner('c', 'r')} AS extractor, {S.cascade('c', 'r')} AS article_text
FROM ({CLEAN_PAGES})""")(x1_text_cascade)


# --- Flagship: archive -> articles -> D1 -> P1 -> J4 -> X1 ------------------------

def flagship(spark: SparkSession, sf_dir: str, query: str = FLAGSHIP_QUERY) -> DataFrame:
    """Archived pages -> articles -> D1 -> P1; the page bodies join the survivors once, by url
    (J4), and the cascade fills the text (X2)."""
    arts = pages_articles(spark, sf_dir, materialize=True)
    kept = filter_relevant(dedup_articles(arts), query)
    filled = X.fill_article_text(kept, pages_snapshots(spark, sf_dir))
    return filled.select("ord", "url", "title", "source", F.length("article_text").alias("text_chars"))


_SNAP = f"""SELECT url, c, {S.main_region('c')} AS r FROM (
  SELECT url, {S.strip_noise('arg_max(html, page_id)')} AS c FROM pages GROUP BY url)"""
register("flagship", f"""
SELECT a.ord, a.url, a.title, a.source,
  CAST(length(CASE WHEN p.url IS NULL THEN '' ELSE {S.cascade('p.c', 'p.r')} END) AS INTEGER) AS text_chars
FROM ({ART}) a LEFT JOIN ({_SNAP}) p ON a.url = p.url
WHERE a.ord IN ({KEPT}) AND {_sql_terms_hits(query_terms(FLAGSHIP_QUERY))} >= 1""")(flagship)
