"""Registered queries for outlet lists and result widening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions.urls import outlet_domain
from newsprism.operators import expand as EX
from newsprism.operators.dedup import dedup_articles
from newsprism.operators.select import filter_relevant, filter_sources, query_terms
from newsprism.plans import sqlgen as S
from newsprism.plans.articles import STRATEGY_ORDER, pages_articles
from newsprism.plans.catalog import register
from newsprism.plans.queries_core import ART, FLAGSHIP_QUERY, KEPT, _sql_terms_hits
from newsprism.sources import outlets as O

EN_HEADER = ("source", "name", "visibility")
RU_HEADER = ("URL статьи", "Название", "Заметность")
POS_HEADER = ("col_a", "col_b", "col_c")

SUP_SITE = "('https://www.' || lower(replace(s_name, '#', '-')) || '.example.com/news')"
SUP = f"SELECT {SUP_SITE} AS source, s_acctbal AS visibility FROM supplier WHERE s_acctbal IS NOT NULL"
Q1 = f"(SELECT quantile_cont(visibility, 0.25) FROM ({SUP}))"


def s9_outlet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.standardize(O.supplier_outlets(spark, sf_dir, POS_HEADER))


register("s9_outlet_list", SUP)(s9_outlet_list)


def a1_visibility_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.standardize(O.supplier_outlets(spark, sf_dir, EN_HEADER))
    return out.agg(O.first_quartile(out).alias("q1"), F.count("*").alias("n_outlets"))


register("a1_visibility_q1", f"SELECT {Q1} AS q1, count(*) AS n_outlets FROM ({SUP})")(a1_visibility_q1)


def p9_low_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.low_visibility(O.standardize(O.supplier_outlets(spark, sf_dir, EN_HEADER)))


register("p9_low_visibility", f"SELECT source, visibility FROM ({SUP}) WHERE visibility < {Q1}")(p9_low_visibility)


def a2_outlet_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.outlet_domains(O.standardize(O.supplier_outlets(spark, sf_dir, RU_HEADER)))


register("a2_outlet_domains", f"""
SELECT DISTINCT {S.outlet_domain('source')} AS domain FROM ({SUP})
WHERE visibility < {Q1} AND {S.outlet_domain('source')} <> ''""")(a2_outlet_domains)


def f5_outlet_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = pages_articles(spark, sf_dir)
    return arts.select("ord", "url", outlet_domain(F.col("url")).alias("domain"))


register("f5_outlet_domain", f"SELECT ord, url, {S.outlet_domain('url')} AS domain FROM ({ART})")(f5_outlet_domain)


def l1_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EX.top_n(dedup_articles(pages_articles(spark, sf_dir, materialize=True)), EX.MAX_TITLES_TO_EXPAND).select("ord", "title")


register("l1_top_n", f"SELECT ord, title FROM ({ART}) WHERE ord IN ({KEPT}) ORDER BY ord LIMIT {EX.MAX_TITLES_TO_EXPAND}")(
    l1_top_n)


# --- J1 -------------------------------------------------------------------------

def title_searches(arts: DataFrame) -> DataFrame:
    """An archive of searches by title: for the title of every article, the articles that follow it in
    the archive's runs of ten ids, both engines, all on the first result page."""
    by_run = arts.withColumn("_run", F.expr(f"overall_position div {SEARCH_RUN}"))
    queries = by_run.select("_run", F.col("title").alias("query"), F.col("overall_position").alias("_at"))
    hits = by_run.join(queries, "_run").where(F.col("overall_position") > F.col("_at"))
    return hits.withColumn("page", F.lit(1)).drop("_run", "_at").dropDuplicates(["query", "ord"])


SEARCH_RUN = 10


def j1_title_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base is one source only, so that hits of the other one are new."""
    arts = pages_articles(spark, sf_dir, materialize=True)
    base = dedup_articles(filter_sources(arts, ["searxng"]))
    return EX.expand_with_titles(base, title_searches(arts)).select("ord", "url", "title", "source_type")


_J1_KEPT = S.greedy_dedup_sql("SELECT * FROM bk")
_J1_ALLKEPT = S.greedy_dedup_sql("SELECT * FROM xk")
register("j1_title_expansion", f"""
WITH art AS MATERIALIZED ({ART}),
src AS MATERIALIZED (SELECT * FROM art WHERE source_type = 'searxng'),
bk AS MATERIALIZED (SELECT ord, {S.title_key('title')} AS tkey, {S.url_key('url')} AS ukey FROM src),
base AS MATERIALIZED (SELECT * FROM src WHERE ord IN ({_J1_KEPT})),
xt AS MATERIALIZED (SELECT title AS xq, xr FROM (SELECT title, row_number() OVER (ORDER BY ord) - 1 AS xr FROM (
  SELECT title, ord FROM base ORDER BY ord LIMIT {EX.MAX_TITLES_TO_EXPAND})) WHERE length(title) > {EX.MIN_EXPAND_TITLE_CHARS}),
hits AS MATERIALIZED (SELECT DISTINCT h.url, h.title, h.ord, xt.xr FROM xt JOIN art q ON q.title = xt.xq
  JOIN art h ON h.overall_position // {SEARCH_RUN} = q.overall_position // {SEARCH_RUN} AND h.overall_position > q.overall_position),
al AS MATERIALIZED (SELECT url, title, source_type, ord FROM base UNION ALL SELECT url, title, 'google_search_expansion',
  CAST({EX.SEGMENT_SHIFT} + xr * {EX.GROUP_SHIFT} + (ord & {EX.LOW_MASK}) AS BIGINT) FROM hits),
xk AS MATERIALIZED (SELECT ord, {S.title_key('title')} AS tkey, {S.url_key('url')} AS ukey FROM al)
SELECT ord, url, title, source_type FROM al WHERE ord IN ({_J1_ALLKEPT})""")(j1_title_expansion)


# --- J2 -------------------------------------------------------------------------

def j2_outlet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base is one source only; the outlets are searched on the other one."""
    corpus = pages_articles(spark, sf_dir, materialize=True)
    base = filter_relevant(dedup_articles(filter_sources(corpus, ["google_search"])), FLAGSHIP_QUERY)
    domains = O.outlet_domains(O.page_outlets(corpus))
    strategy = EX.first_available(STRATEGY_ORDER, ["searxng", "google_search"])
    return EX.search_small_media(base, corpus, domains, FLAGSHIP_QUERY, strategy).select(
        "ord", "url", "title", "source_type")


_HITS = _sql_terms_hits(query_terms(FLAGSHIP_QUERY))
register("j2_outlet_search", f"""
WITH art AS MATERIALIZED ({ART}),
src AS MATERIALIZED (SELECT * FROM art WHERE source_type = 'google_search'),
bk AS MATERIALIZED (SELECT ord, {S.title_key('title')} AS tkey, {S.url_key('url')} AS ukey FROM src),
base AS MATERIALIZED (SELECT * FROM src WHERE ord IN ({S.greedy_dedup_sql("SELECT * FROM bk")}) AND {_HITS} >= 1),
outs AS MATERIALIZED (SELECT 'https://' || source || '/' AS source, CAST(count(*) AS DOUBLE) AS visibility FROM art GROUP BY source),
dom AS MATERIALIZED (SELECT DISTINCT {S.outlet_domain('source')} AS domain FROM outs
  WHERE visibility < (SELECT quantile_cont(visibility, 0.25) FROM outs) AND {S.outlet_domain('source')} <> ''),
rk AS MATERIALIZED (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS dr FROM dom),
hits AS MATERIALIZED (SELECT c.url, c.title, c.ord, rk.dr FROM (SELECT *, {S.outlet_domain('url')} AS od FROM art WHERE source_type = 'searxng' AND {_HITS} >= 1) c
  JOIN rk ON c.od = rk.domain),
al AS MATERIALIZED (SELECT url, title, source_type, ord FROM base UNION ALL SELECT url, title, 'from_media_list',
  CAST({2 * EX.SEGMENT_SHIFT} + dr * {EX.GROUP_SHIFT} + (ord & {EX.LOW_MASK}) AS BIGINT) FROM hits),
xk AS MATERIALIZED (SELECT ord, {S.title_key('title')} AS tkey, {S.url_key('url')} AS ukey FROM al)
SELECT ord, url, title, source_type FROM al WHERE ord IN ({S.greedy_dedup_sql("SELECT * FROM xk")})""")(j2_outlet_search)
