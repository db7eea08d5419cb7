"""Registered queries for the metasearch JSON source and search URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions import urls as U
from newsprism.functions.dates import iso_format
from newsprism.plans import sqlgen as S
from newsprism.plans.catalog import register
from newsprism.plans.articles import pages_articles
from newsprism.sources import metasearch as M

MAX_PAGES = 10
FETCHED = "2024-01-20 00:00:00"


def s1_metasearch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = M.ingest(M.pages_serp_archive(spark, sf_dir, max_pages=MAX_PAGES))
    return arts.select("query", "engine", "run", "page", "position", "overall_position", "url", "title", "source",
                       iso_format("date").alias("date"), "body")


_STAMP = f"(TIMESTAMP '{M.BASE_TS}' + page_id * INTERVAL 1 HOUR)"
_CONTENT = (f"(CASE WHEN page_id % 2 = 0 THEN strftime({_STAMP}, '%-d %b %Y') || ' — ' || "
            f"{S.first_paragraph('html')} ELSE {S.first_paragraph('html')} END)")
_DATE = (f"(CASE WHEN page_id % 3 = 0 THEN {_STAMP} WHEN page_id % 3 = 1 THEN date_trunc('day', {_STAMP}) "
         f"ELSE TIMESTAMP '{FETCHED}' - (page_id % 48 + 1) * INTERVAL 1 HOUR END)")
_RES = f"""SELECT * FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1) AS query,
  page_id // {M.CALL_PAGE_IDS} AS run, CAST(page_id % {M.CALL_PAGE_IDS} // {M.ARCHIVE_PAGE_IDS} + 1 AS INTEGER) AS page, page_id AS pid, url,
  {S.page_title('html')} AS title, {S.source_domain_raw('url')} AS source, {_DATE} AS d, {_CONTENT} AS content
  FROM pages) WHERE query <> ''"""
S1_SQL = f"""WITH res AS ({_RES}),
pg AS (SELECT query, run, page, count(*) AS n, contains(arg_min(url, pid), '{M.FAILED_MARK}') AS failed FROM res GROUP BY 1, 2, 3),
fr AS (SELECT query, run, unnest(range(1, {MAX_PAGES + 1})) AS page FROM (SELECT DISTINCT query, run FROM res)),
st AS (SELECT query, run, page, coalesce(n, 0) AS n, coalesce(failed, false) AS bad FROM fr LEFT JOIN pg USING (query, run, page)),
sp AS (SELECT query, run, min(page) FILTER (WHERE NOT bad AND n = 0) AS stop FROM st GROUP BY query, run),
vd AS (SELECT query, run, bool_or(bad AND (sp.stop IS NULL OR st.page < sp.stop)) AS void FROM st JOIN sp USING (query, run) GROUP BY query, run)
SELECT r.query, 'searxng' AS engine, r.run, r.page,
  CAST(row_number() OVER (PARTITION BY r.query, r.run, r.page ORDER BY r.pid) AS INTEGER) AS position,
  CAST(row_number() OVER (PARTITION BY r.query, r.run ORDER BY r.page, r.pid) AS INTEGER) AS overall_position,
  r.url, r.title, r.source, {S.iso_format('r.d')} AS date, {S.clean_snippet('r.content')} AS body
FROM res r JOIN sp USING (query, run) JOIN vd USING (query, run)
WHERE NOT vd.void AND (sp.stop IS NULL OR r.page < sp.stop)"""
register("s1_metasearch_ingest", S1_SQL)(s1_metasearch_ingest)


def _url_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries = page titles; strict mode on https pages; the language from the url path."""
    arts = pages_articles(spark, sf_dir).select(
        "ord", F.col("title").alias("query"), F.col("url").startswith("https:").alias("strict"),
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("hl"))
    return arts.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(2))))


def j5_f18_search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    fr = _url_frontier(spark, sf_dir)
    gl = F.upper(F.col("hl"))
    tp = F.when(F.col("page") == 1, F.lit("w"))
    return fr.select("ord", "page",
                     U.google_search_url("query", "hl", gl, "strict", page="page", time_period=tp).alias("web"),
                     U.google_news_url("query", "hl", gl, "strict", page="page", time_period=tp).alias("news"),
                     U.yandex_url("query", gl, "strict", page="page").alias("yandex"))


def _sql_strict(q: str, strict: str, news: bool) -> str:
    wrapped = f"'[' || {q} || ']'" if news else f"'\"' || {q} || '\"'"
    return f"(CASE WHEN NOT {strict} OR (starts_with({q}, '\"') AND ends_with({q}, '\"')) THEN {q} ELSE {wrapped} END)"


_REGIONS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in U.YANDEX_REGIONS.items())
_FR = f"""SELECT ord, title AS query, starts_with(url, 'https:') AS strict,
  regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1) AS hl, CAST(unnest(range(0, 3)) AS INTEGER) AS page FROM ({S.pages_articles_sql()})"""
_OFF = "(CASE WHEN page > 0 THEN '&start=' || CAST(page * 10 AS VARCHAR) ELSE '' END)"
_TP = "(CASE WHEN page = 1 THEN '&tbs=qdr:w' ELSE '' END)"
register("j5_f18_search_urls", f"""SELECT ord, page,
  'https://www.google.com/search?q=' || {S.quote_plus(_sql_strict('query', 'strict', False))} || '&hl=' || hl || '&gl=' || upper(hl)
    || {_OFF} || '&num=10' || {_TP} AS web,
  'https://www.google.com/search?q=' || {S.quote_plus(_sql_strict('query', 'strict', True))} || '&hl=' || hl || '&gl=' || upper(hl)
    || '&tbm=nws' || {_OFF} || {_TP} AS news,
  'https://yandex.ru/search/?text=' || {S.quote_plus(_sql_strict('query', 'strict', False))} || '&lr='
    || CAST(CASE upper(hl) {_REGIONS} ELSE {U.YANDEX_DEFAULT_REGION} END AS VARCHAR)
    || (CASE WHEN page > 0 THEN '&p=' || CAST(page AS VARCHAR) ELSE '' END) AS yandex
FROM ({_FR})""")(j5_f18_search_urls)


def f19_f20_query_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    arch = M.pages_serp_archive(spark, sf_dir, max_pages=MAX_PAGES)
    site = pages_articles(spark, sf_dir).select("ord", U.site_query(F.lit("новости"), F.col("source")).alias("q"))
    a = arch.select(F.concat_ws("|", "query", F.col("run").cast("string"), F.col("page").cast("string")).alias("k"), F.col("request_url").alias("v"))
    b = site.select(F.col("ord").cast("string").alias("k"), U.metasearch_url(
        F.lit("http://localhost:8080/"), F.col("q"), F.lit("ru"), F.lit(1)).alias("v"))
    return a.unionByName(b)


register("f19_f20_query_urls", f"""
SELECT query || '|' || CAST(run AS VARCHAR) || '|' || CAST(page AS VARCHAR) AS k,
  'http://localhost:8080/search?q=' || {S.quote_plus('query')} || '&format=json&categories=news&language=en&pageno=' || CAST(page AS VARCHAR) AS v
FROM (SELECT query, run, unnest(range(1, {MAX_PAGES + 1})) AS page FROM (
  SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1) AS query, page_id // {M.CALL_PAGE_IDS} AS run FROM pages) WHERE query <> '')
UNION ALL
SELECT CAST(ord AS VARCHAR) AS k, 'http://localhost:8080/search?q=' || {S.quote_plus("'новости site:' || source")}
  || '&format=json&categories=news&language=ru&pageno=1' AS v FROM ({S.pages_articles_sql()})""")(f19_f20_query_urls)


# --- S2 / S3: captured API responses -----------------------------------------------

from newsprism.sources import captures as CP  # noqa: E402

_CAP_SHAPE = "(page_id % 4)"
_CAP_SEL = f"""SELECT * FROM (SELECT page_id AS rid, page_id, url, {S.page_title('html')} AS title,
  {S.first_paragraph('html')} AS para,
  CASE WHEN page_id % 4 = 0 THEN 'https://www.google.com/complete/search?q=' || regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1)
       WHEN page_id % 4 = 1 THEN 'https://news.example.com/API/v2/items?page=' || CAST(page_id AS VARCHAR)
       WHEN page_id % 4 = 2 THEN 'https://www.example.com/_next/data/' || CAST(page_id AS VARCHAR) || '.json'
       ELSE 'https://cdn.example.com/static/app.js' END AS req,
  CASE WHEN page_id % 5 = 0 THEN 'text/html; charset=utf-8' WHEN page_id % 5 = 1 THEN 'application/javascript'
       ELSE 'application/json' END AS ctype,
  CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status FROM pages)
  WHERE status = 200 AND (contains(ctype, 'json') OR contains(ctype, 'javascript'))
    AND ({' OR '.join(f"contains(lower(req), {S.lit(p)})" for p in CP.API_PATTERNS)})"""


def s3_api_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = CP.pages_captures(spark, sf_dir)
    return cap.filter(CP.is_api_response(F.col("url"), F.col("status"), F.col("headers"))).select("rid", "url")


register("s3_api_selection", f"SELECT rid, req AS url FROM ({_CAP_SEL})")(s3_api_selection)


def s2_json_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = CP.harvest(CP.pages_captures(spark, sf_dir), F.to_timestamp(F.lit(FETCHED)))
    return rows.select("rid", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"),
                       "url", "title", "source", "body", "source_type")


_HOST = S.log_domain("url")
register("s2_json_harvest", f"""
SELECT rid, '' AS path, url, title, {_HOST} AS source, para AS body, 'api_interception' AS source_type
  FROM ({_CAP_SEL}) WHERE page_id % 4 = 0 AND length(title) > 5 AND starts_with(url, 'http')
UNION ALL
SELECT rid, '0.0' AS path, url, title, {_HOST} AS source, para AS body, 'api_interception' AS source_type
  FROM ({_CAP_SEL}) WHERE page_id % 4 = 1 AND length(title) > 5 AND starts_with(url, 'http')
UNION ALL
SELECT rid, '0.0.0.0.0' AS path, url, title, {_HOST} AS source, '' AS body, 'api_interception' AS source_type
  FROM ({_CAP_SEL}) WHERE page_id % 4 = 2 AND length(title) > 5 AND starts_with(url, 'http')""")(s2_json_harvest)


# --- S4-S8: archived HTML result pages ------------------------------------------------

from newsprism.sources import serp_html as SH  # noqa: E402


def s4_s8_html_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # parsed once, all engines in one pass; the narrow blocks are read by four rule sets
    parsed = SH.parse_pages(SH.pages_html_archive(spark, sf_dir, max_pages=MAX_PAGES)).checkpoint(eager=True)
    parts = [SH.block_articles(parsed, SH.RULE_SETS[e]) for e in SH.ENGINES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query", "source_type", "run", "page", "position", "overall_position", "url", "title", "source",
                      iso_format("date").alias("date"), "body")


_HRES = f"""SELECT * FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{{2}})/', 1) AS query,
  page_id // {SH.CALL_PAGE_IDS} AS run, CAST(page_id % {SH.CALL_PAGE_IDS} // {SH.PAGE_IDS} + 1 AS INTEGER) AS page, page_id AS pid, url,
  {S.page_title('html')} AS title, {S.source_domain_raw('url')} AS source, {_DATE} AS d, {_CONTENT} AS content,
  TIMESTAMP '{FETCHED}' + page_id * INTERVAL 0 HOUR AS fetched
  FROM pages) WHERE query <> ''"""
_SYS = " OR ".join(f"contains(lower(title), {S.lit(m)})" for m in SH.SYSTEM_MESSAGES)
_HROWS = f"""SELECT r.*, e.engine,
  row_number() OVER (PARTITION BY e.engine, r.query, r.run, r.page ORDER BY r.pid) AS rk,
  CASE WHEN e.engine = 'seleniumbase_cdp' THEN starts_with(r.url, 'http') AND r.title <> ''
       WHEN e.engine = 'google_search' THEN length(r.title) >= {SH.MIN_TITLE_LENGTH} AND NOT ({_SYS})
       ELSE length(r.title) >= {SH.MIN_TITLE_LENGTH} END AS keep
  FROM ({_HRES}) r JOIN (SELECT unnest([{', '.join(S.lit(e) for e in SH.ENGINES)}]) AS engine) e ON true"""
_HPG = f"""SELECT engine, query, run, page, count(*) FILTER (WHERE keep) AS n,
  engine <> 'seleniumbase_cdp' AND contains(arg_min(url, pid), '{SH.BLOCK_MARK}') AS blk FROM ({_HROWS}) GROUP BY 1, 2, 3, 4"""
_HFR = f"""SELECT engine, query, run, unnest(range(1, {MAX_PAGES + 1})) AS page FROM
  (SELECT DISTINCT query, run FROM ({_HRES})) q JOIN (SELECT unnest([{', '.join(S.lit(e) for e in SH.ENGINES)}]) AS engine) e ON true"""
HTML_SQL = f"""
WITH st AS (SELECT engine, query, run, page, coalesce(p.n, 0) AS n, coalesce(p.blk, false) AS blk
            FROM ({_HFR}) f LEFT JOIN ({_HPG}) p USING (engine, query, run, page)),
sp AS (SELECT engine, query, run, min(page) FILTER (WHERE NOT blk AND n = 0) AS stop FROM st GROUP BY 1, 2, 3),
vd AS (SELECT engine, query, run, bool_or(blk AND (sp.stop IS NULL OR st.page < sp.stop)) AS void
       FROM st JOIN sp USING (engine, query, run) GROUP BY 1, 2, 3),
k AS (SELECT h.* FROM ({_HROWS}) h JOIN sp USING (engine, query, run) JOIN vd USING (engine, query, run)
      WHERE h.keep AND NOT vd.void AND (sp.stop IS NULL OR h.page < sp.stop))
SELECT query, engine AS source_type, run, page,
  CAST(CASE WHEN engine = 'google_search' THEN rk + 1 ELSE rk END AS INTEGER) AS position,
  CAST(CASE WHEN engine = 'seleniumbase_cdp' THEN 0 ELSE row_number() OVER (PARTITION BY engine, query, run ORDER BY page, rk) END AS INTEGER) AS overall_position,
  url, title, source,
  {S.iso_format("CASE WHEN engine = 'seleniumbase_cdp' THEN TIMESTAMP '" + FETCHED + "' WHEN engine = 'google_news' THEN TIMESTAMP '" + M.BASE_TS + "' + pid * INTERVAL 1 HOUR ELSE d END")} AS date,
  CASE WHEN engine = 'seleniumbase_cdp' THEN {S.ustrip('content')} ELSE {S.clean_snippet('content')} END AS body
FROM k"""
register("s4_s8_html_results", HTML_SQL)(s4_s8_html_results)


# --- U1 + E4: merged sources through the whole run ----------------------------------------

from newsprism.operators import expand as EX  # noqa: E402
from newsprism.plans import pipeline as PL  # noqa: E402
from newsprism.sources.snapshots import pages_snapshots  # noqa: E402

E4_QUERY = "en"


def e4_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = {"json": M.pages_serp_archive(spark, sf_dir, max_pages=MAX_PAGES),
                "html": SH.pages_html_archive(spark, sf_dir, max_pages=MAX_PAGES,
                                              engines=["google_search", "google_news", "yandex"]),
                "snapshots": pages_snapshots(spark, sf_dir)}
    out = PL.collect_articles(archives, PL.RunConfig(query=E4_QUERY))
    return out.select("ord", "url", "title", "source_type", F.length("article_text").alias("text_chars"))


_E4_ROWS = f"""SELECT url, title, body, source_type,
  CAST(CASE source_type WHEN 'searxng' THEN 0 WHEN 'google_search' THEN 1 WHEN 'google_news' THEN 2 ELSE 3 END AS BIGINT)
    * 4294967296 + run * {EX.CALL_SPAN} + overall_position AS ord
FROM (SELECT query, 'searxng' AS source_type, run, url, title, body, overall_position FROM ({S1_SQL})
      UNION ALL SELECT query, source_type, run, url, title, body, overall_position FROM ({HTML_SQL})
      WHERE source_type IN ('google_search', 'google_news', 'yandex'))
WHERE query = '{E4_QUERY}'"""
_E4_KEYS = f"SELECT ord, {S.title_key('title')} AS tkey, {S.url_key('url')} AS ukey FROM ({_E4_ROWS})"
_E4_SNAP = f"""SELECT url, c, {S.main_region('c')} AS r FROM (
  SELECT url, {S.strip_noise('arg_max(html, page_id)')} AS c FROM pages GROUP BY url)"""
register("e4_pipeline", f"""SELECT a.ord, a.url, a.title, a.source_type,
  CAST(length(CASE WHEN p.url IS NULL THEN '' ELSE {S.cascade('p.c', 'p.r')} END) AS INTEGER) AS text_chars
FROM ({_E4_ROWS}) a LEFT JOIN ({_E4_SNAP}) p ON a.url = p.url
WHERE a.ord IN ({S.greedy_dedup_sql(_E4_KEYS)})""")(e4_pipeline)
