"""More registered queries: single extractors, flags, filters, text fill, counters, dates, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions import flags as FG
from newsprism.functions.dates import iso_format, parse_date
from newsprism.functions.urls import decode_idn, honeypot_flag, source_domain_raw
from newsprism.operators import extract as X
from newsprism.operators import select as SEL
from newsprism.operators.dedup import dedup_articles
from newsprism.plans import sqlgen as S
from newsprism.plans.articles import pages_articles
from newsprism.plans.catalog import register
from newsprism.plans.queries_core import ART, CLEAN_PAGES, FLAGSHIP_QUERY, KEPT, _sql_terms_hits
from newsprism.sinks.files import output_stem_col
from newsprism.sources.snapshots import pages_snapshots
from newsprism.sources.tables import read_table, spread

AS_OF = "2024-02-01 00:00:00"


# --- X3-X6: every extractor on every page --------------------------------------------

def x3_x6_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.with_clean_html(read_table(spark, sf_dir, "pages"))
    c, r = F.col("_clean"), F.col("_region")
    return p.select("page_id", *[fn(c, r).alias(name) for name, fn in X.DEFAULT_EXTRACTORS])


register("x3_x6_extractors", f"SELECT page_id, " + ", ".join(
    f"{fn('c', 'r')} AS {name}" for name, fn in S.SQL_EXTRACTORS) + f" FROM ({CLEAN_PAGES})")(x3_x6_extractors)


# --- F11: fetch responses ---------------------------------------------------------

def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetch responses: a 403 for spam-farm hosts, JSON content type for the ``/es/`` pages."""
    p = read_table(spark, sf_dir, "pages")
    status = F.when(F.contains("url", F.lit("spam-farm")), F.lit(403)).otherwise(F.lit(200))
    ctype = F.when(F.contains("url", F.lit("/es/")), F.lit("Application/JSON")).otherwise(F.lit("text/html"))
    key = F.when(F.contains("url", F.lit("/fr/")), F.lit("Content-Type")).otherwise(F.lit("content-type"))
    return p.select("page_id", status.alias("status"), F.col("html").alias("text"), F.create_map(key, ctype).alias("headers"))


def f11_block_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _responses(spark, sf_dir)
    return r.select("page_id", FG.looks_blocked("text", "headers").alias("looks_blocked"),
                    FG.fetch_blocked("status", "text", "headers").alias("blocked"))


_IND = " OR ".join(f"contains(lower(html), {S.lit(p.lower())})" for p in FG.BLOCKED_INDICATORS)
_LB = f"(html <> '' AND NOT contains(url, '/es/') AND ({_IND}))"
register("f11_block_flag", f"""SELECT page_id, {_LB} AS looks_blocked,
  (contains(url, 'spam-farm') OR {_LB}) AS blocked FROM pages""")(f11_block_flag)


# --- F22: honeypot flag over the links of every page ----------------------------------

HREF_RE = r"""(?i)<a\b[^>]*href="([^"]*)\""""


def f22_honeypot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    origin = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    links = p.select("page_id", origin.alias("o"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF_RE), 1)).alias("i", "href"))
    url = F.concat("o", F.lit("/cdn-cgi/l"), "href")
    url = F.when(F.col("i") == 0, url).otherwise(F.concat("o", F.lit("/a/b/c"), "href"))
    rel = F.when(F.pmod(F.col("page_id") + F.col("i"), F.lit(2)) == 0, F.lit("nofollow")).otherwise(F.lit(""))
    out = links.select("page_id", "i", url.alias("link"), rel.alias("rel"))
    return out.withColumn("honeypot", honeypot_flag("link", "rel"))


_LINKS = f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS i, CASE WHEN i = 1 THEN o || '/cdn-cgi/l' || href ELSE o || '/a/b/c' || href END AS link,
  CASE WHEN (page_id + i - 1) % 2 = 0 THEN 'nofollow' ELSE '' END AS rel FROM (
  SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS o,
    unnest(regexp_extract_all(html, {S.lit(HREF_RE)}, 1)) AS href,
    generate_subscripts(regexp_extract_all(html, {S.lit(HREF_RE)}, 1), 1) AS i FROM pages)"""
_PARTS = "string_split(regexp_replace(link, '/+$', ''), '/')"
_ODD = (f"len(list_filter({_PARTS}[-3:], lambda s: length(s) > 20 OR (s <> '' AND NOT regexp_matches(s, '^\\p{{L}}'))))")
register("f22_honeypot_links", f"""SELECT page_id, i, link, rel,
  (contains(lower(rel), 'nofollow') AND len({_PARTS}) > 5 AND {_ODD} >= 2)
  OR contains(lower(link), '/cdn-cgi/') OR contains(lower(link), 'challenge-platform') OR contains(lower(link), '__cf_chl_') AS honeypot
FROM ({_LINKS})""")(f22_honeypot_links)


# --- P5-P8 ------------------------------------------------------------------------

def p5_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.filter_sources(pages_articles(spark, sf_dir), ["google_search"]).select("ord", "url")


register("p5_source_filter", f"SELECT ord, url FROM ({ART}) WHERE source_type IN ('google_search')")(p5_source_filter)


def _doc_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    date = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(AS_OF))) - F.col("doc_id") * F.lit(600_000_000))
    return d.select(F.col("doc_id").alias("ord"),
                    F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
                    F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                    F.col("source"), date.alias("date"), F.col("text").alias("body"),
                    F.col("text").alias("article_text"), F.col("lang").alias("source_type"))


_DOCS = f"""SELECT doc_id AS ord, 'https://' || source || '.example.org/doc/' || CAST(doc_id AS VARCHAR) AS url,
  split_part(text, chr(10), 1) AS title, source,
  TIMESTAMP '{AS_OF}' - doc_id * INTERVAL 10 MINUTE AS date, text AS body,
  text AS article_text, lang AS source_type FROM documents"""
PHRASE = '"que de"'


def p6_exact_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.exact_phrase(_doc_articles(spark, sf_dir), PHRASE).select("ord", "title")


register("p6_exact_phrase", f"""SELECT ord, title FROM ({_DOCS})
WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(body, '')), 'que de')""")(p6_exact_phrase)


def p7_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEL.recent(_doc_articles(spark, sf_dir), "d", F.to_timestamp(F.lit(AS_OF))).select("ord", iso_format("date").alias("date"))


register("p7_recency", f"""SELECT ord, {S.iso_format('date')} AS date FROM ({_DOCS})
WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""")(p7_recency)


def p8_x2_fill_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = pages_articles(spark, sf_dir)
    # articles of the metasearch source arrive with their snippet as text already
    arts = arts.withColumn("article_text", F.when(F.col("source_type") == "searxng", F.col("body")).otherwise(F.lit("")))
    return X.fill_article_text(arts, pages_snapshots(spark, sf_dir)).select("ord", "url", "article_text")


register("p8_x2_fill_text", f"""SELECT a.ord, a.url,
  CASE WHEN a.source_type = 'searxng' THEN a.body ELSE coalesce({S.cascade('p.c', 'p.r')}, '') END AS article_text
FROM ({ART}) a LEFT JOIN (SELECT url, c, {S.main_region('c')} AS r FROM (
  SELECT url, {S.strip_noise('arg_max(html, page_id)')} AS c FROM pages GROUP BY url)) p
  ON a.url = p.url AND a.source_type <> 'searxng'""")(p8_x2_fill_text)


# --- A3 run counters -------------------------------------------------------------

def a3_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = pages_articles(spark, sf_dir, materialize=True)
    kept = dedup_articles(arts)
    filled = X.fill_article_text(SEL.filter_relevant(kept, FLAGSHIP_QUERY), pages_snapshots(spark, sf_dir))
    # one row per article with how far it came, one aggregate
    far = kept.select("ord", F.lit(True).alias("u")).join(
        filled.select("ord", F.lit(True).alias("r"), (F.col("article_text") != "").alias("t")), "ord", "left")
    return arts.select("ord", "source_type").join(far, "ord", "left").groupBy("source_type").agg(
        F.count(F.lit(1)).alias("n_found"), F.count_if("u").alias("n_unique"), F.count_if("r").alias("n_relevant"),
        F.count_if("t").alias("n_with_text"))


_REL = f"SELECT * FROM ({ART}) WHERE ord IN ({KEPT}) AND {_sql_terms_hits(SEL.query_terms(FLAGSHIP_QUERY))} >= 1"
register("a3_run_counters", f"""
WITH a AS ({ART}), k AS (SELECT * FROM a WHERE ord IN ({KEPT})), r AS ({_REL}),
t AS (SELECT r.source_type FROM r JOIN (SELECT url, c, {S.main_region('c')} AS rr FROM (
        SELECT url, {S.strip_noise('arg_max(html, page_id)')} AS c FROM pages GROUP BY url)) p
      ON r.url = p.url WHERE {S.cascade('p.c', 'p.rr')} <> '')
SELECT source_type, CAST(sum(f) AS BIGINT) AS n_found, CAST(sum(u) AS BIGINT) AS n_unique,
  CAST(sum(rl) AS BIGINT) AS n_relevant, CAST(sum(w) AS BIGINT) AS n_with_text FROM (
  SELECT source_type, 1 AS f, 0 AS u, 0 AS rl, 0 AS w FROM a UNION ALL SELECT source_type, 0, 1, 0, 0 FROM k
  UNION ALL SELECT source_type, 0, 0, 1, 0 FROM r UNION ALL SELECT source_type, 0, 0, 0, 1 FROM t) GROUP BY source_type""")(
    a3_run_counters)


# --- F8-F10 on strings made from orders and events ------------------------------------

def f8_f10_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.pmod(F.col("o_orderkey"), F.lit(5))
    d = F.col("o_orderdate")
    s = (F.when(k == 0, F.date_format(d, "MMM d, yyyy")).when(k == 1, F.date_format(d, "d.M.yyyy"))
         .when(k == 2, F.date_format(d, "yyyy/MM/dd")).when(k == 3, F.date_format(d, "d MMMM yyyy"))
         .otherwise(F.concat(F.pmod(F.col("o_custkey"), F.lit(30)).cast("string"), F.lit(" дней назад"))))
    e = read_table(spark, sf_dir, "events")
    rel = F.concat(F.pmod(F.col("user_id"), F.lit(24)).cast("string"),
                   F.when(F.col("event_type") == "error", F.lit(" часа назад")).otherwise(F.lit(" minutes ago")))
    strings = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("k"), s.alias("s")).unionByName(
        e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("k"), rel.alias("s")))
    return spread(strings, "k").select("k", "s", iso_format(parse_date(F.col("s"), F.to_timestamp(F.lit(AS_OF)))).alias("date"))


_ASOF = f"TIMESTAMP '{AS_OF}'"
register("f8_f10_dates", f"""
SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS k,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 1 THEN strftime(o_orderdate, '%-d.%-m.%Y')
    WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN strftime(o_orderdate, '%-d %B %Y')
    ELSE CAST(o_custkey % 30 AS VARCHAR) || ' дней назад' END AS s,
  {S.iso_format(f"CASE WHEN o_orderkey % 5 = 4 THEN {_ASOF} - (o_custkey % 30) * INTERVAL 1 DAY ELSE date_trunc('day', o_orderdate) END")} AS date
FROM orders
UNION ALL
SELECT 'e' || CAST(event_id AS VARCHAR) AS k,
  CAST(user_id % 24 AS VARCHAR) || CASE WHEN event_type = 'error' THEN ' часа назад' ELSE ' minutes ago' END AS s,
  {S.iso_format(f"{_ASOF} - (user_id % 24) * CASE WHEN event_type = 'error' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 MINUTE END")} AS date
FROM events""")(f8_f10_dates)


# --- F14/F15 markdown sections, S16 run names -----------------------------------------

MAX_CHARS = 300


def f14_f15_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _doc_articles(spark, sf_dir)
    d = d.withColumn("body", F.when(F.col("source_type") == "en", F.lit("")).otherwise(F.col("body")))
    return d.select("ord", FG.markdown_section(max_chars=MAX_CHARS).alias("md"))


_BODY = "(CASE WHEN source_type = 'en' THEN '' ELSE body END)"
register("f14_f15_markdown", f"""SELECT ord, '# ' || title || chr(10) || chr(10) || '- **Source:** ' || source
  || chr(10) || '- **URL:** ' || url || chr(10) || '- **Date:** ' || {S.iso_format('date')}
  || CASE WHEN {_BODY} <> '' THEN chr(10) || '- **Snippet:** ' || {_BODY} ELSE '' END
  || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || CASE WHEN length(article_text) > {MAX_CHARS} THEN substring(article_text, 1, {MAX_CHARS}) || chr(10) || chr(10) || '[truncated]'
          ELSE article_text END AS md
FROM ({_DOCS})""")(f14_f15_markdown)


def s16_output_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pages_articles(spark, sf_dir)
    tp = F.when(F.col("source_type") == "searxng", F.lit("w"))
    return a.select("ord", output_stem_col(F.col("title"), F.lit(3), tp, F.to_timestamp(F.lit("2024-03-20 14:30:22"))).alias("stem"))


register("s16_output_stem", f"""SELECT ord, substring(replace(title, ' ', '_'), 1, 50)
  || CASE WHEN source_type = 'searxng' THEN '_w' ELSE '' END || '_3pages_20240320_143022' AS stem FROM ({ART})""")(s16_output_stem)


# --- F4: IDN hosts -----------------------------------------------------------------------

# Hosts and what they stand for; the last two have a label that is no valid punycode.
IDN_HOSTS = (
    ("xn--e1afmkfd.xn--p1ai", "пример.рф"),
    ("xn--80ak6aa92e.com", "аррӏе.com"),
    ("www.xn--mnchen-3ya.de", "www.münchen.de"),
    ("xn--bcher-kva.example", "bücher.example"),
    ("plain.example.org", "plain.example.org"),
    ("news.xn--j1amh", "news.укр"),
    ("xn--a.example", "xn--a.example"),
    ("a.xn--999999999.com", "a.xn--999999999.com"),
)


def f4_idn_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the hosts per page, by its id."""
    host = F.array(*[F.lit(h) for h, _ in IDN_HOSTS])[F.pmod(F.col("page_id"), F.lit(len(IDN_HOSTS))).cast("int")]
    pages = read_table(spark, sf_dir, "pages").select("page_id", source_domain_raw(F.concat(F.lit("https://"), host, F.lit("/x"))).alias("source"))
    return decode_idn(pages, "source")


register("f4_idn_decode", f"""SELECT page_id, h.shown AS source FROM pages JOIN (VALUES
  {", ".join(f"({i}, {S.lit(shown)})" for i, (_, shown) in enumerate(IDN_HOSTS))}) h(k, shown) ON page_id % {len(IDN_HOSTS)} = h.k""")(f4_idn_decode)
