import datetime as dt
import json

from pyspark.sql import functions as F

from newsprism.functions import urls as U
from newsprism.operators import fetchlog as FL
from newsprism.plans import pipeline as PL
from newsprism.sources import metasearch as M
from newsprism.sources import serp_html as SH
from newsprism.sources import snapshots as SN
from newsprism.streaming import jobs as J

FETCHED = dt.datetime(2024, 1, 20)

PAGE1 = [
    {"url": "https://example.com/article1", "title": "First Article", "content": "Snippet of the first article.",
     "publishedDate": "2024-01-15T10:30:00Z", "engine": "google", "category": "news"},
    {"url": "https://ria.ru/20240115/something.html", "title": "Second Article",
     "content": "Snippet of the second article.", "publishedDate": "Jan 15, 2024", "engine": "bing", "category": "news"},
]
PAGE2 = [{"url": "https://tass.ru/article3", "title": "Third Article", "content": "Third snippet.",
          "publishedDate": "2024-01-14", "engine": "duckduckgo", "category": "news"}]


def payload(results):
    return json.dumps({"query": "test", "results": results, "number_of_results": 100})


def archive(spark, pages, query="test"):
    rows = [(query, "searxng", p, status, body, FETCHED) for p, status, body in pages]
    return spark.createDataFrame(rows, "query string, engine string, page int, status int, body string, fetched_at timestamp")


def test_metasearch_pages(spark):
    arts = M.ingest(archive(spark, [(1, 200, payload(PAGE1)), (2, 200, payload(PAGE2)), (3, 200, payload([])),
                                    (4, 200, payload(PAGE1))])).orderBy("overall_position").collect()
    assert [(a.title, a.page, a.position, a.overall_position) for a in arts] == [
        ("First Article", 1, 1, 1), ("Second Article", 1, 2, 2), ("Third Article", 2, 1, 3)]
    assert arts[0].source == "example.com" and arts[1].source == "ria.ru"
    assert arts[0].body == "Snippet of the first article." and arts[0].source_type == "searxng"
    assert arts[0].date == dt.datetime(2024, 1, 15, 10, 30) and arts[1].date == dt.datetime(2024, 1, 15)
    assert arts[2].date == dt.datetime(2024, 1, 14)


def test_metasearch_failures_void_the_source(spark):
    assert M.ingest(archive(spark, [(1, 200, payload(PAGE1)), (2, 503, "")])).count() == 0
    assert M.ingest(archive(spark, [(1, 200, payload(PAGE1)), (2, 200, "not json")])).count() == 0
    # a failure after the empty page that stopped paging is never reached
    assert M.ingest(archive(spark, [(1, 200, payload(PAGE1)), (2, 200, payload([])), (3, 500, "")])).count() == 2


def test_frontier_and_metasearch_url(spark):
    q = spark.createDataFrame([("AI news",)], "query string")
    fr = M.frontier(q, ["searxng", "web"], 3)
    assert fr.count() == 6
    u = fr.select(U.metasearch_url(F.lit("http://localhost:8080/"), F.col("query"), F.lit("en"), F.col("page")).alias("u"))
    first = sorted(r.u for r in u.collect())[0]
    assert first.startswith("http://localhost:8080/search?q=AI+news") and "language=en" in first


def test_url_builder_literals(spark):
    df = spark.createDataFrame([("test", 0, None, "RU"), ("test", 2, "d", "US"), ("AI news", 3, None, "XX")],
                               "q string, page int, tp string, gl string")
    rows = df.select(U.google_search_url("q", F.lit("ru"), "gl", F.lit(False), page="page", time_period="tp").alias("g"),
                     U.google_news_url("q", F.lit("ru"), "gl", F.lit(False), page="page").alias("n"),
                     U.yandex_url("q", "gl", F.lit(False), page="page").alias("y"),
                     U.site_query(F.lit(""), F.lit("example.com")).alias("s")).collect()
    assert "start=" not in rows[0].g and "tbs=" not in rows[0].g and rows[0].g.endswith("&num=10")
    assert "start=20" in rows[1].g and rows[1].g.endswith("&tbs=qdr:d")
    assert "start=30" in rows[2].n and "tbm=nws" in rows[2].n
    assert rows[0].y == "https://yandex.ru/search/?text=test&lr=213"
    assert rows[1].y.endswith("&lr=84&p=2") and rows[2].y.endswith("&lr=213&p=3")
    assert rows[0].s == " site:example.com"
    strict = spark.createDataFrame([('"already"',), ("plain",)], "q string").select(
        U.strict_query("q", F.lit(True)).alias("w"), U.strict_query("q", F.lit(True), news_tab=True).alias("n")).collect()
    assert [(r.w, r.n) for r in strict] == [('"already"', '"already"'), ('"plain"', "[plain]")]


def _html_arch(spark, engine, pages):
    rows = [("q", engine, i + 1, h, "https://www.google.com/search", FETCHED) for i, h in enumerate(pages)]
    return spark.createDataFrame(rows, "query string, engine string, page int, html string, final_url string, fetched_at timestamp")


def test_news_rules(spark):
    block = ('<div class="SoaBEf"><a href="https://lenta.ru/news/2024/01/15/x/"><div role="heading">'
             'Headline from the news tab</div></a><span class="OSrXXb"><time datetime="2024-01-15T08:00:00Z">'
             '2 часа назад</time></span><div class="GI74Re">15 янв. 2024 г. — Тело</div></div>')
    nosrc = ('<div class="SoaBEf"><a href="https://xn--e1afmkfd.xn--p1ai/a"><h3>Second headline here</h3></a>'
             '<span class="WG9SHc">3 hours ago</span></div>')
    arts = SH.to_articles(_html_arch(spark, "google_news", ["<html><body>" + block + nosrc + "</body></html>"]), SH.NEWS)
    rows = arts.orderBy("position").collect()
    assert rows[0].date == dt.datetime(2024, 1, 15, 8) and rows[0].body == "Тело" and rows[0].source == "lenta.ru"
    assert rows[1].source == "xn--e1afmkfd.xn--p1ai" and rows[1].date == FETCHED - dt.timedelta(hours=3)
    assert rows[0].source_from_url and rows[1].source_from_url  # no source element: taken from the url


def test_yandex_rules_and_captcha(spark):
    ok = ('<li class="serp-item"><h2><a href="https://ria.ru/1">Заголовок новости дня</a></h2>'
          '<div class="Path">РИА Новости</div><div class="OrganicText">Текст</div></li>')
    internal = '<li class="serp-item"><h2><a href="https://yandex.ru/q">Внутренняя ссылка Яндекса</a></h2></li>'
    arts = SH.to_articles(_html_arch(spark, "yandex", ["<html><body>" + ok + internal + "</body></html>"]), SH.YANDEX)
    assert [(r.url, r.source, r.body) for r in arts.collect()] == [("https://ria.ru/1", "РИА Новости", "Текст")]
    cap = '<html><body><div class="CheckboxCaptcha"></div>' + ok + "</body></html>"
    assert SH.to_articles(_html_arch(spark, "yandex", [cap]), SH.YANDEX).count() == 0


def test_minimal_rules(spark):
    page = ('<div class="g"><h3>Tiny</h3><a href="https://a.ru/x">x</a><div class="VwiC3b">  raw snippet </div></div>'
            '<div class="g"><a href="/relative">y</a><h3>Relative link title</h3></div>')
    rows = SH.to_articles(_html_arch(spark, "seleniumbase_cdp", [page]), SH.MINIMAL).collect()
    assert [(r.title, r.body, r.overall_position) for r in rows] == [("Tiny", "raw snippet", 0)]


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=7 * i), i * 10 + j, (i * 7 + j) % 3 == 0)
            for i in range(30) for j, k in enumerate(["a", "b", "c"])]
    log = spark.createDataFrame(rows, "key string, ts timestamp, seq bigint, ok boolean")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = {r.seq: r.level for r in J.failure_state(stream, spark, str(tmp_path / "levels")).collect()}
    want = {r.seq: r.level for r in FL.failure_levels(log).collect()}
    assert got == want
    snaps = spark.createDataFrame([("u1", "a", 200, t0, 24, 1), ("u1", "b", 200, t0 + dt.timedelta(hours=1), 24, 2),
                                   ("u2", "c", 403, t0, 24, 3)], "url string, response_body string, status_code int, "
                                  "fetched_at timestamp, ttl_hours int, seq bigint")
    snaps.write.parquet(str(tmp_path / "snaps"))
    sstream = spark.readStream.schema(snaps.schema).parquet(str(tmp_path / "snaps"))
    store = J.run_upsert(sstream, spark)
    assert sorted((r.url, r.response_body) for r in store.collect()) == [("u1", "b")]
    fresh = J.fresh_arrivals(sstream.selectExpr("url AS key", "fetched_at AS ts", "seq"), spark, str(tmp_path / "fresh"))
    assert sorted(r.key for r in fresh.collect()) == ["u1", "u2"]
    assert sorted(tuple(r) for r in SN.upsert(snaps.limit(0), snaps).select("url", "seq").collect()) == [("u1", 2)]


def test_pipeline_merge_dedup_relevance(spark):
    js = archive(spark, [(1, 200, payload(PAGE1 + [dict(PAGE2[0], title="first article")])), (2, 200, payload([]))],
                 query="article")
    web = ('<html><body><div class="g"><a href="https://example.com/article1/"><h3>Other title, same url</h3></a></div>'
           '<div class="g"><a href="https://new.ru/a"><h3>Article about something</h3></a></div></body></html>')
    html = _html_arch(spark, "google_search", [web, "<html><body></body></html>"]).withColumn("query", F.lit("article"))
    out = PL.collect_articles({"json": js, "html": html}, PL.RunConfig(query="article"))
    rows = out.orderBy("ord").collect()
    assert [(r.url, r.source_type) for r in rows] == [
        ("https://example.com/article1", "searxng"), ("https://ria.ru/20240115/something.html", "searxng"),
        ("https://new.ru/a", "google_search")]


def test_pipeline_decodes_url_sources(spark):
    js = archive(spark, [(1, 200, payload([{"url": "https://xn--e1afmkfd.xn--p1ai/1", "title": "Пример новости"}]))],
                 query="пример")
    out = PL.collect_articles({"json": js}, PL.RunConfig(query="пример"))
    assert [r.source for r in out.collect()] == ["пример.рф"]


def test_pipeline_counters(spark):
    js = archive(spark, [(1, 200, payload(PAGE1 + [dict(PAGE2[0], title="first article")])), (2, 200, payload([]))],
                 query="article")
    snaps = spark.createDataFrame([("https://example.com/article1", "<article><p>" + "text " * 20 + "</p></article>", 200)],
                                  "url string, response_body string, status_code int")
    counters = {}
    out = PL.collect_articles({"json": js, "snapshots": snaps}, PL.RunConfig(query="article"), counters=counters)
    assert out.count() == 2   # the third result repeats the first one's title key
    assert counters["final"].get == {"rows": 2, "with_text": 1}
    assert counters["found"].get["rows"] == 3 and counters["unique"].get["rows"] == 2
    assert counters["relevant"].get["rows"] == 2
