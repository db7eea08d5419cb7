"""Search calls that grow with the archive, duplicates that must not multiply rows, greedy dedup
without any size switch, streams cut into batches, header rules, documents and run options."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from newsprism.functions import urls as U
from newsprism.operators import dedup as D
from newsprism.operators import expand as EX
from newsprism.operators import extract as X
from newsprism.plans import pipeline as PL
from newsprism.sinks import files as SK
from newsprism.sources import metasearch as M
from newsprism.sources import outlets as O
from newsprism.sources import serp_html as SH
from newsprism.plans import queries_streaming
from newsprism.streaming import jobs as J

FETCHED = dt.datetime(2024, 1, 20)


def sequential(rows):
    tk, uk, kept = set(), set(), set()
    for o, t, u in sorted(rows):
        if t not in tk and u not in uk:
            tk.add(t)
            uk.add(u)
            kept.add(o)
    return kept


def greedy(spark, rows):
    df = spark.createDataFrame(rows, "ord bigint, tkey string, ukey string")
    return {r.ord for r in D.first_wins_multi_key(df, "ord", ["tkey", "ukey"]).collect()}


def test_greedy_chain_and_hot_key(spark):
    chain = [(i, f"t{i // 2}", f"u{(i + 1) // 2}") for i in range(24)]
    assert greedy(spark, chain) == sequential(chain)
    rnd = random.Random(7)
    hot = [(i, "" if i % 3 == 0 else f"t{rnd.randrange(4000)}", f"u{rnd.randrange(9000)}") for i in range(20_000)]
    assert greedy(spark, hot) == sequential(hot)
    assert greedy(spark, []) == set()


def test_hot_key_of_a_third_of_a_million_rows(spark):
    """A key that a third of 1e6 rows share: only its first row survives, the others keep their own."""
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("tkey"),
                               F.concat(F.lit("u"), F.col("id")).alias("ukey"))
    kept = D.first_wins_multi_key(df, "ord", ["tkey", "ukey"])
    assert kept.count() == n - (n + 2) // 3 + 1


def archive_pages(spark, n):
    """Two languages, n pages, as the given table has them."""
    return spark.range(n).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 7, F.lit(".example.org/"), F.when(F.col("id") % 2 == 0, "en").otherwise("de"),
                                               F.lit("/"), F.col("id")).alias("url"),
        F.concat(F.lit("<html><head><title>Title number "), F.col("id"), F.lit(" of the archive</title></head><body><p>"),
                 F.repeat(F.lit("word "), 80), F.lit("</p></body></html>")).alias("html"))


def test_search_calls_grow_with_the_archive(spark, tmp_path):
    counts = []
    for n in (400, 2000):
        d = tmp_path / str(n)
        archive_pages(spark, n).coalesce(1).write.parquet(str(d / "pages.parquet"))
        rows = M.ingest(M.pages_serp_archive(spark, str(d)))
        top = rows.agg(F.count("*").alias("n"), F.max("overall_position").alias("top"), F.count_distinct("run").alias("runs"), F.max(F.length("body")).alias("body")).first()
        assert top.runs == n // 400 and top.top <= 400 and top.body > 390  # whole snippets
        counts.append(top.n)
        html = SH.to_articles(SH.pages_html_archive(spark, str(d), engines=["google_news"]), SH.NEWS)
        assert html.count() == n
    assert counts == [400, 2000]


def test_archived_page_twice_does_not_multiply(spark):
    page = '<html><body><div class="SoaBEf"><a href="https://lenta.ru/1"><div role="heading">Headline of the news tab</div></a></div></body></html>'
    rows = [("q", "google_news", 1, page, "https://www.google.com/search", FETCHED)] * 2
    arch = spark.createDataFrame(rows, "query string, engine string, page int, html string, final_url string, fetched_at timestamp")
    assert SH.to_articles(arch, SH.NEWS).count() == 2  # a row per archived block, none crosswise
    runs = arch.withColumn("run", F.monotonically_increasing_id())
    got = SH.to_articles(runs, SH.NEWS).collect()
    assert [r.overall_position for r in got] == [1, 1] and len({r.run for r in got}) == 2


def test_fill_text_takes_the_latest_snapshot_once(spark):
    page = lambda w: f"<html><body><article><p>{(w + ' ') * 30}</p></article></body></html>"
    arts = spark.createDataFrame([(0, "https://a/1", ""), (1, "https://a/1", "kept"), (2, "https://a/2", None)], "ord bigint, url string, article_text string")
    snaps = spark.createDataFrame([("https://a/1", page("old"), 200, FETCHED, 1), ("https://a/1", page("new"), 200, FETCHED + dt.timedelta(hours=1), 2),
                                   ("https://a/1", page("bad"), 500, FETCHED + dt.timedelta(hours=2), 3)],
                                  "url string, response_body string, status_code int, fetched_at timestamp, seq bigint")
    out = {r.ord: r.article_text for r in X.fill_article_text(arts, snaps).collect()}
    assert len(out) == 3 and out[0].startswith("new new") and out[1] == "kept" and out[2] == ""


@pytest.mark.parametrize(("columns", "want"), [
    (["URL статьи", "x", "Заметность"], ("URL статьи", "Заметность")),
    (["источник", "URL статьи ", "заметность"], ("URL статьи ", "заметность")),
    (["url", "source", "Visibility"], ("url", "Visibility")),
    (["заметность", "b", "url"], ("url", "заметность")),
    (["a", "b", "c"], ("a", "c")), (["a", "b"], ("a", "b")), (["a"], None), ([], None),
])
def test_outlet_header_rules(columns, want):
    assert O.resolve_outlet_columns(columns) == want


def test_outlet_file(spark, tmp_path):
    assert O.read_outlets(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "list.csv").write_text("source,name,visibility\nhttps://a.ru/,A,3.5\nb.ru,B,n/a\n,C,1\n", encoding="utf-8")
    assert [tuple(r) for r in O.read_outlets(spark, str(tmp_path / "list.csv")).collect()] == [("https://a.ru/", 3.5)]


def test_idn_labels(spark):
    rows = [("xn--e1afmkfd.xn--p1ai",), ("www.xn--mnchen-3ya.de",), ("xn--a.example",), ("axn--e1afmkfd.ru",), (None,), ("plain.ru",), ("plain.ru",)]
    got = U.decode_idn(spark.createDataFrame(rows, "source string"), "source").collect()
    assert sorted(str(r.source) for r in got) == sorted(["пример.рф", "www.münchen.de", "xn--a.example", "axn--e1afmkfd.ru", "None", "plain.ru", "plain.ru"])


def arrivals(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = sorted((t0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 9)), f"u{rnd.randrange(12)}") for _ in range(600))
    return spark.createDataFrame([(u, t, i) for i, (t, u) in enumerate(rows)], "url string, fetched_at timestamp, seq bigint"), rows


def test_fresh_arrivals_do_not_depend_on_batches(spark, tmp_path):
    df, rows = arrivals(spark)
    want, last = [], {}
    for i, (t, u) in enumerate(rows):
        if u not in last or t > last[u] + dt.timedelta(hours=24):
            last[u] = t
            want.append(i)
    for cuts in (1, 6):
        path = str(tmp_path / f"a{cuts}")
        for c in range(cuts):
            df.where(F.floor(F.col("seq") * cuts / 600) == c).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = J.fresh_arrivals(stream.selectExpr("url AS key", "fetched_at AS ts", "seq"), spark, str(tmp_path / f"fresh{cuts}"))
        assert sorted(r.seq for r in got.collect()) == want


def test_streams_over_many_files_of_any_time(spark, tmp_path):
    """More part files than a batch takes, each spanning the whole time."""
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 9)), rnd.randrange(12), rnd.choice(["error", "error", "click"]), 1.0, "p") for i in range(700)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.repartition(70, "event_id").write.option("maxRecordsPerFile", 10).parquet(str(tmp_path / "many/events.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "one/events.parquet"))
    assert len(spark.read.parquet(str(tmp_path / "many/events.parquet")).inputFiles()) > 64
    levels, fresh, last, level = [], set(), {}, {}
    for i, t, u, kind, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        level[u] = level.get(u, 0) + 1 if kind == "error" else 0
        levels.append((str(u), i, kind != "error", level[u]))
        if u not in last or t > last[u] + dt.timedelta(hours=24):
            last[u] = t
            fresh.add((u, t.strftime("%Y-%m-%d %H:%M:%S.%f")))
    for d in ("one", "many"):
        assert sorted(tuple(r) for r in queries_streaming.st2_failure_state(spark, str(tmp_path / d)).collect()) == sorted(levels)
        got = queries_streaming.st1_fresh_arrivals(spark, str(tmp_path / d)).collect()
        assert sorted((int(r.url.split(".")[0][len("https://u"):]), r.fetched_at) for r in got) == sorted(fresh)


def test_upsert_in_batches_rewrites_touched_buckets_only(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"u{i % 40}", f"body{i}", 200 if i % 7 else 403, t0 + dt.timedelta(minutes=i), 24, i) for i in range(200)]
    df = spark.createDataFrame(rows, "url string, response_body string, status_code int, fetched_at timestamp, ttl_hours int, seq bigint")
    path = str(tmp_path / "s")
    for c in range(5):
        df.where(F.floor(F.col("seq") / 40) == c).coalesce(1).write.mode("append").parquet(path)
    first = spark.createDataFrame([("old", "x", 200, t0, 24, 0), ("u1", "older", 200, t0 - dt.timedelta(days=1), 24, 0)], df.schema)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.url: r.response_body for r in J.run_upsert(stream, spark, first, buckets=8).collect()}
    want = {"old": "x"} | {u: b for u, b, s, *_ in rows if s == 200}
    assert got == want


def articles(spark):
    return spark.createDataFrame([("https://b/2", 'Say "hi", ok', "b", FETCHED, "", "text\nline", "yandex", 1, 2, 2, 7), ("https://a/1", "Новость", "a", FETCHED, "s", "", "searxng", 1, 1, 1, 3)],
                                 "url string, title string, source string, date timestamp, body string, article_text string, source_type string, page int, position int, overall_position int, ord bigint")


def test_documents_of_small_results(spark, tmp_path):
    import csv
    import io
    import json
    read = lambda p: "".join(open(os.path.join(p, f), encoding="utf-8", newline="").read() for f in sorted(os.listdir(p)) if f.startswith("part-"))
    text = read(SK.write_document(articles(spark), str(tmp_path / "a.csv"), "csv"))
    assert text.startswith("﻿url,title,")
    rows = list(csv.DictReader(io.StringIO(text[1:].rstrip("\n") + "\n", newline="")))
    assert [r["title"] for r in rows if r["url"]] == ["Новость", 'Say "hi", ok'] and rows[1]["article_text"] == "text\nline"
    got = json.loads(read(SK.write_document(articles(spark), str(tmp_path / "a.json"), "json")))
    assert [r["url"] for r in got] == ["https://a/1", "https://b/2"] and got[0]["date"] == "2024-01-20T00:00:00"
    assert json.loads(read(SK.write_document(articles(spark).limit(0), str(tmp_path / "e.json"), "json"))) == []
    with pytest.raises(ValueError, match="unknown output format"):
        SK.write_document(articles(spark), str(tmp_path / "x"), "xlsx")
    with pytest.raises(ValueError, match="unknown output formats"):
        SK.write_all(articles(spark), str(tmp_path), "run", ["csv", "xlsx"])
    own = {"urls": lambda df, path: df.select("url").write.text(path) or path}
    assert SK.write_all(articles(spark), str(tmp_path), "run", ["urls"], more=own) == [f"{tmp_path}/run.urls"]


def test_run_options(spark):
    js = spark.createDataFrame([("q", "searxng", 1, 200, '{"query": "q", "results": [{"url": "https://a/1", "title": "q is a title of some length"}]}', FETCHED)],
                               "query string, engine string, page int, status int, body string, fetched_at timestamp")
    with pytest.raises(ValueError, match="as_of"):
        PL.collect_articles({"json": js}, PL.RunConfig(query="q", time_period="d"))
    with pytest.raises(ValueError, match="corpus"):
        PL.collect_articles({"json": js}, PL.RunConfig(query="q", expand_with_titles=True))
    page = "<html><body><article><p>" + "word " * 40 + "</p></article></body></html>"
    snaps = spark.createDataFrame([("https://a/1", page, 200, FETCHED, 24, 1)], "url string, response_body string, status_code int, fetched_at timestamp, ttl_hours int, seq bigint")
    for hours, filled in ((1, True), (24, True), (25, False)):
        cfg = PL.RunConfig(query="q", as_of=F.lit(FETCHED + dt.timedelta(hours=hours)))
        row = PL.collect_articles({"json": js, "snapshots": snaps}, cfg).first()
        assert (row.article_text != "") == filled
    corpus = spark.createDataFrame([("q is a title of some length", 1, f"https://new/{i}", f"another hit {i}", "s", FETCHED, "", 1, i, "", "yandex", i) for i in range(3)],
                                   "query string, page int, url string, title string, source string, date timestamp, body string, position int, overall_position int, article_text string, source_type string, ord bigint")
    got = PL.collect_articles({"json": js, "corpus": corpus}, PL.RunConfig(query="q", expand_with_titles=True)).orderBy("ord").collect()
    assert [r.source_type for r in got] == ["searxng"] + ["google_search_expansion"] * 3
    none = PL.RunConfig(query="q", expand_with_titles=True, max_titles_to_expand=0)
    assert PL.collect_articles({"json": js, "corpus": corpus}, none).count() == 1


def test_places_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([(EX.CALL_SPAN, 0)], "overall_position bigint, run bigint")
    with pytest.raises(Exception, match="does not fit"):
        EX.merge_sources([(0, df)]).collect()
