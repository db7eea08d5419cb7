import datetime as dt
import json
import os
import random
import tempfile

from pyspark.sql import functions as F

from newsprism.functions import flags as FG
from newsprism.operators import dedup as D
from newsprism.operators import extract as X
from newsprism.operators import fetchlog as FL
from newsprism.operators import select as SEL
from newsprism.sinks import files as SK
from newsprism.sources import captures as CP
from newsprism.sources import outlets as O
from newsprism.sources import serp_html as SH
from newsprism.sources import snapshots as SN


def seq_scan(rows):
    """The reference's loop: keep a row unless its title key or url key was recorded by a kept row."""
    seen_t, seen_u, kept = set(), set(), []
    for o, t, u in sorted(rows):
        if t in seen_t or u in seen_u:
            continue
        seen_t.add(t)
        seen_u.add(u)
        kept.append(o)
    return kept


def run_keys(spark, rows, **kw):
    df = spark.createDataFrame(rows, "ord bigint, tkey string, ukey string")
    return sorted(r[0] for r in D.first_wins_multi_key(df, "ord", ["tkey", "ukey"], **kw).collect())


def test_dedup_pairs(spark):
    arts = spark.createDataFrame([
        (0, "http://ex.com/1", "Same title"), (1, "http://ex.com/1", "Same title"),
        (2, "http://ex.com/2", "Breaking: Big news!"), (3, "http://ex.com/3", "big news - lenta.ru"),
        (4, "http://ex.com/article", "Title A"), (5, "https://ex.com/article/", "Title B"),
        (6, "http://ex.com/x", "Three"), (7, "http://ex.com/y", "Distinct"), (8, "http://ex.com/z", "Rows")],
        "ord bigint, url string, title string")
    kept = sorted(r.ord for r in D.dedup_articles(arts).collect())
    assert kept == [0, 2, 4, 6, 7, 8]


def test_dedup_keeps_first_and_third(spark):
    assert run_keys(spark, [(1, "t1", "u1"), (2, "t1", "u2"), (3, "t2", "u2")]) == [1, 3]


def test_dedup_random_equals_sequential(spark):
    rnd = random.Random(7)
    for trial in range(6):
        n = rnd.randint(20, 200)
        rows = [(i, f"t{rnd.randint(0, n // 3)}", f"u{rnd.randint(0, n // 3)}") for i in range(n)]
        rnd.shuffle(rows)
        assert run_keys(spark, rows) == seq_scan(rows), trial


def test_dedup_chain_is_followed_by_doubling(spark, monkeypatch):
    # (t0,u0),(t0,u1),(t1,u1),(t1,u2),... : a chain, the worst case for plain rounds
    rows = [(i, f"t{i // 2}", f"u{(i + 1) // 2}") for i in range(10_000)]
    calls = []
    for name in ("_round", "_chain_round", "_hop"):
        monkeypatch.setattr(D, name, lambda *a, _f=getattr(D, name), _n=name: calls.append(_n) or _f(*a))
    assert run_keys(spark, rows) == seq_scan(rows)
    assert len(calls) <= 20 and calls.count("_chain_round") == 1, calls


def test_dedup_chains_among_other_shapes(spark):
    # runs up and down, stars and knots, every round by links
    rnd = random.Random(5)
    for trial in range(6):
        rows, n = [], 0
        for c in range(12):
            size = rnd.randint(1, 14)
            rows += [(n + i, f"t{c}-{i // 2}", f"u{c}-{(i + 1) // 2}") for i in range(size)]
            n += size
        if trial % 2:
            order = list(range(n))
            rnd.shuffle(order)
            rows = [(order[o], t, u) for o, t, u in rows]
        rows += [(n + i, f"t{rnd.randint(0, 11)}-{rnd.randint(0, 6)}", f"u{rnd.randint(0, 11)}-{rnd.randint(0, 6)}") for i in range(3 * trial)]
        assert run_keys(spark, rows, plain_rounds=0) == seq_scan(rows), trial


def test_dedup_empty_titles(spark):
    arts = spark.createDataFrame([(0, "http://a/1", ""), (1, "http://a/2", ""), (2, "http://a/3", "!!!")],
                                 "ord bigint, url string, title string")
    assert [r.ord for r in D.dedup_articles(arts).collect()] == [0]
    assert sorted(r.ord for r in D.dedup_articles(arts, empty_key="ignore").collect()) == [0, 1, 2]


def test_first_wins_composite(spark):
    df = spark.createDataFrame([("1.1.1.1", 80, "US", 0), ("1.1.1.1", 80, "UK", 1), ("2.2.2.2", 80, "DE", 2),
                                ("1.1.1.1", 81, "FR", 3)], "ip string, port int, country string, ord bigint")
    out = {(r.ip, r.port): r.country for r in D.first_wins(df, ["ip", "port"]).collect()}
    assert out == {("1.1.1.1", 80): "US", ("2.2.2.2", 80): "DE", ("1.1.1.1", 81): "FR"}


def test_relevance(spark):
    df = spark.createDataFrame([("AI news today", ""), ("Weather", "rain"), ("", "ai and news")], "title string, body string")
    assert SEL.query_terms("AI news a") == ["news"]
    assert len(SEL.filter_relevant(df, "AI news").collect()) == 2
    assert len(SEL.filter_relevant(df, "news news", min_term_matches=2).collect()) == 2
    assert len(SEL.filter_relevant(df, "a b").collect()) == 3


def test_cascade_contract(spark):
    long_p = "<p>" + "word " * 30 + "</p>"
    df = spark.createDataFrame([("<html><body><article>" + long_p + "</article></body></html>",),
                                ("<html><body><p>short</p></body></html>",), ("",)], "html string")
    out = [r.article_text for r in X.extract_text(df).collect()]
    assert out[0].strip().startswith("word word") and len(out[0].strip()) > 50
    assert out[1] == "" and out[2] == ""


def test_cascade_custom_extractors(spark):
    df = spark.createDataFrame([("<p>x</p>",)], "html string")
    short = ("short", lambda c, r: F.lit("   tiny   "))
    blank = ("blank", lambda c, r: F.lit(" " * 80))
    good = ("good", lambda c, r: F.lit("  " + "y" * 60 + "  "))
    out = X.extract_text(df, extractors=[short, blank, good]).collect()[0].article_text
    assert out == "  " + "y" * 60 + "  "  # returned unstripped


def test_snapshots_ttl(spark):
    now = dt.datetime(2024, 1, 10, 12, 0)
    rows = [("u1", "old", 200, now - dt.timedelta(hours=2), 1, 1), ("u2", "b", 200, now - dt.timedelta(hours=2), 0, 2),
            ("u3", "fresh", 200, now - dt.timedelta(minutes=30), 24, 3), ("u3", "newer", 301, now - dt.timedelta(minutes=5), 24, 4)]
    snaps = spark.createDataFrame(rows, "url string, response_body string, status_code int, fetched_at timestamp, ttl_hours int, seq bigint")
    as_of = F.lit(now).cast("timestamp")
    fresh = {r.url: (r.response_body, r.status_code) for r in SN.fresh(SN.latest(snaps), as_of).collect()}
    assert fresh == {"u3": ("newer", 301)}
    assert SN.expired(SN.latest(snaps), as_of).count() == 2
    front = spark.createDataFrame([("u1",), ("u3",), ("u9",)], "url string")
    assert sorted(r.url for r in SN.to_fetch(front, snaps, as_of).collect()) == ["u1", "u9"]
    up = SN.upsert(snaps, spark.createDataFrame([("u3", "x", 500, now, 24, 5)], snaps.schema))
    assert {r.url: r.response_body for r in up.collect()}["u3"] == "newer"  # only 200s are stored


def test_failure_levels_cross_buckets(spark):
    t0 = dt.datetime(2024, 1, 1)
    oks = [False, False, False, False, True, False, True, False, False]
    rows = [("d", t0 + dt.timedelta(minutes=50 * i), i, ok) for i, ok in enumerate(oks)]
    rows += [("e", t0, 100, False)]
    log = spark.createDataFrame(rows, "key string, ts timestamp, seq bigint, ok boolean")
    out = FL.endpoint_health(FL.domain_backoff(FL.failure_levels(log, bucket_seconds=3600)))
    got = {r.seq: (r.level, r.skip, r.delay_s, r.disabled) for r in out.collect()}
    assert [got[i][0] for i in range(9)] == [1, 2, 3, 4, 0, 1, 0, 1, 2]
    assert got[3][1] is True and got[2][1] is False and got[2][2] == 60.0 and got[0][2] == 15.0
    assert got[2][3] is True and got[4][3] is False and got[100][0] == 1


def test_outlet_headers_and_quartile(spark):
    assert O.resolve_outlet_columns(["URL статьи", "Название", "Заметность"]) == ("URL статьи", "Заметность")
    assert O.resolve_outlet_columns(["source", "name", "visibility"]) == ("source", "visibility")
    assert O.resolve_outlet_columns(["col_a", "col_b", "col_c"]) == ("col_a", "col_c")
    assert O.resolve_outlet_columns(["a", "b"]) == ("a", "b")
    assert O.resolve_outlet_columns(["a"]) is None
    vis = [100, 80, 5, 3, 95, 10, 90, 2]
    names = ["https://big-news.com/article", "https://medium-outlet.ru/post", "https://www.small-blog.net/entry",
             "https://tiny-paper.org/story", "https://mega-media.com/news", "https://local-gazette.ru/report",
             "https://national-daily.com/article", "https://micro-digest.net/piece"]
    df = spark.createDataFrame([(n, "n", str(v)) for n, v in zip(names, vis)] + [("x.org", "n", "oops")],
                               "source string, name string, visibility string")
    out = O.standardize(df)
    assert abs(out.agg(F.percentile("visibility", F.lit(0.25))).first()[0] - 4.5) < 1e-9
    assert [r.domain for r in O.outlet_domains(out).collect()] == ["micro-digest.net", "tiny-paper.org"]


def test_outlet_csv_missing_file(spark):
    assert O.read_outlets(spark, "/nonexistent/outlets.csv").count() == 0


def test_json_harvest_fixtures(spark):
    docs = [
        {"url": "https://ex.com/a", "title": "Flat article title", "snippet": "s"},
        {"results": [{"link": "https://ex.com/b", "name": "Array item one", "description": "d"},
                     {"url": "https://ex.com/c", "title": "Array item two"}]},
        {"url": "", "title": ""},
        {"url": "javascript:void(0)", "title": "Not a real link"},
        {"a": {"b": {"c": {"d": {"e": {"url": "https://ex.com/deep", "title": "Deep enough title",
                                       "f": {"url": "https://ex.com/deeper", "title": "Too deep title"}}}}}}},
        {"url": 5, "link": "https://ex.com/n", "title": "Numeric url blocks"},
    ]
    cap = spark.createDataFrame([(i, "https://x/api/search", 200, {"content-type": "application/json"}, json.dumps(d))
                                 for i, d in enumerate(docs)], "rid bigint, url string, status int, headers map<string,string>, body string")
    rows = CP.harvest(cap, F.current_timestamp()).orderBy("rid", "path").collect()
    assert [(r.rid, r.url, r.body) for r in rows] == [
        (0, "https://ex.com/a", "s"), (1, "https://ex.com/b", "d"), (1, "https://ex.com/c", ""), (4, "https://ex.com/deep", "")]
    sel = spark.createDataFrame([("https://a/api/x", 200, {"content-type": "application/json"}),
                                 ("https://a/page", 200, {"content-type": "application/json"}),
                                 ("https://a/api/x", 200, {"content-type": "text/html"})],
                                "url string, status int, headers map<string,string>")
    assert [r[0] for r in sel.select(CP.is_api_response(F.col("url"), F.col("status"), F.col("headers"))).collect()] == [
        True, False, False]


def test_html_web_rules(spark):
    ok = '<div class="g"><a href="https://lenta.ru/news/1"><h3>Real headline here</h3></a><div class="VwiC3b">3 hours ago — Body</div></div>'
    short = '<div class="g"><a href="https://a.ru/2"><h3>Short</h3></a></div>'
    internal = '<div class="g"><a href="https://www.google.com/settings"><h3>Google settings page</h3></a></div>'
    system = '<div class="g"><a href="https://b.ru/3"><h3>People also search for similar topics here</h3></a></div>'
    page1 = "<html><body>" + ok + short + internal + system + "</body></html>"
    arch = spark.createDataFrame([("q", "google_search", 1, page1, "https://www.google.com/search", dt.datetime(2024, 1, 1)),
                                  ("q", "google_search", 2, "<html><body></body></html>", "https://www.google.com/search", dt.datetime(2024, 1, 1)),
                                  ("q", "google_search", 3, page1, "https://www.google.com/search", dt.datetime(2024, 1, 1))],
                                 "query string, engine string, page int, html string, final_url string, fetched_at timestamp")
    rows = SH.to_articles(arch, SH.WEB).collect()
    assert [(r.url, r.position, r.overall_position, r.body, r.page) for r in rows] == [("https://lenta.ru/news/1", 1, 1, "Body", 1)]
    blocked = arch.withColumn("html", F.when(F.col("page") == 1, F.lit("<p>Our systems have detected unusual traffic</p>"))
                              .otherwise(F.col("html")))
    assert SH.to_articles(blocked, SH.WEB).count() == 0


def test_block_flags(spark):
    df = spark.createDataFrame([("Just a moment...", {"content-type": "text/html"}, 200),
                                ("", {}, 200), ('{"e": "access denied"}', {"Content-Type": "application/json"}, 200),
                                ("<p>Access Denied</p>", {}, 200), ("fine", {}, 403)],
                               "text string, headers map<string,string>, status int")
    got = [tuple(r) for r in df.select(FG.looks_blocked("text", "headers"), FG.fetch_blocked("status", "text", "headers")).collect()]
    assert got == [(True, True), (False, False), (False, False), (True, True), (False, True)]


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="newsprism-sink-")
    arts = spark.createDataFrame([
        ("https://lenta.ru/1", "Новость первая", "lenta.ru", dt.datetime(2024, 1, 15, 10, 30), "", "текст", "searxng", 1, 1, 1, 0),
        ("https://ria.ru/2", "Вторая", "ria.ru", dt.datetime(2024, 1, 15, 12, 0), "snip", "x" * 50, "yandex", 1, 2, 2, 1)],
        "url string, title string, source string, date timestamp, body string, article_text string, source_type string, "
        "page int, position int, overall_position int, ord bigint")
    paths = SK.write_all(arts, d, SK.output_stem("AI news", 3, "w", dt.datetime(2026, 3, 20, 14, 30, 22)),
                         ["csv", "json", "markdown"], max_chars=10)
    assert [os.path.basename(p) for p in paths] == ["AI_news_w_3pages_20260320_143022" + e for e in (".csv", ".json", ".md")]
    back = spark.read.option("header", True).csv(paths[0])
    assert back.columns == SK.COLUMNS and back.count() == 2
    assert sorted(r.date for r in back.collect()) == ["2024-01-15T10:30:00", "2024-01-15T12:00:00"]
    js = spark.read.json(paths[1]).orderBy("position").collect()
    assert js[0].title == "Новость первая"
    md = "".join(open(os.path.join(paths[2], f), encoding="utf-8").read() for f in sorted(os.listdir(paths[2]))
                 if f.startswith("part-"))
    first = ("# Новость первая\n\n- **Source:** lenta.ru\n- **URL:** https://lenta.ru/1\n"
             "- **Date:** 2024-01-15T10:30:00\n\n---\n\nтекст")
    second = ("# Вторая\n\n- **Source:** ria.ru\n- **URL:** https://ria.ru/2\n- **Date:** 2024-01-15T12:00:00\n"
              "- **Snippet:** snip\n\n---\n\n" + "x" * 10 + "\n\n[truncated]")
    # each section is followed by the separator (part files concatenate in order)
    assert md == first + FG.SECTION_SEPARATOR + second + FG.SECTION_SEPARATOR
    empty = spark.createDataFrame([], arts.schema)
    p = SK.write_csv(empty, os.path.join(d, "empty.csv"))
    assert spark.read.option("header", True).csv(p).columns == SK.COLUMNS


def test_top_k_per_group_and_global_rank(spark):
    from newsprism.operators import expand as EX
    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(0, 30, 3)]
    df = spark.createDataFrame(rows, "g string, ord bigint").repartition(7)
    top = EX.top_k_per_group(df, ["g"], "ord", 4).collect()
    assert sorted((r.g, r.ord) for r in top) == [("cold", 0), ("cold", 3), ("cold", 6), ("cold", 9),
                                                  ("hot", 0), ("hot", 1), ("hot", 2), ("hot", 3)]
    doms = spark.createDataFrame([(f"d{i:03d}",) for i in range(57)] + [("d005",)], "domain string").repartition(5)
    ranks = {r.domain: r.rank for r in EX.global_rank(doms, "domain", partitions=6).collect()}
    assert ranks == {f"d{i:03d}": i for i in range(57)}


def test_dedup_hot_key_third_of_rows(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        t = "" if i % 3 == 0 else f"t{rnd.randint(0, 150)}"   # a third share the empty title key
        rows.append((i, t, f"u{rnd.randint(0, 300)}"))
    assert run_keys(spark, rows) == seq_scan(rows)


def test_fill_text_contract(spark):
    body = "<html><body><article><p>" + "word " * 30 + "</p></article></body></html>"
    arts = spark.createDataFrame([(0, "https://a/1", "kept as is"), (1, "https://a/2", ""), (2, "https://a/3", ""),
                                  (3, "https://a/4", "")], "ord bigint, url string, article_text string")
    snaps = spark.createDataFrame([("https://a/1", body, 200), ("https://a/2", body, 200), ("https://a/3", body, 404),
                                   ("https://a/4", "", 200)], "url string, response_body string, status_code int")
    out = {r.ord: r.article_text for r in X.fill_article_text(arts, snaps).collect()}
    assert out[0] == "kept as is" and out[1].startswith("word word") and out[2] == "" and out[3] == ""
    assert len(out) == 4


def test_exact_quantile_matches_numpy(spark):
    import numpy as np
    from newsprism.operators.expand import exact_quantile
    rnd = random.Random(11)
    for n in (1, 2, 5, 97):
        vals = [float(rnd.choice([1, 2, 2, 3, 5, 8, 13])) + rnd.random() * (n % 2) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
        for q in (0.0, 0.25, 0.5, 1.0):
            assert abs(spark.range(1).select(exact_quantile(df, "v", q)).first()[0] - float(np.percentile(vals, q * 100))) < 1e-9
    assert spark.range(1).select(exact_quantile(spark.createDataFrame([], "v double"), "v", 0.25)).first()[0] is None
