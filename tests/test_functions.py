import datetime as dt

from pyspark.sql import functions as F

from newsprism.functions import dates, text, urls
from tests.conftest import one_col

AS_OF = dt.datetime(2024, 3, 1, 12, 0, 0)


def test_title_key_literals(spark):
    cases = {
        "Breaking: Big event": "big event",
        "Срочно: Важная новость": "важная новость",
        "Headline | news": "headline",
        "Заголовок | новости": "заголовок",
        "Hello, world! How's it going?": "hello world how s it going",
        "Breaking: Big announcement!!!  - lenta.ru": "big announcement",
        "update: breaking: x": "breaking x",
        "Breaking: update: Story": "story",
        "big news - lenta.ru": "big news",
        "  ": "",
        "x - news - lenta.ru": "x",
        "x | news - news": "x news",
    }
    got = one_col(spark, list(cases), text.title_key)
    assert dict(zip(cases, got)) == cases


def test_clean_snippet(spark):
    cases = {
        "15 янв. 2024 г. — Actual text": "Actual text",
        "15 января 2024 г. - Текст": "Текст",
        "15 Jan 2024 — Body here": "Body here",
        "5 часов назад — Новость": "Новость",
        "3 hours ago - News   body": "News body",
        "— , leading": "leading",
        "": "",
        "plain": "plain",
    }
    got = one_col(spark, list(cases), text.clean_snippet)
    assert dict(zip(cases, got)) == cases


def test_domains(spark):
    got = one_col(spark, ["https://example.com/path", "http://localhost:8080/search", "not-a-url",
                          "https://xn--e1afmkfd.xn--p1ai/x"], urls.source_domain_raw)
    assert got == ["example.com", "localhost", "", "xn--e1afmkfd.xn--p1ai"]
    df = spark.createDataFrame([("https://xn--e1afmkfd.xn--p1ai/x",), ("https://a.com",), ("http://xn--zz.com",)], "url string")
    out = {r.url: r.source for r in urls.with_source_domain(df).collect()}
    assert out["https://xn--e1afmkfd.xn--p1ai/x"] == "пример.рф"
    assert out["https://a.com"] == "a.com"
    assert out["http://xn--zz.com"] == "xn--zz.com"
    assert one_col(spark, ["https://example.com:8080/path", "not-a-url"], urls.log_domain) == ["example.com:8080", "not-a-url"]
    assert one_col(spark, ["https://www.example.com/path", " site.ru/x ", "WWW.A.org:80", ""], urls.outlet_domain) == [
        "example.com", "site.ru", "www.a.org", ""]


def test_url_key(spark):
    got = one_col(spark, ["http://ex.com/article", "https://ex.com/article/", "https://EX.com/A;p=1?q#f",
                          "ex.com/path/", "https://u:p@h:80/x//"], urls.url_key)
    assert got == ["ex.com/article", "ex.com/article", "ex.com/A", "ex.com/path", "u:p@h:80/x"]


def test_dates(spark):
    df = spark.createDataFrame([(s,) for s in [
        "2 часа назад", "5 минут назад", "3 дня назад", "1 неделю назад", "1 час назад", "7 дней назад",
        "2 hours ago", "5 minutes ago", "3 days ago", "1 week ago",
        "Jan 15, 2024", "2024-01-15", "15 Jan 2024", "15.01.2024", "January 15, 2024", "  2024-01-15  ",
        "", "   ", "not-a-date-at-all xyz", "99999", "2024-01-15T10:30:00Z", "2024-01-15T10:30:00+03:00",
        "2024-01-15T10:30:00", "99999999999 days ago"]], "s string")
    out = [r[0] for r in df.select(dates.parse_date("s", F.lit(AS_OF))).collect()]
    h = dt.timedelta(hours=1)
    exp = [AS_OF - 2 * h, AS_OF - dt.timedelta(minutes=5), AS_OF - dt.timedelta(days=3), AS_OF - dt.timedelta(weeks=1),
           AS_OF - h, AS_OF - dt.timedelta(days=7), AS_OF - 2 * h, AS_OF - dt.timedelta(minutes=5),
           AS_OF - dt.timedelta(days=3), AS_OF - dt.timedelta(weeks=1)] + [dt.datetime(2024, 1, 15)] * 6 + [AS_OF] * 4 + [
        dt.datetime(2024, 1, 15, 10, 30), dt.datetime(2024, 1, 15, 7, 30), dt.datetime(2024, 1, 15, 10, 30), AS_OF]
    assert out == exp


def test_iso_format(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, 10, 30),), (dt.datetime(2024, 1, 15, 10, 30, 0, 1500),)], "t timestamp")
    assert [r[0] for r in df.select(dates.iso_format("t")).collect()] == ["2024-01-15T10:30:00", "2024-01-15T10:30:00.001500"]


def test_honeypot(spark):
    df = spark.createDataFrame([
        ("https://example.com/article", ""), ("https://example.com/cdn-cgi/x", ""),
        ("https://example.com/challenge-platform/y", ""),
        ("https://example.com/a/b/c/12345678901234567890123/98765432109876543210987", "nofollow"),
        ("https://example.com/about", "nofollow")], "url string, rel string")
    assert [r[0] for r in df.select(urls.honeypot_flag("url", "rel")).collect()] == [False, True, True, True, False]


def test_search_urls(spark):
    df = spark.createDataFrame([("AI news", "ru", "RU", False, 0), ("новости ~*", "en", "XX", True, 2)],
                               "q string, hl string, gl string, strict boolean, page int")
    rows = df.select(urls.google_search_url("q", "hl", "gl", "strict", page="page").alias("g"),
                     urls.yandex_url("q", "gl", "strict", page="page").alias("y"),
                     urls.google_news_url("q", "hl", "gl", "strict", page="page").alias("n")).collect()
    assert rows[0].g == "https://www.google.com/search?q=AI+news&hl=ru&gl=RU&num=10"
    assert rows[1].g == "https://www.google.com/search?q=%22%D0%BD%D0%BE%D0%B2%D0%BE%D1%81%D1%82%D0%B8+~%2A%22&hl=en&gl=XX&start=20&num=10"
    assert rows[1].y.endswith("&lr=213&p=2")
    assert rows[1].n.startswith("https://www.google.com/search?q=%5B")
