"""URL column functions: keys, domains, search URLs, honeypot flag.

The parts of a URL are cut out with regexes that follow Python's ``urlsplit``
rules (scheme = letters/digits/``+-.`` up to the first colon, netloc only after
``//``).  Spark's ``parse_url`` is not used: under ANSI it raises on spaces and
it gives no host for Unicode hosts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsprism.functions.text import col_, ustrip

SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
NETLOC_RE = r"^//([^/?#]*)"
# Python removes tab/CR/LF anywhere and C0 controls or spaces in front.
_UNSAFE_RE = r"[\t\r\n]"
_LEAD_RE = r"^[\x00-\x20]+"


def _clean(url) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(col_(url), F.lit("")), _UNSAFE_RE, ""), _LEAD_RE, "")


def _after_scheme(u: Column) -> Column:
    return F.regexp_replace(u, SCHEME_RE, "")


def netloc(url) -> Column:
    """``urlsplit(url).netloc``: text after ``//`` up to the first of ``/?#``."""
    return F.regexp_extract(_after_scheme(_clean(url)), NETLOC_RE, 1)


def url_path(url) -> Column:
    """``urlparse(url).path``: after the netloc, before ``?``/``#``, without ``;params``."""
    rest = F.regexp_replace(_after_scheme(_clean(url)), r"^//[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_key(url) -> Column:
    """lower(netloc) + path without trailing slashes (scheme, query, fragment dropped)."""
    return F.concat(F.lower(netloc(url)), F.regexp_replace(url_path(url), r"/+$", ""))


def _bad_ipv6(n: Column) -> Column:
    return n.contains("[") != n.contains("]")


def host_of(url) -> Column:
    """Netloc up to the first colon (port and, as in the reference, userinfo are cut)."""
    return F.split_part(netloc(url), F.lit(":"), F.lit(1))


def source_domain_raw(url) -> Column:
    """F3 without IDN decoding: host, else the netloc itself; the url on a parse error."""
    n = netloc(url)
    h = F.split_part(n, F.lit(":"), F.lit(1))
    return F.when(_bad_ipv6(n), F.coalesce(col_(url), F.lit(""))).when(h != "", h).otherwise(n)


def outlet_domain(value) -> Column:
    """outlet-list domain: strip; url / host/path / bare host; cut port and one ``www.``; lower."""
    s = ustrip(F.coalesce(col_(value), F.lit("")))
    host = (F.when(s.contains("://"), F.coalesce(F.nullif(netloc(s), F.lit("")), url_path(s)))
            .when(s.contains("/"), F.split_part(s, F.lit("/"), F.lit(1)))
            .otherwise(s))
    host = F.regexp_replace(F.split_part(host, F.lit(":"), F.lit(1)), r"^www\.", "")
    return F.lower(host)


def log_domain(url) -> Column:
    """netloc with port, or the input when there is none."""
    return F.coalesce(F.nullif(netloc(url), F.lit("")), col_(url))


# ---------------------------------------------------------------------------
# IDN labels.  The codec runs once per distinct host that has one, in a pandas UDF; the
# decoded hosts are joined back, so no other row leaves the JVM.
# ---------------------------------------------------------------------------
_IDN_LABEL = re.compile(r"(?<![^.])xn--[^.]*")


def _unicode_label(found: re.Match) -> str:
    """The label in Unicode; one that is no valid punycode stays as it is."""
    try:
        return found.group().encode("ascii").decode("idna")
    except UnicodeError:
        return found.group()


@F.pandas_udf(StringType())
def idn_decode_udf(s: pd.Series) -> pd.Series:
    return s.str.replace(_IDN_LABEL, _unicode_label, regex=True)


def decode_idn(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Decode punycode labels of ``column`` (in rows matching ``where``)."""
    c = F.col(column)
    hit = c.contains("xn--") if where is None else (c.contains("xn--") & where)
    hosts = df.filter(hit).select(c.alias("_host")).distinct().withColumn("_shown", idn_decode_udf(F.col("_host")))
    joined = df.withColumn("_of", F.when(hit, c)).join(hosts, F.col("_of") == F.col("_host"), "left")
    return joined.withColumn(column, F.coalesce("_shown", c)).select(*df.columns)


def with_source_domain(df: DataFrame, url_col: str = "url", out: str = "source") -> DataFrame:
    """F3 + F4 as a DataFrame step."""
    return decode_idn(df.withColumn(out, source_domain_raw(url_col)), out)


# ---------------------------------------------------------------------------
# Search URLs (F17-F20).  Fixed values: Yandex region codes and default.
# ---------------------------------------------------------------------------
YANDEX_REGIONS = {"RU": 213, "UA": 143, "BY": 157, "KZ": 162, "US": 84, "GB": 10393}
YANDEX_DEFAULT_REGION = 213


def quote_plus(c) -> Column:
    """Python ``quote_plus``: Java's encoder differs on ``*`` (kept) and ``~`` (encoded)."""
    enc = F.url_encode(col_(c))
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strict_query(query, strict, news_tab: bool = False) -> Column:
    """exact-phrase decoration unless already quoted."""
    q = col_(query)
    quoted = q.startswith('"') & q.endswith('"')
    wrapped = F.concat(F.lit("["), q, F.lit("]")) if news_tab else F.concat(F.lit('"'), q, F.lit('"'))
    return F.when(~col_(strict) | quoted, q).otherwise(wrapped)


def google_search_url(query, language, country, strict, start=None, page=None, time_period=None) -> Column:
    q = quote_plus(strict_query(query, strict))
    parts = [F.lit("https://www.google.com/search?q="), q, F.lit("&hl="), col_(language), F.lit("&gl="), col_(country)]
    parts.append(_offset("&start=", start, page, 10))
    parts.append(F.lit("&num=10"))
    parts.append(_period(time_period))
    return F.concat(*parts)


def google_news_url(query, language, country, strict, start=None, page=None, time_period=None) -> Column:
    q = quote_plus(strict_query(query, strict, news_tab=True))
    parts = [F.lit("https://www.google.com/search?q="), q, F.lit("&hl="), col_(language), F.lit("&gl="),
             col_(country), F.lit("&tbm=nws"), _offset("&start=", start, page, 10), _period(time_period)]
    return F.concat(*parts)


def yandex_region(country) -> Column:
    m = F.create_map(*[x for k, v in YANDEX_REGIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, col_(country)), F.lit(YANDEX_DEFAULT_REGION))


def yandex_url(query, country, strict, page_num=None, page=None) -> Column:
    q = quote_plus(strict_query(query, strict))
    return F.concat(F.lit("https://yandex.ru/search/?text="), q, F.lit("&lr="),
                    yandex_region(country).cast("string"), _offset("&p=", page_num, page, 1))


def metasearch_url(base_url, query, language, page) -> Column:
    """JSON API url for one (query, page)."""
    base = F.regexp_replace(col_(base_url), "/+$", "")
    return F.concat(base, F.lit("/search?q="), quote_plus(query), F.lit("&format=json&categories=news&language="),
                    col_(language), F.lit("&pageno="), col_(page).cast("string"))


def site_query(query, domain) -> Column:
    """F19."""
    return F.concat(col_(query), F.lit(" site:"), col_(domain))


def _offset(key: str, explicit, page, step: int) -> Column:
    # An explicit offset is always written; a page number only when > 0.
    exp = col_(explicit) if explicit is not None else F.lit(None).cast("int")
    pg = col_(page) if page is not None else F.lit(0)
    return (F.when(exp.isNotNull(), F.concat(F.lit(key), exp.cast("string")))
            .when(pg > 0, F.concat(F.lit(key), (pg * step).cast("string")))
            .otherwise(F.lit("")))


def _period(tp) -> Column:
    if tp is None:
        return F.lit("")
    t = col_(tp)
    return F.when(t.isNull() | (t == ""), F.lit("")).otherwise(F.concat(F.lit("&tbs=qdr:"), t))


# ---------------------------------------------------------------------------
# F22 honeypot links.  Fixed values: the three url patterns.
# ---------------------------------------------------------------------------
HONEYPOT_PATTERNS = ["/cdn-cgi/", "challenge-platform", "__cf_chl_"]


def honeypot_flag(url, rel) -> Column:
    u = F.coalesce(col_(url), F.lit(""))
    parts = F.split(F.regexp_replace(u, "/+$", ""), "/", -1)
    last3 = F.slice(parts, -3, 3)
    odd = F.size(F.filter(last3, lambda s: (F.length(s) > 20) | ((s != "") & ~s.rlike(r"^\p{L}"))))
    nofollow = F.lower(F.coalesce(col_(rel), F.lit(""))).contains("nofollow") & (F.size(parts) > 5) & (odd >= 2)
    low = F.lower(u)
    pattern = F.exists(F.array(*[F.lit(p) for p in HONEYPOT_PATTERNS]), lambda p: F.contains(low, p))
    return nofollow | pattern
