"""Archived HTML result pages -> articles.

Archive schema: ``query, engine, page, html, final_url, fetched_at``.

The Python part is small and per row: ``mapInPandas`` parses each page with the
stdlib parser, finds the result blocks with the first result selector that hits
(S4) and, inside every block, the first element of each candidate selector.  It
emits one row per block with its candidates as an array.  Everything else is
native Spark on that array (no shuffle): per field the first candidate that
qualifies, drop rules P2-P4, dates, snippet cleaning, then the paging rules per
(query, engine): stop at the first page without a kept row (W3), a blocked page
before that stop voids the engine for the query (W4), running overall position
(W1).  A search has at most ``max_pages`` pages, so these windows are bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsprism.functions.dates import parse_date
from newsprism.functions.text import any_phrase, clean_snippet
from newsprism.functions.urls import source_domain_raw
from newsprism.plans.articles import first_paragraph, page_title
from newsprism.sources.metasearch import search_columns
from newsprism.sources.tables import read_table


@dataclass(frozen=True)
class FieldRule:
    name: str
    selectors: tuple[str, ...]
    mode: str            # "exists": first element found; "text": first non-empty text;
    attr: str | None = None   # "attr_or_text": first with the attribute or text non-empty


@dataclass(frozen=True)
class RuleSet:
    engine: str
    results: tuple[str, ...]
    fields: tuple[FieldRule, ...]


# ---------------------------------------------------------------------------
# Result and field selectors of the reference's parsers, in order.
# ---------------------------------------------------------------------------
WEB = RuleSet("google_search",
              ("div[jscontroller][data-hveid][data-ved][lang]", "div.g", "[data-snc]", "div[data-hveid] :has(> h3)"),
              (FieldRule("link", ("a[href]",), "exists", "href"),
               FieldRule("title", ("h3",), "exists"),
               FieldRule("body", ("[data-sncf='1'] span", "div[data-sncf] span", ".VwiC3b", "span.st"), "text"),
               FieldRule("date", ("span.LEwnzc", "span.MUxGbd", "cite + span"), "text")))
NEWS = RuleSet("google_news",
               ("div[data-news-cluster-id]", "div.SoaBEf", "div.dbsr"),
               (FieldRule("link", ("a[href]",), "exists", "href"),
                FieldRule("title", ("div[role='heading']", "h3", "a"), "text"),
                FieldRule("source", ("g-img + span", ".CEMjEf span", "span.WF4CUc", ".NUnG9d span"), "text"),
                FieldRule("date", ("time", "span.WG9SHc", "span.r0bn4c", "span.OSrXXb"), "attr_or_text", "datetime"),
                FieldRule("body", (".GI74Re", ".Y3v8qd", ".st"), "text")))
YANDEX = RuleSet("yandex",
                 ("li.serp-item", "div.organic", "div[data-cid]"),
                 (FieldRule("link", ("h2 a[href]", ".OrganicTitle a[href]", "a[href]"), "exists", "href"),
                  FieldRule("title", ("h2", ".OrganicTitle-LinkText", ".organic__title-part", ".OrganicTitleContentSpan"), "text"),
                  FieldRule("source", (".Path", ".OrganicUrl", ".organic__path", ".Organic-Path"), "text"),
                  FieldRule("body", (".OrganicText", ".TextContainer", ".organic__content-wrapper", ".Typo"), "text"),
                  FieldRule("date", (".organic__subtitle", ".OrganicSubtitle", ".Organic-Subtitle"), "text")))
MINIMAL = RuleSet("seleniumbase_cdp",
                  ("div.g",),
                  (FieldRule("title", ("h3",), "exists"),
                   FieldRule("link", ("a",), "exists", "href"),
                   FieldRule("body", ("[data-sncf], .VwiC3b, .lEBKkf",), "exists")))
RULE_SETS = {r.engine: r for r in (WEB, NEWS, YANDEX, MINIMAL)}

# Block-page phrases (web/news), landing-url patterns, Yandex phrases and CAPTCHA selectors.
BOT_PHRASES = [
    "подозрительный трафик", "suspicious traffic", "необычный трафик", "unusual traffic",
    "verify you are human", "подтвердите, что вы человек", "solve the captcha", "решите капчу",
    "our systems have detected unusual traffic", "наши системы обнаружили необычный трафик",
    "you are not a robot", "вы не робот", "i'm not a robot", "я не робот",
]
BLOCKING_PHRASES = [
    "sorry, we are unable to deliver results", "we can't search for results",
    "traffic from your computer network", "трафик с вашей компьютерной сети",
    "please check the url for typos", "проверьте правильность url",
]
BLOCKING_URL_PATTERNS = ["captcha", "blocked", "denied", "sorry"]
YANDEX_PHRASES = [
    "я не робот", "вы не робот", "i'm not a robot", "подозрительный трафик", "suspicious traffic",
    "подтвердите, что вы не робот", "confirm you are not a robot", "captcha", "showcaptcha",
]
YANDEX_CAPTCHA_SELECTORS = [
    "div.CheckboxCaptcha", "div.AdvancedCaptcha", "form[action*='showcaptcha']",
    "img.AdvancedCaptcha-Image", "input.CheckboxCaptcha-Button",
]
# Web-search titles that are engine messages, not articles (P3); minimum title length.
SYSTEM_MESSAGES = [
    "по запросу", "по вашему запросу", "для запроса", "nothing found", "no results", "ничего не найдено",
    "ничего не найден", "результатов не найдено", "попробуйте", "другие также ищут", "people also search",
    "related searches", "показать ещё", "show more", "next", "previous", "назад", "далее",
]
MIN_TITLE_LENGTH = 10
ENGINE_INTERNAL = {"google_search": "google.com", "google_news": "google.com", "yandex": "yandex."}


def web_blocked(html: Column, final_url: Column) -> Column:
    """bot or blocking phrases in the page, or a blocking landing url."""
    return any_phrase(html, BOT_PHRASES + BLOCKING_PHRASES) | any_phrase(final_url, BLOCKING_URL_PATTERNS)


def yandex_blocked(html: Column, captcha: Column) -> Column:
    """a CAPTCHA element is present (found by the parser), or a Yandex bot phrase is in the page."""
    return captcha | any_phrase(html, YANDEX_PHRASES)


def system_message(title: Column) -> Column:
    """P3."""
    return any_phrase(title, SYSTEM_MESSAGES)


# --- the per-row Python part ---------------------------------------------------------

CAND = "array<struct<cand:int,field:string,text:string,attr:string>>"


def _parse_blocks(it):
    """Pages in, one row per result block out (one row with block -1 for a page without); the
    rule set is picked by the page's engine."""
    from newsprism.functions import dom
    for pdf in it:
        out = []
        keys = [c for c in pdf.columns if c not in ("html", "engine")]
        for engine, html, *rest in zip(pdf["engine"], pdf["html"], *[pdf[c] for c in keys]):
            rules = RULE_SETS[engine]
            root = dom.parse(html)
            captcha = rules is YANDEX and any(dom.select_one(root, s) is not None for s in YANDEX_CAPTCHA_SELECTORS)
            blocks = next((found for found in (dom.select(root, sel) for sel in rules.results) if found), [])
            if not blocks:
                out.append((engine, *rest, captcha, -1, []))
            for i, b in enumerate(blocks):
                cands = []
                for fr in rules.fields:
                    for k, sel in enumerate(fr.selectors):
                        el = dom.select_one(b, sel)
                        if el is not None:
                            attr = el.attrs.get(fr.attr, "") if fr.attr else ""
                            cands.append({"cand": k, "field": fr.name, "text": el.text().strip(), "attr": attr})
                out.append((engine, *rest, captcha, i, cands))
        yield pd.DataFrame(out, columns=["engine", *keys, "captcha", "block", "cands"])


def _pick(rule: FieldRule) -> Column:
    """First qualifying candidate of a field: its attribute or text; null when none."""
    c = F.col("cands")
    if rule.mode == "exists":
        ok = lambda x: x["field"] == rule.name
    elif rule.mode == "text":
        ok = lambda x: (x["field"] == rule.name) & (x["text"] != "")
    else:
        ok = lambda x: (x["field"] == rule.name) & ((x["attr"] != "") | (x["text"] != ""))
    first = F.try_element_at(F.array_sort(F.filter(c, ok)), F.lit(1))
    if rule.mode == "attr_or_text":
        return F.when(first["attr"] != "", first["attr"]).otherwise(first["text"])
    return first["attr"] if rule.attr else first["text"]


def parse_pages(archive: DataFrame, search: tuple[str, ...] | None = None) -> DataFrame:
    """One row per result block with its candidate fields, all engines in one pass.

    Block-page phrases are tested natively on the html before it goes to Python; the wide html
    column is not carried past the parse, and nothing is joined back.
    """
    search = search or search_columns(archive)
    pages = archive.select("engine", *[c for c in search if c != "engine"], F.col("page").cast("int").alias("page"), "fetched_at",
                           web_blocked(F.col("html"), F.col("final_url")).alias("_web_blk"),
                           any_phrase(F.col("html"), YANDEX_PHRASES).alias("_ya_phrase"), "html")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html"]
    return pages.mapInPandas(_parse_blocks, ", ".join([*kept, "captcha boolean", "block int", f"cands {CAND}"]))


def to_articles(archive: DataFrame, rules: RuleSet, as_of: Column | None = None,
                search: tuple[str, ...] | None = None) -> DataFrame:
    """S5-S8 + W1-W4 for one engine's archive."""
    search = search or search_columns(archive)
    return block_articles(parse_pages(archive.filter(F.col("engine") == rules.engine), search), rules, as_of, search)


def block_articles(parsed: DataFrame, rules: RuleSet, as_of: Column | None = None,
                   search: tuple[str, ...] | None = None) -> DataFrame:
    """S5-S8 + W1-W4 on parsed blocks (see ``parse_pages``) of one engine."""
    search = search or search_columns(parsed)
    b = parsed.filter(F.col("engine") == rules.engine)
    b = b.select(*search, "page", "fetched_at", "_web_blk", "_ya_phrase", "captcha", "block",
                 *[_pick(fr).alias(f"f_{fr.name}") for fr in rules.fields])
    ts = as_of if as_of is not None else F.col("fetched_at")
    href = F.col("f_link")
    title = F.coalesce(F.col("f_title"), F.lit(""))
    if rules is MINIMAL:
        keep = (href.isNotNull() & F.col("f_title").isNotNull() & (href != "") & (title != "")
                & href.startswith("http"))
        body = F.coalesce(F.col("f_body"), F.lit(""))
        date = ts
        source = source_domain_raw(href)
        has_src = False
    else:
        keep = href.isNotNull() & (href != "") & ~F.contains(href, F.lit(ENGINE_INTERNAL[rules.engine]))
        keep = keep & (F.length(title) >= MIN_TITLE_LENGTH)
        if rules is WEB:
            keep = keep & ~system_message(title)
        body = clean_snippet(F.coalesce(F.col("f_body"), F.lit("")))
        d = F.col("f_date")
        date = F.when(d.isNull(), ts).otherwise(parse_date(d, ts))
        has_src = any(f.name == "source" for f in rules.fields)
        source = (F.coalesce(F.nullif(F.col("f_source"), F.lit("")), source_domain_raw(href))
                  if has_src else source_domain_raw(href))
    blocked = (F.col("captcha") | F.col("_ya_phrase") if rules is YANDEX
               else F.col("_web_blk") if rules in (WEB, NEWS) else F.lit(False))
    rows = b.select(*search, "page", blocked.alias("_blocked"),
                    F.coalesce(keep & (F.col("block") >= 0), F.lit(False)).alias("_keep"),
                    href.alias("url"), title.alias("title"), source.alias("source"), date.alias("date"),
                    body.alias("body"), (F.col("block") + 1).cast("int").alias("position"),
                    ((F.coalesce(F.col("f_source"), F.lit("")) == "") if has_src else F.lit(True)).alias("source_from_url"))
    # One shuffle by search call (at most max_pages pages); all windows below share it.
    w = Window.partitionBy(*search)
    per_page = Window.partitionBy(*search, "page")
    rows = rows.withColumns({"_blk": F.max(F.col("_blocked").cast("int")).over(per_page),
                             "_n": F.sum(F.col("_keep").cast("int")).over(per_page)})
    rows = rows.withColumn("_stop", F.min(F.when((F.col("_blk") == 0) & (F.col("_n") == 0), F.col("page"))).over(w))
    reached = F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))
    rows = rows.withColumn("_void", F.max(((F.col("_blk") == 1) & reached).cast("int")).over(w))
    kept = rows.filter(reached & (F.col("_void") == 0) & F.col("_keep"))
    overall = F.row_number().over(w.orderBy("page", "position")) if rules is not MINIMAL else F.lit(0)
    return kept.select(*search, "url", "title", "source", "date", "body", "page", "position",
                       overall.cast("int").alias("overall_position"), F.lit("").alias("article_text"),
                       F.lit(rules.engine).alias("source_type"), "source_from_url")


# --- an HTML result archive built by Spark from ``pages`` ----------------------------

ENGINES = ["google_search", "google_news", "yandex", "seleniumbase_cdp"]
BLOCK_MARK = "spam-farm"
PAGE_IDS = 40
CALL_PAGE_IDS = 400
BASE_TS = "2024-01-01 00:00:00"
FETCHED_TS = "2024-01-20 00:00:00"
GOOGLE_BLOCK_PAGE = ("<html><body><p>Our systems have detected unusual traffic from your computer network."
                     "</p></body></html>")
YANDEX_BLOCK_PAGE = ('<html><body><form action="/showcaptcha?retpath=x"><input class="CheckboxCaptcha-Button">'
                     "</form></body></html>")
RELATED_BLOCK = '<div class="g"><a href="https://www.google.com/search?q=related"><h3>Related searches</h3></a></div>'


def _esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def result_fields(pages: DataFrame) -> DataFrame:
    pid = F.col("page_id")
    stamp = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(BASE_TS))) + pid * F.lit(3_600_000_000))
    date_text = (F.when(F.pmod(pid, F.lit(3)) == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                 .when(F.pmod(pid, F.lit(3)) == 1, F.date_format(stamp, "MMM d, yyyy"))
                 .otherwise(F.concat((F.pmod(pid, F.lit(48)) + 1).cast("string"), F.lit(" hours ago"))))
    para = first_paragraph(F.col("html"))
    snippet = F.when(F.pmod(pid, F.lit(2)) == 0,
                     F.concat(F.date_format(stamp, "d MMM yyyy"), F.lit(" — "), para)).otherwise(para)
    return pages.select(
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("query"),
        F.expr(f"page_id div {CALL_PAGE_IDS}").alias("run"),
        F.expr(f"page_id % {CALL_PAGE_IDS} div {PAGE_IDS} + 1").cast("int").alias("page"), pid.alias("pid"),
        _esc(F.col("url")).alias("u"), _esc(page_title(F.col("html"))).alias("t"), _esc(snippet).alias("s"),
        _esc(date_text).alias("d"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
        source_domain_raw(F.col("url")).alias("h"), F.contains(F.col("url"), F.lit(BLOCK_MARK)).alias("mark"))


def _fragment(engine: str) -> Column:
    u, t, s, d, h, iso = (F.col(c) for c in ("u", "t", "s", "d", "h", "iso"))
    if engine == "google_search":
        parts = [F.lit('<div class="g" data-hveid="'), F.col("pid").cast("string"), F.lit('"><a href="'), u,
                 F.lit('"><h3>'), t, F.lit('</h3></a><div class="VwiC3b">'), s,
                 F.lit('</div><span class="LEwnzc">'), d, F.lit("</span></div>")]
    elif engine == "google_news":
        parts = [F.lit('<div class="SoaBEf"><a href="'), u, F.lit('"><div role="heading">'), t,
                 F.lit('</div></a><div class="CEMjEf"><span>'), h, F.lit('</span></div><span class="OSrXXb"><time datetime="'),
                 iso, F.lit('">'), d, F.lit('</time></span><div class="GI74Re">'), s, F.lit("</div></div>")]
    elif engine == "yandex":
        parts = [F.lit('<li class="serp-item"><h2><a href="'), u, F.lit('">'), t, F.lit('</a></h2><div class="Path">'),
                 h, F.lit('</div><div class="OrganicText">'), s, F.lit('</div><div class="OrganicSubtitle">'), d,
                 F.lit("</div></li>")]
    else:
        parts = [F.lit('<div class="g"><h3>'), t, F.lit('</h3><a href="'), u, F.lit('">open</a><div class="lEBKkf">'),
                 s, F.lit("</div></div>")]
    return F.concat(*parts)


def pages_html_archive(spark: SparkSession, sf_dir: str, max_pages: int = 10,
                       engines: list[str] | None = None) -> DataFrame:
    """Result pages of four engines rendered from ``pages`` (query = language segment, a search
    call = that query in a run of 400 page ids, result page = 40 page ids).  A page whose first result is a ``spam-farm`` url was
    archived as a block page (web, news, Yandex); frontier pages without rows as empty."""
    engines = engines or ENGINES
    res = result_fields(read_table(spark, sf_dir, "pages")).filter(F.col("query") != "")
    rows = res.withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))
    frag = F.when(F.col("engine") == engines[0], _fragment(engines[0]))
    for e in engines[1:]:
        frag = frag.when(F.col("engine") == e, _fragment(e))
    grouped = (rows.withColumn("frag", frag).groupBy("engine", "query", "run", "page")
               .agg(F.array_sort(F.collect_list(F.struct("pid", "frag", "mark"))).alias("fs")))
    inner = F.array_join(F.transform("fs", lambda x: x["frag"]), "")
    first_marked = F.col("fs")[0]["mark"]
    body = (F.when(F.col("engine") == "google_search", F.concat(F.lit(RELATED_BLOCK), inner)).otherwise(inner))
    html = F.concat(F.lit('<html><body><div id="search">'), body, F.lit("</div></body></html>"))
    html = (F.when(first_marked & F.col("engine").isin("google_search", "google_news"), F.lit(GOOGLE_BLOCK_PAGE))
            .when(first_marked & (F.col("engine") == "yandex"), F.lit(YANDEX_BLOCK_PAGE)).otherwise(html))
    final = F.when(first_marked & F.col("engine").isin("google_search", "google_news"),
                   F.lit("https://www.google.com/sorry/index")).otherwise(F.lit("https://www.google.com/search"))
    got = grouped.select("engine", "query", "run", "page", html.alias("html"), final.alias("final_url"))
    front = (res.select("query", "run").distinct()
             .withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))
             .withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages)))))
    out = front.join(got, ["engine", "query", "run", "page"], "left")
    return out.select("query", "engine", "run", "page",
                      F.coalesce("html", F.lit("<html><body></body></html>")).alias("html"),
                      F.coalesce("final_url", F.lit("https://www.google.com/search")).alias("final_url"),
                      F.to_timestamp(F.lit(FETCHED_TS)).alias("fetched_at"))
