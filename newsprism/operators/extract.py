"""Text extraction: the cascade (X1), batch fill (X2) and native extractors.

The reference calls third-party libraries per row.  Here each extractor is a
native column rule over the noise-stripped HTML, so the whole cascade is
one projection inside whole-stage codegen: ``coalesce(when(ok(x1), x1), ...)``
short-circuits natively, and the stripped HTML is computed once per row.
The rules keep the reference's contract (ordered strategies, the > 50 stripped
characters threshold, unstripped return, "" when nothing qualifies); they are
not bit-equal to the libraries, which are not available here.

A user extractor (X7) is any function ``(clean_html, region) -> Column`` (a
``pandas_udf`` included) passed in ``extractors`` with a name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.functions.html import (
    BLOCK_RE, LINK_TEXT_RE, MARK, NON_P_BLOCK_RE, P_OPEN_RE, TABLE_RE, TAG_RE,
    body_of, html_text, main_region, strip_noise,
)
from newsprism.functions.text import decode_entities, ustrip
from newsprism.operators.keyfilter import maybe_in

# Fixed value: a result counts when its stripped length is above this.
MIN_CONTENT_LENGTH = 50
# Our own block rules for the boilerplate extractor.
MIN_BLOCK_CHARS = 25
MAX_LINK_SHARE = 0.5
MIN_PARAGRAPH_WORDS = 10

# An extractor maps (noise-stripped html, main region or null) to text.
Extractor = Callable[[Column, Column], Column]


def _blocks(fragment: Column) -> Column:
    return F.split(fragment, BLOCK_RE, -1)


def boilerplate_text(clean: Column, region: Column) -> Column:
    """Main region (or body) -> blocks -> drop short and link-dense blocks; no tables."""
    area = F.regexp_replace(F.coalesce(region, body_of(clean)), TABLE_RE, " ")
    blocks = F.transform(_blocks(area), lambda b: F.struct(
        html_text(b).alias("t"),
        F.aggregate(F.regexp_extract_all(b, F.lit(LINK_TEXT_RE), 1), F.lit(0),
                    lambda acc, x: acc + F.length(html_text(x))).alias("l")))
    kept = F.filter(blocks, lambda s: (F.length(s["t"]) >= MIN_BLOCK_CHARS)
                    & (s["l"] <= F.length(s["t"]) * MAX_LINK_SHARE))
    return F.array_join(F.transform(kept, lambda s: s["t"]), "\n")


def paragraph_text(clean: Column, region: Column) -> Column:
    """Every ``<p>`` of the body up to the next block boundary; keep wordy paragraphs."""
    marked = F.regexp_replace(body_of(clean), NON_P_BLOCK_RE, MARK)
    pieces = F.slice(F.split(marked, P_OPEN_RE, -1), 2, 1 << 30)
    paras = F.transform(pieces, lambda p: html_text(F.split_part(p, F.lit(MARK), F.lit(1))))
    kept = F.filter(paras, lambda p: F.size(F.split(p, " ", -1)) >= MIN_PARAGRAPH_WORDS)
    return F.array_join(kept, "\n\n")


def reader_text(clean: Column, region: Column) -> Column:
    """Reader-mode text: region (or body) split at every tag, pieces trimmed, newline-joined."""
    area = F.coalesce(region, body_of(clean))
    pieces = F.transform(F.split(area, TAG_RE, -1), lambda p: ustrip(decode_entities(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), "\n")


def region_markdown(clean: Column, region: Column) -> Column:
    """First matching content selector, blocks as markdown paragraphs; "" without a hit."""
    blocks = F.filter(F.transform(_blocks(region), html_text), lambda t: t != "")
    return F.coalesce(F.array_join(blocks, "\n\n"), F.lit(""))


DEFAULT_EXTRACTORS: list[tuple[str, Extractor]] = [
    ("boilerplate", boilerplate_text),
    ("paragraphs", paragraph_text),
    ("reader", reader_text),
    ("region", region_markdown),
]


def viable(x: Column, min_chars: int = MIN_CONTENT_LENGTH) -> Column:
    """``x`` when its stripped length is above ``min_chars``, else null; ``x`` is evaluated once."""
    return F.try_element_at(F.filter(F.array(x), lambda v: F.length(ustrip(v)) > min_chars), F.lit(1))


def cascade_pick(clean: Column, region: Column, extractors: Sequence[tuple[str, Extractor]] = DEFAULT_EXTRACTORS,
                 min_chars: int = MIN_CONTENT_LENGTH) -> Column:
    """X1 as one struct (extractor, text): the first extractor whose stripped result is longer than
    ``min_chars`` wins, its text unstripped; both "" when none does.

    ``coalesce`` stops at the first non-null child, so later extractors only run
    for rows the earlier ones could not serve, and none runs twice.
    """
    def tried(name: str, fn: Extractor) -> Column:
        good = F.filter(F.array(fn(clean, region)), lambda v: F.length(ustrip(v)) > min_chars)
        return F.try_element_at(F.transform(good, lambda v: F.struct(F.lit(name).alias("extractor"), v.alias("text"))), F.lit(1))

    return F.coalesce(*[tried(name, fn) for name, fn in extractors],
                      F.struct(F.lit("").alias("extractor"), F.lit("").alias("text")))


def cascade(clean: Column, region: Column, extractors: Sequence[tuple[str, Extractor]] = DEFAULT_EXTRACTORS,
            min_chars: int = MIN_CONTENT_LENGTH) -> Column:
    """The winner's text, unstripped; "" when none qualifies."""
    return F.coalesce(*[viable(fn(clean, region), min_chars) for _, fn in extractors], F.lit(""))


def with_clean_html(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Noise-stripped HTML and its main region as columns, each computed once per row."""
    return (df.withColumn("_clean", strip_noise(html_col))
              .withColumn("_region", main_region(F.col("_clean"))))


def extract_text(df: DataFrame, html_col: str = "html", out: str = "article_text",
                 extractors: Sequence[tuple[str, Extractor]] = DEFAULT_EXTRACTORS) -> DataFrame:
    """Add ``out`` from ``html_col``."""
    return (with_clean_html(df, html_col)
            .withColumn(out, cascade(F.col("_clean"), F.col("_region"), extractors))
            .drop("_clean", "_region"))


def fill_article_text(articles: DataFrame, snapshots: DataFrame, extractors: Sequence[tuple[str, Extractor]] = DEFAULT_EXTRACTORS,
                      as_of: Column | None = None) -> DataFrame:
    """X2 = P8 + J4 + X1: only rows with empty text, HTML attached once per url by a left join.

    ``snapshots`` has ``url, response_body, status_code`` and may have ``fetched_at, seq, ttl_hours``;
    of the 200s one body per url is kept (the latest; without times the largest in text order), so the
    join never multiplies article rows; an empty body is none.  With ``as_of``, a url whose latest
    snapshot has expired by then gets no body.  A Bloom filter of the urls that lack a text stands
    at the scan of the snapshots: other bodies are neither sorted nor shuffled.
    """
    need = F.coalesce(F.col("article_text"), F.lit("")) == ""
    wanted = articles.where(need & F.col("url").isNotNull()).select("url")
    good = snapshots.filter(F.col("status_code") == 200)
    lives = as_of is not None and {"fetched_at", "ttl_hours"} <= set(snapshots.columns)
    parts = [c for c in ("fetched_at", "seq") if c in snapshots.columns] + (["ttl_hours"] if lives else []) + ["response_body"]
    best = maybe_in(good.select("url", *parts), wanted, ["url"]).groupBy(F.col("url").alias("_url")).agg(F.max(F.struct(*parts)).alias("_s"))
    if lives:
        best = best.where((F.unix_micros(as_of) - F.unix_micros("_s.fetched_at")) / F.lit(3_600_000_000.0) <= F.col("_s.ttl_hours"))
    html = best.select("_url", F.nullif(F.col("_s.response_body"), F.lit("")).alias("_html"))
    # Rows that have a text get a null key and so no body.
    joined = articles.withColumn("_of", F.when(need, F.col("url"))).join(html, F.col("_of") == F.col("_url"), "left")
    filled = with_clean_html(joined, "_html").withColumn("article_text", F.when(~need, F.col("article_text"))
        .when(F.col("_html").isNull(), F.lit("")).otherwise(cascade(F.col("_clean"), F.col("_region"), extractors)))
    return filled.select(*articles.columns)


__all__ = ["cascade", "cascade_pick", "extract_text", "fill_article_text", "boilerplate_text",
           "paragraph_text", "reader_text", "region_markdown", "with_clean_html"]
