"""HTML column functions used by the text extractors and the page parsers.

All of it is regex over the ``html`` column, evaluated by the JVM.  Patterns are
lazy and un-nested (no catastrophic backtracking on long pages) and RE2-safe,
so the DuckDB oracle uses the very same literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsprism.functions.text import col_, collapse_ws, decode_entities

# Tags removed before extraction (the reference's excluded tags), plus comments.
NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside"]
COMMENT_RE = r"(?s)<!--.*?-->"


def noise_re(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"


# Main-content selectors, in the reference's order.
ARTICLE_SELECTORS = [
    "article", "main", '[role="main"]', ".post-content", ".article-content", ".article-body",
    ".entry-content", ".story-body", "#article-body", ".content-body",
]


def selector_region_re(sel: str) -> str:
    """Region regex for one selector.  Class/id/role selectors are looked up on ``div``,
    ``section`` and ``main`` elements and end at the first matching close tag."""
    if sel[0].isalpha():
        return rf"(?is)<{sel}\b[^>]*>(.*?)</{sel}\s*>"
    q = "[\"']"
    if sel.startswith("[role="):
        attr = rf"\brole\s*=\s*{q}?main{q}?"
    elif sel.startswith("."):
        attr = rf"\bclass\s*=\s*{q}[^\"']*\b{sel[1:]}\b[^\"']*{q}"
    else:
        attr = rf"\bid\s*=\s*{q}?{sel[1:]}{q}?"
    return rf"(?is)<(?:div|section|main)\b[^>]*{attr}[^>]*>(.*?)</(?:div|section|main)\s*>"


BODY_RE = r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)"
BLOCK_TAGS = "p|div|h[1-6]|li|ul|ol|br|section|article|blockquote|tr|td|th|table|pre|figure|figcaption|main|dd|dt|hr"
BLOCK_RE = rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>"
NON_P_BLOCK_RE = rf"(?i)</p\s*>|</?(?:{BLOCK_TAGS.replace('p|', '', 1)})\b[^>]*>"
P_OPEN_RE = r"(?i)<p\b[^>]*>"
# First paragraph: from the first <p> up to the next block boundary, </p>, <p> or the end.
FIRST_P_RE = (r"(?is)<p\b[^>]*>(.*?)(?:</p\s*>|</?(?:" + BLOCK_TAGS.replace("p|", "", 1)
              + r")\b[^>]*>|<p\b[^>]*>|\z)")
TAG_RE = r"<[^>]*>"
LINK_TEXT_RE = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
TABLE_RE = r"(?is)<table\b[^>]*>.*?</table\s*>"
MARK = "\u0001"


def noise_alternation() -> str:
    """Comments and the noise elements in one alternation: one pass over the page.

    At each position the earliest-starting noise region is removed; a region
    overlapping an earlier one is left to what remains (our stated rule for
    malformed nesting).
    """
    # every alternative starts with "<": factored out, the alternation is only tried there
    parts = [COMMENT_RE.replace("(?s)<", "")] + [noise_re(t).replace("(?is)<", "") for t in NOISE_TAGS]
    return "(?is)<(?:" + "|".join(parts) + ")"


def strip_noise(html) -> Column:
    return F.regexp_replace(F.coalesce(col_(html), F.lit("")), noise_alternation(), " ")


def first_hit(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without a match (one regex pass, one reference)."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), 1), F.lit(1))


def body_of(clean) -> Column:
    c = col_(clean)
    return F.coalesce(first_hit(c, BODY_RE), c)


def html_text(fragment) -> Column:
    """Text of a fragment: inline tags dropped, entities decoded, whitespace collapsed."""
    return collapse_ws(decode_entities(F.regexp_replace(col_(fragment), TAG_RE, "")))


def main_region(clean) -> Column:
    """X3 region: content of the first selector with a hit, else null."""
    c = col_(clean)
    return F.coalesce(*[first_hit(c, selector_region_re(s)) for s in ARTICLE_SELECTORS])
