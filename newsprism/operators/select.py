"""Row selection: relevance, source, phrase, recency, text-missing, low visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.functions.text import col_

# Fixed value: query terms shorter than this are ignored.
MIN_TERM_CHARS = 3
# Recency codes and their spans.
RECENCY = {"h": "1 hour", "d": "1 day", "w": "7 days", "m": "1 month"}


def query_terms(query: str) -> list[str]:
    """Whitespace split, raw length >= 3, lowered; duplicates are kept and each counts."""
    return [t.lower() for t in (query or "").split() if len(t) >= MIN_TERM_CHARS]


def haystack(title="title", body="body") -> Column:
    return F.lower(F.concat(F.coalesce(col_(title), F.lit("")), F.lit(" "), F.coalesce(col_(body), F.lit(""))))


def term_hits(terms: list[str], title="title", body="body") -> Column:
    """Number of terms (duplicates counted) contained in the haystack; plain arithmetic,
    so it stays in generated code and the haystack is shared by CSE in projections."""
    if not terms:
        return F.lit(0)
    hay = haystack(title, body)
    out = F.lit(0)
    for t in terms:
        out = out + F.when(F.contains(hay, F.lit(t)), F.lit(1)).otherwise(F.lit(0))
    return out


def filter_relevant(df: DataFrame, query: str, min_term_matches: int = 1) -> DataFrame:
    """Keep rows whose lower(title + ' ' + body) contains >= ``min_term_matches`` terms."""
    terms = query_terms(query)
    if not terms:
        return df
    return df.filter(term_hits(terms) >= min_term_matches)


def filter_sources(df: DataFrame, only: list[str] | None, col: str = "source_type") -> DataFrame:
    """P5: empty or missing list keeps everything."""
    return df.filter(F.col(col).isin(list(only))) if only else df


def exact_phrase(df: DataFrame, phrase: str) -> DataFrame:
    """The whole phrase (quotes removed) occurs in title or body, case-insensitive."""
    p = phrase.strip()
    if len(p) >= 2 and p.startswith('"') and p.endswith('"'):
        p = p[1:-1]
    return df.filter(F.contains(haystack(), F.lower(F.lit(p))))


def recent(df: DataFrame, period: str | None, as_of, date_col: str = "date") -> DataFrame:
    """``date >= as_of - span``; no period keeps everything."""
    if not period:
        return df
    span = RECENCY[period]
    return df.filter(F.col(date_col) >= as_of - F.expr(f"INTERVAL {span}"))


def needs_text(df: DataFrame, col: str = "article_text") -> DataFrame:
    """P8."""
    return df.filter(F.coalesce(F.col(col), F.lit("")) == "")


def min_title_length(df: DataFrame, n: int = 10, col: str = "title") -> DataFrame:
    """P2 (fixed value 10)."""
    return df.filter(F.length(F.coalesce(F.col(col), F.lit(""))) >= n)
