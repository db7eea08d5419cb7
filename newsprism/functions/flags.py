"""Fetch-response flags (F11) and markdown formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsprism.functions.dates import iso_format
from newsprism.functions.text import any_phrase, col_

# Anti-bot challenge indicators of the fetch layer (matched case-insensitively).
BLOCKED_INDICATORS = [
    "Attention Required", "Please Wait", "cf-browser-verification", "Just a moment", "Checking your browser",
    "Enable JavaScript and cookies to continue", "Verify you are human", "Access denied",
    "cf-challenge-running", "ray ID",
]


def looks_blocked(text, headers) -> Column:
    """a challenge phrase in the body; never for an empty body or a JSON content type
    (header name matched case-insensitively)."""
    t = F.coalesce(col_(text), F.lit(""))
    h = col_(headers)
    json_ct = F.exists(F.map_entries(F.coalesce(h, F.create_map().cast("map<string,string>"))),
                       lambda e: (F.lower(e["key"]) == "content-type") & F.contains(F.lower(e["value"]), F.lit("application/json")))
    return (t != "") & ~json_ct & any_phrase(t, [p.lower() for p in BLOCKED_INDICATORS])


def fetch_blocked(status, text, headers) -> Column:
    """The fetch layer's rule: blocked when the status is 403 or the body looks blocked."""
    return (col_(status) == 403) | looks_blocked(text, headers)


def truncate_text(text, max_chars: int | None) -> Column:
    """longer than ``max_chars`` -> cut and mark; ``None`` or 0 switches it off."""
    t = F.coalesce(col_(text), F.lit(""))
    if not max_chars:
        return t
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit("\n\n[truncated]"))).otherwise(t)


def markdown_section(title="title", source="source", url="url", date="date", body="body",
                     text="article_text", max_chars: int | None = None) -> Column:
    """one article as markdown (snippet line only when the snippet is non-empty)."""
    d = F.coalesce(iso_format(col_(date)), F.lit(""))
    b = F.coalesce(col_(body), F.lit(""))
    head = F.concat(F.lit("# "), F.coalesce(col_(title), F.lit("")), F.lit("\n\n- **Source:** "),
                    F.coalesce(col_(source), F.lit("")), F.lit("\n- **URL:** "), F.coalesce(col_(url), F.lit("")),
                    F.lit("\n- **Date:** "), d)
    snip = F.when(b != "", F.concat(F.lit("\n- **Snippet:** "), b)).otherwise(F.lit(""))
    return F.concat(head, snip, F.lit("\n\n---\n\n"), truncate_text(text, max_chars))


SECTION_SEPARATOR = "\n\n---\n\n"
