"""Text column functions: Unicode strip, title key (F1), snippet cleaning (F7), HTML entities.

Everything here returns a native ``Column`` expression so that it stays inside
whole-stage codegen.  Regexes are written so that the same literal also runs on
RE2 (no look-around, no back references, no ``(?U)`` which RE2 reads as
"ungreedy"); the oracle SQL reuses the constants below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, spelled out so Java and RE2 agree on it.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
WS_PLUS = WS + "+"
STRIP_RE = "^" + WS_PLUS + "|" + WS_PLUS + "$"
# Python's [^\w\s] on str: anything that is not a letter, number, underscore or whitespace.
NON_WORD_RE = r"[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"

_REGEX_SPECIAL = set(".^$*+?()[]{}|\\/")


def rx_escape(s: str) -> str:
    """Escape a literal for both Java regex and RE2 (punctuation only, never letters)."""
    return "".join("\\" + ch if ch in _REGEX_SPECIAL else ch for ch in s)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace); Spark ``trim`` only drops spaces."""
    return F.regexp_replace(col_(c), STRIP_RE, "")


def collapse_ws(c) -> Column:
    """``re.sub(r"\\s+", " ", s).strip()``."""
    return ustrip(F.regexp_replace(col_(c), WS_PLUS, " "))


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (title-key rule lists), in list order.
# ---------------------------------------------------------------------------
TITLE_PREFIXES = [
    "breaking:", "update:", "latest:",
    "срочно:", "обновление:", "новости:",
    "news:", "видео:", "video:", "фото:", "photo:",
]
TITLE_SUFFIXES = [
    "- lenta.ru", "- ria.ru", "- tass.ru", "- rt.com",
    "| новости", "| news", "- новости", "- news",
]


def title_prefix_regex() -> str:
    # Each prefix is tested once, in list order, and the text is stripped after a hit:
    # a chain of optional groups in list order is exactly that scan.
    return "^" + "".join(f"(?:{rx_escape(p)}{WS}*)?" for p in TITLE_PREFIXES)


def title_suffix_regex() -> str:
    # Suffix i is removed before suffix j>i, so in the text the later list entries sit
    # further left: optional groups in reverse list order, anchored at the end.
    return "".join(f"(?:{WS}*{rx_escape(s)})?" for s in reversed(TITLE_SUFFIXES)) + "$"


def title_key(title) -> Column:
    """normalised title used as the first dedup key."""
    t = ustrip(F.lower(F.coalesce(col_(title), F.lit(""))))
    t = F.regexp_replace(t, title_prefix_regex(), "")
    t = F.regexp_replace(t, title_suffix_regex(), "")
    t = F.regexp_replace(t, NON_WORD_RE, " ")
    return collapse_ws(t)


# ---------------------------------------------------------------------------
# Snippet date-prefix patterns, in the reference's order
# (RU short months, RU full months, EN short months, RU relative, EN relative).
# ``\s`` of the original is written as WS, ``\d`` as \p{Nd}.
# ---------------------------------------------------------------------------
_D = r"\p{Nd}"
SNIPPET_DATE_PREFIXES = [
    rf"^{_D}{{1,2}}{WS}+(янв|фев|мар|апр|май|июн|июл|авг|сен|окт|ноя|дек)\.?{WS}+{_D}{{4}}{WS}+г\.?{WS}*[—\-]{WS}*",
    rf"^{_D}{{1,2}}{WS}+(января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря){WS}+{_D}{{4}}{WS}+г\.?{WS}*[—\-]{WS}*",
    rf"^{_D}{{1,2}}{WS}+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?{WS}+{_D}{{4}}{WS}*[—\-]{WS}*",
    rf"^{_D}+{WS}+(час|часа|часов|минут|минуты|минута|день|дня|дней|неделю|недели|недель|месяц|месяца|месяцев){WS}+назад{WS}*[—\-]{WS}*",
    rf"^{_D}+{WS}+(hour|hours|minute|minutes|day|days|week|weeks|month|months){WS}+ago{WS}*[—\-]{WS}*",
]
SNIPPET_LEAD_RE = r"^[\-—.,;:\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]+"


def snippet_prefix_regex() -> str:
    # "The first pattern that changes the text" == the first alternative that matches at ^.
    return "(?iu)^(?:" + "|".join(p[1:] for p in SNIPPET_DATE_PREFIXES) + ")"


def clean_snippet(text) -> Column:
    """drop the first date prefix that matches, leading punctuation, extra whitespace.

    Written so that ``text`` is referenced once (no duplicated work when a filter
    on the result is pushed below the projection); "" and null pass through.
    """
    return collapse_ws(F.regexp_replace(F.regexp_replace(col_(text), snippet_prefix_regex(), ""), SNIPPET_LEAD_RE, ""))


# ---------------------------------------------------------------------------
# The HTML entities decoded when text is taken from markup;
# ``&amp;`` goes last so that ``&amp;lt;`` stays ``&lt;``.
# ---------------------------------------------------------------------------
HTML_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"),
]


def decode_entities(c) -> Column:
    out = col_(c)
    for ent, ch in HTML_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def strip_tags(c) -> Column:
    """Replace every tag by a space (text content of a fragment)."""
    return F.regexp_replace(col_(c), r"<[^>]*>", " ")


def any_phrase(text, phrases: list[str]) -> Column:
    """Whether the text, lower-cased once, holds one of the (lower-case) phrases."""
    low = F.array(F.lower(F.coalesce(col_(text), F.lit(""))))
    return F.exists(low, lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in phrases]))
