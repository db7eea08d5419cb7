"""Date column functions.

``as_of`` replaces the wall clock of the reference: it is a timestamp column or
literal supplied by the caller (fetch time of the page, or a run parameter), so
results are reproducible.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsprism.functions.text import WS, col_, ustrip

# ---------------------------------------------------------------------------
# Russian relative-time tokens and their English replacements,
# as in the reference's table.  Applied longest first (no token of this table
# overlaps another, so one pass per token equals the single alternation pass).
# ---------------------------------------------------------------------------
RUSSIAN_TOKENS = {
    "час": "hour", "часа": "hour", "часов": "hour",
    "минута": "minute", "минуты": "minute", "минут": "minute",
    "день": "day", "дня": "day", "дней": "day",
    "неделя": "week", "недели": "week", "недель": "week", "неделю": "week",
    "назад": "ago",
}
RU_ORDER = sorted(RUSSIAN_TOKENS, key=len, reverse=True)

RELATIVE_RE = rf"(?i)([0-9]+){WS}+(hour|minute|day|week)s?{WS}+ago"
_UNIT_MICROS = {"hour": 3_600_000_000, "minute": 60_000_000, "day": 86_400_000_000, "week": 604_800_000_000}

# The absolute formats, in the reference's order, as Spark patterns.
# %z takes "Z" and "+03:00" (XXX) and "+0300" (xx); the third reference format
# ("...%SZ") is unreachable because %z already takes "Z".
ABSOLUTE_FORMATS = [
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d'T'H:m:sxx",
    "yyyy-M-d'T'H:m:s",
    "MMM d, yyyy",
    "d MMM yyyy",
    "yyyy-M-d",
    "d.M.yyyy",
    "yyyy/M/d",
    "MMMM d, yyyy",
    "d MMMM yyyy",
]


def translate_russian(c) -> Column:
    out = col_(c)
    for tok in RU_ORDER:
        out = F.replace(out, F.lit(tok), F.lit(RUSSIAN_TOKENS[tok]))
    return out


def relative_date(text, as_of) -> Column:
    """first ``N unit(s) ago`` anywhere in the (translated) text, else null."""
    t = col_(text)
    amount = F.regexp_extract(t, RELATIVE_RE, 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(t, RELATIVE_RE, 2))
    per = (F.when(unit == "hour", F.lit(_UNIT_MICROS["hour"]))
           .when(unit == "minute", F.lit(_UNIT_MICROS["minute"]))
           .when(unit == "day", F.lit(_UNIT_MICROS["day"]))
           .otherwise(F.lit(_UNIT_MICROS["week"])))
    back = F.try_multiply(amount, per)
    micros = F.try_subtract(F.unix_micros(col_(as_of)), back)
    # Beyond year 1 Python raises; we fall back to as_of (stated difference).
    ok = micros >= F.lit(-62135596800000000)
    return F.when(t.rlike(RELATIVE_RE) & ok, F.timestamp_micros(micros))


# Necessary shapes of the formats above (same order).  A format is only tried when its
# shape matches: a failed parse costs an exception inside the parser, a regex test does not.
FORMAT_SHAPES = [
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T.*[Zz0-9]$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T.*[0-9]$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T",
    r"^\p{L}+ [0-9]{1,2}, [0-9]",
    r"^[0-9]{1,2} \p{L}+ [0-9]",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$",
    r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]",
    r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$",
    r"^\p{L}+ [0-9]{1,2}, [0-9]",
    r"^[0-9]{1,2} \p{L}+ [0-9]",
]


def absolute_date(text) -> Column:
    """F8: the first format that parses the whole stripped text."""
    t = col_(text)
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt)))
                        for fmt, shape in zip(ABSOLUTE_FORMATS, FORMAT_SHAPES)])


def parse_date(text, as_of) -> Column:
    """relative -> absolute -> as_of; empty or blank -> as_of."""
    raw = col_(text)
    s = ustrip(F.coalesce(raw, F.lit("")))
    tr = translate_russian(s)
    return F.when(s == "", col_(as_of)).otherwise(F.coalesce(relative_date(tr, as_of), absolute_date(tr), col_(as_of)))


def iso_format(ts) -> Column:
    """F16: ``datetime.isoformat()`` of a naive UTC value (fraction only when non-zero)."""
    t = col_(ts)
    frac = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(frac == 0, base).otherwise(F.concat(base, F.lit("."), F.lpad(frac.cast("string"), 6, "0")))


def as_of_lit(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.to_timestamp(F.lit(value))
    if isinstance(value, _dt.datetime):
        return F.lit(value).cast("timestamp")
    raise TypeError("as_of must be a Column, ISO string or datetime")
