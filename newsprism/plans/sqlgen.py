"""DuckDB SQL twins of the column functions, for the oracle queries.

Each helper takes a SQL expression string and returns one.  They reuse the
regex literals of the Spark side (all RE2-safe).  Java needs ``(?iu)`` for
Unicode case folding; RE2's ``(?i)`` already folds Unicode.
"""

from __future__ import annotations

from newsprism.functions import html as H
from newsprism.functions import text as T
from newsprism.functions import urls as U
from newsprism.operators import extract as X
from newsprism.plans import articles as A


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rre(p: str) -> str:
    """Java pattern -> RE2 pattern (only the flag spelling differs)."""
    return p.replace("(?iu)", "(?i)")


def rep(e: str, pattern: str, repl: str, glob: bool = True) -> str:
    return f"regexp_replace({e}, {lit(rre(pattern))}, {lit(repl)}{', ' + lit('g') if glob else ''})"


def rx(e: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({e}, {lit(rre(pattern))}, {group})"


def rlike(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {lit(rre(pattern))})"


# --- text -------------------------------------------------------------------

def ustrip(e: str) -> str:
    return rep(e, T.STRIP_RE, "")


def collapse_ws(e: str) -> str:
    return ustrip(rep(e, T.WS_PLUS, " "))


def title_key(e: str) -> str:
    t = ustrip(f"lower(coalesce({e}, ''))")
    t = rep(t, T.title_prefix_regex(), "", glob=False)
    t = rep(t, T.title_suffix_regex(), "", glob=False)
    t = rep(t, T.NON_WORD_RE, " ")
    return collapse_ws(t)


def clean_snippet(e: str) -> str:
    return collapse_ws(rep(rep(e, T.snippet_prefix_regex(), "", glob=False), T.SNIPPET_LEAD_RE, "", glob=False))


def decode_entities(e: str) -> str:
    out = e
    for ent, ch in T.HTML_ENTITIES:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


# --- urls -------------------------------------------------------------------

def _clean_url(e: str) -> str:
    return rep(rep(f"coalesce({e}, '')", U._UNSAFE_RE, ""), U._LEAD_RE, "", glob=False)


def netloc(e: str) -> str:
    return rx(rep(_clean_url(e), U.SCHEME_RE, "", glob=False), U.NETLOC_RE, 1)


def url_path(e: str) -> str:
    rest = rep(rep(_clean_url(e), U.SCHEME_RE, "", glob=False), r"^//[^/?#]*", "", glob=False)
    path = rx(rest, r"^([^?#]*)", 1)
    return rep(path, r";[^/]*$", "", glob=False)


def url_key(e: str) -> str:
    return f"(lower({netloc(e)}) || {rep(url_path(e), r'/+$', '', glob=False)})"


def source_domain_raw(e: str) -> str:
    n = netloc(e)
    h = f"split_part({n}, ':', 1)"
    bad = f"(contains({n}, '[') <> contains({n}, ']'))"
    return f"(CASE WHEN {bad} THEN coalesce({e}, '') WHEN {h} <> '' THEN {h} ELSE {n} END)"


def outlet_domain(e: str) -> str:
    s = ustrip(f"coalesce({e}, '')")
    host = (f"(CASE WHEN contains({s}, '://') THEN coalesce(nullif({netloc(s)}, ''), {url_path(s)}) "
            f"WHEN contains({s}, '/') THEN split_part({s}, '/', 1) ELSE {s} END)")
    host = rep(f"split_part({host}, ':', 1)", r"^www\.", "", glob=False)
    return f"lower({host})"


def log_domain(e: str) -> str:
    return f"coalesce(nullif({netloc(e)}, ''), {e})"


def quote_plus(e: str) -> str:
    # DuckDB encodes space as %20 and keeps "~"; "*" is already %2A.
    return f"replace(url_encode({e}), '%20', '+')"


# --- html -------------------------------------------------------------------

def strip_noise(e: str) -> str:
    return rep(f"coalesce({e}, '')", H.noise_alternation(), " ")


def first_hit(e: str, pattern: str) -> str:
    return f"regexp_extract_all({e}, {lit(rre(pattern))}, 1)[1]"


def body_of(e: str) -> str:
    return f"coalesce({first_hit(e, H.BODY_RE)}, {e})"


def html_text(e: str) -> str:
    return collapse_ws(decode_entities(rep(e, H.TAG_RE, "")))


def main_region(e: str) -> str:
    return "coalesce(" + ", ".join(first_hit(e, H.selector_region_re(s)) for s in H.ARTICLE_SELECTORS) + ")"


def split_re(e: str, pattern: str) -> str:
    return f"regexp_split_to_array({e}, {lit(rre(pattern))})"


def boilerplate_text(clean: str, region: str) -> str:
    area = rep(f"coalesce({region}, {body_of(clean)})", H.TABLE_RE, " ")
    blocks = split_re(area, H.BLOCK_RE)
    link_len = (f"coalesce(list_sum(list_transform(regexp_extract_all(b, {lit(H.LINK_TEXT_RE)}, 1), "
                f"lambda x: length({html_text('x')}))), 0)")
    structs = f"list_transform({blocks}, lambda b: {{'t': {html_text('b')}, 'l': {link_len}}})"
    kept = (f"list_filter({structs}, lambda s: length(s.t) >= {X.MIN_BLOCK_CHARS} "
            f"AND s.l <= length(s.t) * {X.MAX_LINK_SHARE})")
    return f"array_to_string(list_transform({kept}, lambda s: s.t), chr(10))"


def paragraph_text(clean: str, region: str) -> str:
    marked = rep(body_of(clean), H.NON_P_BLOCK_RE, H.MARK)
    pieces = f"list_slice({split_re(marked, H.P_OPEN_RE)}, 2, 1073741824)"
    paras = f"list_transform({pieces}, lambda p: {html_text(f'split_part(p, {lit(H.MARK)}, 1)')})"
    kept = f"list_filter({paras}, lambda p: len(string_split(p, ' ')) >= {X.MIN_PARAGRAPH_WORDS})"
    return f"array_to_string({kept}, chr(10) || chr(10))"


def reader_text(clean: str, region: str) -> str:
    area = f"coalesce({region}, {body_of(clean)})"
    pieces = f"list_transform({split_re(area, H.TAG_RE)}, lambda p: {ustrip(decode_entities('p'))})"
    return f"array_to_string(list_filter({pieces}, lambda p: p <> ''), chr(10))"


def region_markdown(clean: str, region: str) -> str:
    blocks = f"list_filter(list_transform({split_re(region, H.BLOCK_RE)}, lambda b: {html_text('b')}), lambda t: t <> '')"
    return f"coalesce(array_to_string({blocks}, chr(10) || chr(10)), '')"


SQL_EXTRACTORS = [("boilerplate", boilerplate_text), ("paragraphs", paragraph_text),
                  ("reader", reader_text), ("region", region_markdown)]


def viable(x: str, min_chars: int = X.MIN_CONTENT_LENGTH) -> str:
    return f"list_filter([{x}], lambda v: length({ustrip('v')}) > {min_chars})[1]"


def cascade(clean: str, region: str, min_chars: int = X.MIN_CONTENT_LENGTH) -> str:
    return "coalesce(" + ", ".join(viable(fn(clean, region), min_chars) for _, fn in SQL_EXTRACTORS) + ", '')"


def cascade_winner(clean: str, region: str, min_chars: int = X.MIN_CONTENT_LENGTH) -> str:
    tries = ", ".join(f"CASE WHEN {viable(fn(clean, region), min_chars)} IS NOT NULL THEN {lit(name)} END"
                      for name, fn in SQL_EXTRACTORS)
    return f"coalesce({tries}, '')"


def clean_html_sql(html: str = "html") -> str:
    """Columns c (noise-stripped html) and r (main region) for a FROM-less select list."""
    return f"{strip_noise(html)} AS c"


# --- articles from pages ----------------------------------------------------

def page_title(html: str) -> str:
    return collapse_ws(decode_entities(rep(rx(html, A.TITLE_RE, 1), r"<[^>]*>", "")))


def first_paragraph(html: str) -> str:
    first = rx(strip_noise(html), H.FIRST_P_RE, 1)
    return collapse_ws(decode_entities(rep(first, r"<[^>]*>", "")))


def pages_articles_sql(as_of: str = "2024-02-01 00:00:00", with_html: bool = False) -> str:
    body = clean_snippet(first_paragraph('html'))
    rank = "(CASE WHEN starts_with(url, 'https:') THEN 0 ELSE 1 END)"
    return f"""SELECT url, {page_title('html')} AS title, {source_domain_raw('url')} AS source,
  TIMESTAMP '{as_of}' AS date, {body} AS body,
  CAST(page_id // {A.RESULTS_PER_PAGE} + 1 AS BIGINT) AS page,
  CAST(page_id % {A.RESULTS_PER_PAGE} + 1 AS INTEGER) AS position,
  CAST(page_id + 1 AS BIGINT) AS overall_position, '' AS article_text,
  CASE WHEN starts_with(url, 'https:') THEN 'searxng' ELSE 'google_search' END AS source_type,
  CAST({rank} * 4294967296 + page_id AS BIGINT) AS ord{', html' if with_html else ''}
FROM pages"""


def iso_format(e: str) -> str:
    frac = f"(epoch_us({e}) % 1000000 + 1000000) % 1000000"
    base = f"strftime({e}, '%Y-%m-%dT%H:%M:%S')"
    return f"(CASE WHEN {frac} = 0 THEN {base} ELSE {base} || '.' || lpad(CAST({frac} AS VARCHAR), 6, '0') END)"


def greedy_dedup_sql(src: str, order: str = "ord") -> str:
    """Sequential first-wins scan over (ord, tkey, ukey) as a recursive CTE (small inputs only)."""
    return f"""WITH RECURSIVE k AS (
  SELECT row_number() OVER (ORDER BY {order}) AS rn, {order} AS o, tkey, ukey FROM ({src})
), walk(rn, tks, uks, kept) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
  UNION ALL
  SELECT k.rn,
    CASE WHEN list_contains(w.tks, k.tkey) OR list_contains(w.uks, k.ukey) THEN w.tks ELSE list_append(w.tks, k.tkey) END,
    CASE WHEN list_contains(w.tks, k.tkey) OR list_contains(w.uks, k.ukey) THEN w.uks ELSE list_append(w.uks, k.ukey) END,
    CASE WHEN list_contains(w.tks, k.tkey) OR list_contains(w.uks, k.ukey) THEN w.kept ELSE list_append(w.kept, k.o) END
  FROM walk w JOIN k ON k.rn = w.rn + 1
)
SELECT unnest(kept) AS {order} FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1)"""

