"""The one-call pipeline (E4): archives -> merged articles -> D1 -> P1 -> J1/J2 -> X2 -> sinks.

Sources are functions ``(archive DataFrames, query) -> articles`` registered by
name with a rank (E1); extractors are ``Column`` functions (E2/X7); writers are
``df, path -> path`` (E3).  Every step is a DataFrame transformation; the only
driver loop is D1's rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsprism.functions.urls import decode_idn
from newsprism.operators import expand as EX
from newsprism.operators import extract as X
from newsprism.operators import select as SEL
from newsprism.operators.dedup import dedup_articles
from newsprism.plans.articles import STRATEGY_ORDER
from newsprism.sinks.files import output_stem, write_all
from newsprism.sources import metasearch as M
from newsprism.sources import serp_html as SH
from newsprism.sources.outlets import outlet_domains

SourceFn = Callable[[dict, str], DataFrame]


def _json_source(archives: dict, query: str) -> DataFrame | None:
    arch = archives.get("json")
    if arch is None:
        return None
    return M.ingest(arch.filter(F.col("query") == query))  # the run is part of the search call if the archive has it


def _html_source(engine: str) -> SourceFn:
    def run(archives: dict, query: str) -> DataFrame | None:
        arch = archives.get("html")
        if arch is None:
            return None
        return SH.to_articles(arch.filter(F.col("query") == query), SH.RULE_SETS[engine])
    return run


# Sources by name; their order in STRATEGY_ORDER is the merge order.
SOURCES: dict[str, SourceFn] = {"searxng": _json_source, "google_search": _html_source("google_search"),
                                 "google_news": _html_source("google_news"), "yandex": _html_source("yandex")}

ARTICLE_COLUMNS = ["url", "title", "source", "date", "body", "page", "position", "overall_position",
                   "article_text", "source_type", "ord"]


@dataclass
class RunConfig:
    query: str
    only_strategies: list[str] | None = None
    min_term_matches: int = 1
    strict_search: bool = False
    time_period: str | None = None
    expand_with_titles: bool = False
    outlets: DataFrame | None = None
    # Widening rows bypass the relevance filter, as in the reference; True filters them too.
    filter_widened: bool = False
    extract_articles: bool = True
    extractors: list = field(default_factory=lambda: list(X.DEFAULT_EXTRACTORS))
    as_of: Column | None = None
    max_titles_to_expand: int = EX.MAX_TITLES_TO_EXPAND
    max_chars: int | None = None
    # Output formats by name; more writers may be given by the caller.
    writers: dict = field(default_factory=dict)


def merge(archives: dict, cfg: RunConfig) -> DataFrame:
    """Search phase + U1: every allowed, available source in strategy order."""
    parts = []
    for rank, name in enumerate(STRATEGY_ORDER):
        if cfg.only_strategies and name not in cfg.only_strategies:
            continue
        df = SOURCES[name](archives, cfg.query)
        if df is None:
            continue
        parts.append((rank, df.drop("query", "engine")))
    if not parts:
        return None
    merged = EX.merge_sources(parts).select(*ARTICLE_COLUMNS, "source_from_url").checkpoint(eager=True)
    # F4 on sources taken from urls (display names are left alone); read twice, so materialised first
    return decode_idn(merged, "source", F.col("source_from_url")).drop("source_from_url")


def _observe(df: DataFrame, counters: dict | None, stage: str, with_text: bool = False) -> DataFrame:
    """A3 without an extra pass: row counts (and rows with text) ride along the next action."""
    if counters is None:
        return df
    obs = counters[stage] = Observation(stage)
    aggs = [F.count(F.lit(1)).alias("rows")]
    if with_text:
        aggs.append(F.count_if(F.coalesce(F.col("article_text"), F.lit("")) != "").alias("with_text"))
    return df.observe(obs, *aggs)


def collect_articles(archives: dict, cfg: RunConfig, out_dir: str | None = None,
                     formats: list[str] | None = None, max_pages: int = 3,
                     counters: dict | None = None) -> DataFrame:
    """The reference's run on archived data.  ``archives`` may hold ``json`` (metasearch
    pages), ``html`` (result pages), ``corpus`` (for title expansion) and ``snapshots``
    (``url, response_body, status_code``, and times where there are several per url).  Pass ``counters={}`` to get
    ``Observation`` objects per stage (found, unique, relevant, final); they are filled by
    the first action on the returned DataFrame."""
    if cfg.time_period and cfg.as_of is None:
        raise ValueError("time_period needs as_of")
    if (cfg.expand_with_titles or cfg.outlets is not None) and "corpus" not in archives:
        raise ValueError("widening needs archives['corpus']")
    arts = merge(archives, cfg)
    if arts is None:
        return None
    arts = _observe(arts, counters, "found")
    arts = _observe(dedup_articles(arts), counters, "unique")
    arts = _observe(SEL.filter_relevant(arts, cfg.query, cfg.min_term_matches), counters, "relevant")
    if cfg.strict_search:
        arts = SEL.exact_phrase(arts, cfg.query)
    if cfg.time_period:
        arts = SEL.recent(arts, cfg.time_period, cfg.as_of)
    if cfg.expand_with_titles:
        arts = EX.expand_with_titles(arts, archives["corpus"], n_titles=cfg.max_titles_to_expand)
    if cfg.outlets is not None:
        strategy = EX.first_available(STRATEGY_ORDER, [n for n in STRATEGY_ORDER
                                                       if not cfg.only_strategies or n in cfg.only_strategies])
        if strategy:
            arts = EX.search_small_media(arts, archives["corpus"], outlet_domains(cfg.outlets), cfg.query, strategy)
    if cfg.filter_widened and (cfg.expand_with_titles or cfg.outlets is not None):
        arts = SEL.filter_relevant(arts, cfg.query, cfg.min_term_matches)
    if cfg.extract_articles and "snapshots" in archives:
        arts = X.fill_article_text(arts, archives["snapshots"], cfg.extractors, cfg.as_of)  # an expired snapshot is no snapshot
    arts = _observe(arts, counters, "final", with_text=True)
    if out_dir and formats:
        write_all(arts, out_dir, output_stem(cfg.query, max_pages, cfg.time_period), formats, max_chars=cfg.max_chars, more=cfg.writers)
    return arts
