"""Sinks: CSV (S13), JSON (S14), Markdown (S15), format fan-out and run naming.

Every sink is ``write(df, path) -> path``.  Output is ordered by ``ord`` (O1):
range-partitioned on ``ord`` and sorted inside each partition, so the part files
read in name order give the list order, without funnelling rows through one task.
``single_file=True`` (small results only) writes one file.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.functions.dates import iso_format
from newsprism.functions.flags import SECTION_SEPARATOR, markdown_section

# Fixed value: sink column order.
COLUMNS = ["url", "title", "source", "date", "body", "article_text", "source_type", "page", "position",
           "overall_position"]


Writer = Callable[[DataFrame, str], str]


def _ordered(df: DataFrame, order: str, single_file: bool) -> DataFrame:
    if order not in df.columns:
        return df.coalesce(1) if single_file else df
    if single_file:
        return df.coalesce(1).sortWithinPartitions(order)
    return df.repartitionByRange(order).sortWithinPartitions(order)


def _rows(df: DataFrame) -> DataFrame:
    cols = []
    for c in COLUMNS:
        if c == "date":
            cols.append(iso_format(F.col("date")).alias("date"))
        elif c in df.columns:
            cols.append(F.col(c))
        else:
            cols.append(F.lit("").alias(c))
    return df.select(*cols, *([F.col("ord")] if "ord" in df.columns else []))


def write_csv(df: DataFrame, path: str, single_file: bool = False, order: str = "ord") -> str:
    """The ten columns with a header row (also when empty), ISO dates, UTF-8."""
    out = _ordered(_rows(df), order, single_file).drop(order) if order in df.columns else _rows(df)
    out.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str, single_file: bool = False, order: str = "ord") -> str:
    """JSON Lines, non-ASCII kept, ISO dates."""
    out = _ordered(_rows(df), order, single_file).drop(order) if order in df.columns else _rows(df)
    out.write.mode("errorifexists").json(path)
    return path


def write_markdown(df: DataFrame, path: str, max_chars: int | None = None, single_file: bool = False,
                   order: str = "ord") -> str:
    """One F14 section per article, sections separated by a rule.  Each part file holds
    consecutive sections; with ``single_file`` the whole result is one document."""
    sec = df.select(markdown_section(max_chars=max_chars).alias("value"), *([F.col(order)] if order in df.columns else []))
    out = _ordered(sec, order, single_file)
    out = out.drop(order) if order in out.columns else out
    out.write.mode("errorifexists").option("lineSep", SECTION_SEPARATOR).text(path)
    return path


def _in_order(row: Column, order: str, separator: str) -> Column:
    """All rows' texts in list order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), row.alias("row"))))
    return F.array_join(F.transform(rows, lambda r: r["row"]), separator)


def markdown_document(df: DataFrame, max_chars: int | None = None, order: str = "ord") -> Column:
    """The whole result as one markdown string (small results only): ordered listagg."""
    return _in_order(markdown_section(max_chars=max_chars), order, SECTION_SEPARATOR)


def json_document(df: DataFrame, order: str = "ord") -> Column:
    """The whole result as one JSON array (small results only), in list order."""
    row = F.to_json(F.struct(*[F.col(c) for c in COLUMNS]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("[\n"), _in_order(row, order, ",\n"), F.lit("\n]\n"))


def csv_document(df: DataFrame, order: str = "ord") -> Column:
    """The whole result as one CSV text (small results only): byte order mark, header, CRLF rows."""
    row = F.concat(F.to_csv(F.struct(*[F.col(c) for c in COLUMNS]), {"escape": '"', "emptyValue": "", "nullValue": ""}), F.lit("\r\n"))
    return F.concat(F.lit("\ufeff" + ",".join(COLUMNS) + "\r\n"), _in_order(row, order, ""))


def write_document(df: DataFrame, path: str, fmt: str, max_chars: int | None = None, order: str = "ord") -> str:
    """One document of a small result: CSV with a byte order mark, a JSON array or markdown."""
    if fmt not in EXTENSIONS:
        raise ValueError(f"unknown output format {fmt!r}; known: {sorted(EXTENSIONS)}")
    if fmt == "markdown":
        text = markdown_document(df, max_chars, order)
    else:
        text = {"csv": csv_document, "json": json_document}[fmt](_rows(df), order)
        df = _rows(df)
    df.agg(text.alias("value")).coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(path)
    return path


WRITERS: dict[str, Writer] = {"csv": write_csv, "json": write_json, "markdown": write_markdown}
EXTENSIONS = {"csv": ".csv", "json": ".json", "markdown": ".md"}


def output_stem(query: str, max_pages: int, time_period: str | None = None, at: _dt.datetime | None = None) -> str:
    """S16 run name: query with spaces as ``_`` cut to 50, time filter, pages, timestamp."""
    ts = (at or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    tp = f"_{time_period}" if time_period else ""
    return f"{query.replace(' ', '_')[:50]}{tp}_{max_pages}pages_{ts}"


def output_stem_col(query: Column, max_pages: Column, time_period: Column, at: Column) -> Column:
    """S16 as a column (for many runs at once)."""
    tp = F.when(F.coalesce(time_period, F.lit("")) != "", F.concat(F.lit("_"), time_period)).otherwise(F.lit(""))
    return F.concat(F.substring(F.replace(query, F.lit(" "), F.lit("_")), 1, 50), tp, F.lit("_"),
                    max_pages.cast("string"), F.lit("pages_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def write_all(df: DataFrame, out_dir: str, stem: str, formats: list[str], max_chars: int | None = None,
              more: dict[str, Writer] | None = None) -> list[str]:
    """Persist once, then one writer per requested format; an unknown format is an error."""
    writers = WRITERS | (more or {})
    unknown = [f for f in formats if f not in writers]
    if unknown:
        raise ValueError(f"unknown output formats {unknown}; known: {sorted(writers)}")
    df = df.persist()
    paths = []
    try:
        for fmt in formats:
            path = f"{out_dir.rstrip('/')}/{stem}{EXTENSIONS.get(fmt, '.' + fmt)}"
            if fmt == "markdown" and writers[fmt] is write_markdown:
                paths.append(write_markdown(df, path, max_chars=max_chars))
            else:
                paths.append(writers[fmt](df, path))
    finally:
        df.unpersist()
    return paths
