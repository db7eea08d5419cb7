"""Registered queries for sinks and extension points: write the article table, read it back
(S13-S15, O1, E2, E3, X7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions.flags import SECTION_SEPARATOR
from newsprism.operators import extract as X
from newsprism.plans import sqlgen as S
from newsprism.plans.articles import pages_articles
from newsprism.plans.catalog import register
from newsprism.plans.queries_core import ART, CLEAN_PAGES
from newsprism.session import scratch_path
from newsprism.sinks import files as K
from newsprism.sources.tables import read_table

_COLS = "url, title, source, " + S.iso_format("date") + " AS date, body, article_text, source_type, page, position, overall_position"
_TEXT = f"SELECT url, title, source, date, coalesce(body, '') AS body, coalesce(article_text, '') AS article_text, source_type, page, position, overall_position FROM (SELECT {_COLS} FROM ({ART}))"


def _back(df: DataFrame) -> DataFrame:
    """Read-back rows with the sink's columns; an empty field of a text sink is the empty text."""
    number = {"page": "bigint", "position": "int", "overall_position": "bigint"}
    return df.select(*[F.col(c).cast(number[c]).alias(c) if c in number else F.coalesce(F.col(c), F.lit("")).alias(c) for c in K.COLUMNS])


def s13_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = K.write_csv(pages_articles(spark, sf_dir), scratch_path(spark, "csv"))
    return _back(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path))


register("s13_csv_sink", _TEXT)(s13_csv_sink)


def s14_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = K.write_json(pages_articles(spark, sf_dir), scratch_path(spark, "json"))
    return _back(spark.read.schema(", ".join(f"{c} string" for c in K.COLUMNS)).json(path))


register("s14_json_sink", _TEXT)(s14_json_sink)


def s15_markdown_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces between rules of the written files: a head and a text per section."""
    path = K.write_markdown(pages_articles(spark, sf_dir), scratch_path(spark, "md"))
    sections = spark.read.option("lineSep", SECTION_SEPARATOR).text(path)
    return sections.select(F.col("value").alias("md"))


register("s15_markdown_sink", f"""SELECT article_text AS md FROM ({ART}) UNION ALL SELECT '# ' || title || chr(10) || chr(10) || '- **Source:** ' || source
  || chr(10) || '- **URL:** ' || url || chr(10) || '- **Date:** ' || {S.iso_format('date')}
  || CASE WHEN body <> '' THEN chr(10) || '- **Snippet:** ' || body ELSE '' END AS md FROM ({ART})""")(s15_markdown_sink)


def o1_stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order across part files: the first and last place of each file must not overlap the next one's."""
    path = K.write_json(pages_articles(spark, sf_dir), scratch_path(spark, "order"))
    rows = spark.read.schema("overall_position bigint, source_type string").json(path).select(
        F.input_file_name().alias("f"), "overall_position", "source_type")
    rank = F.when(F.col("source_type") == "searxng", 0).otherwise(1)
    per = rows.select("f", F.struct(rank.alias("s"), "overall_position").alias("at")).groupBy("f").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    files = per.groupBy(F.lit(1).alias("k")).agg(F.array_sort(F.collect_list(F.struct("f", "lo", "hi", "n"))).alias("fs"))  # one row per part file
    good = F.when(F.size("fs") < 2, F.lit(True)).otherwise(
        F.forall(F.sequence(F.lit(1), F.size("fs") - 1), lambda i: F.col("fs")[i - 1]["hi"] < F.col("fs")[i]["lo"]))
    return files.select(good.alias("ordered"), F.aggregate("fs", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_rows"))


register("o1_stable_order", "SELECT true AS ordered, count(*) AS n_rows FROM pages")(o1_stable_order)


def first_heading(clean: Column, region: Column) -> Column:
    """An extractor of a caller: the first heading of the page."""
    return F.regexp_extract(clean, r"(?is)<h1[^>]*>([^<]*)</h1>", 1)


def x7_custom_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractor given by the caller runs before the built-in ones."""
    pages = X.with_clean_html(read_table(spark, sf_dir, "pages"))
    own = [("heading", first_heading), *X.DEFAULT_EXTRACTORS]
    return pages.select("page_id", X.cascade_pick(F.col("_clean"), F.col("_region"), own).alias("x")).select(
        "page_id", "x.extractor", F.length("x.text").alias("chars"))


_H = "regexp_extract(c, '(?is)<h1[^>]*>([^<]*)</h1>', 1)"
register("x7_custom_extractor", f"""SELECT page_id, CASE WHEN {S.viable(_H)} IS NOT NULL THEN 'heading' ELSE {S.cascade_winner('c', 'r')} END AS extractor,
  CAST(length(coalesce({S.viable(_H)}, {S.cascade('c', 'r')})) AS INTEGER) AS chars FROM ({CLEAN_PAGES})""")(x7_custom_extractor)
