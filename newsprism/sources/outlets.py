"""Outlet lists: header detection (S9), first quartile (A1), low visibility (P9), domains (A2).

The header is resolved from ``df.columns`` only (metadata, no data pass); the
quartile is exact and distributed (range-partitioned positions): only the two
values around the quartile position reach the driver, never the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions.urls import outlet_domain
from newsprism.operators.expand import exact_quantile
from newsprism.session import path_exists

# Header names recognised, as in the reference.
RU_VISIBILITY = ("заметность",)
RU_SOURCE = ("url статьи", "источник")
EN_VISIBILITY = "visibility"
EN_SOURCE = ("source", "url")


def resolve_outlet_columns(columns: list[str]) -> tuple[str, str] | None:
    """(source column, visibility column).  Each one by rank of rule: the last column with a Russian
    name, else the first with an English one, else its usual place; None if there are too few."""
    names = [(str(c).lower().strip(), c) for c in columns]

    def pick(russian: tuple[str, ...], english: tuple[str, ...], place: int) -> str | None:
        by_rule = [[c for n, c in reversed(names) if n in russian], [c for n, c in names if n in english], columns[place:place + 1]]
        return next((found[0] for found in by_rule if found), None)

    src = pick(RU_SOURCE, EN_SOURCE, 0)
    vis = pick(RU_VISIBILITY, (EN_VISIBILITY,), 2 if len(columns) > 2 else 1)
    return (src, vis) if src is not None and vis is not None else None


def standardize(df: DataFrame) -> DataFrame:
    """(source string, visibility double) with non-numeric visibility and null rows dropped."""
    cols = resolve_outlet_columns(df.columns)
    if cols is None:
        return df.sparkSession.createDataFrame([], "source string, visibility double")
    src, vis = cols
    out = df.select(F.col(f"`{src}`").cast("string").alias("source"),
                    F.col(f"`{vis}`").cast("string").try_cast("double").alias("visibility"))
    return out.filter(F.col("source").isNotNull() & F.col("visibility").isNotNull()
                      & ~F.isnan(F.col("visibility")))


def read_outlets(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row, all columns read as strings; a missing path gives no rows."""
    if not path_exists(spark, path):  # as the reference: a missing file is an empty list
        return spark.createDataFrame([], "source string, visibility double")
    return standardize(spark.read.option("header", True).option("inferSchema", False).csv(path))


def first_quartile(outlets: DataFrame):
    """A1: exact linear-interpolation 25th percentile (a scalar of the plan; null for an empty list)."""
    return exact_quantile(outlets, "visibility", 0.25)


def low_visibility(outlets: DataFrame) -> DataFrame:
    """Rows strictly below the first quartile."""
    return outlets.filter(F.col("visibility") < first_quartile(outlets))


def outlet_domains(outlets: DataFrame) -> DataFrame:
    """A2: distinct non-empty outlet domains of the low-visibility rows, sorted."""
    d = low_visibility(outlets).select(outlet_domain(F.col("source")).alias("domain"))
    return d.filter(F.col("domain") != "").distinct().orderBy("domain")


# --- outlet lists derived from the given tables ---------------------------------

def supplier_outlets(spark: SparkSession, sf_dir: str, header: tuple[str, str, str]) -> DataFrame:
    """An outlet list per supplier: site from the name, visibility = account balance."""
    from newsprism.sources.tables import read_table
    s = read_table(spark, sf_dir, "supplier")
    site = F.concat(F.lit("https://www."), F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))),
                    F.lit(".example.com/news"))
    return s.select(site.alias(header[0]), F.col("s_name").alias(header[1]),
                    F.col("s_acctbal").cast("string").alias(header[2]))


def page_outlets(articles: DataFrame) -> DataFrame:
    """An outlet list from the archive itself: one row per host, visibility = its page count."""
    host = F.col("source")
    return (articles.groupBy(host.alias("host")).agg(F.count(F.lit(1)).cast("double").alias("visibility"))
            .select(F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("source"), "visibility"))
