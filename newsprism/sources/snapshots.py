"""Page snapshots with a time to live.

Table: ``url, response_body, status_code, fetched_at timestamp, ttl_hours int``
(+ ``seq`` to break ties between writes of the same instant); last write wins per url.
Who wins is decided on narrow rows; bodies are fetched for the winners only.
``sources.store`` keeps such a table on disk, in versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.operators.keyfilter import flagged, maybe_in
from newsprism.sources.tables import read_table

SNAPSHOT_COLUMNS = ["url", "response_body", "status_code", "fetched_at", "ttl_hours", "seq"]
# Fixed value: default lifetime in hours.
DEFAULT_TTL_HOURS = 24


def age_hours(as_of: Column, fetched_at: str = "fetched_at") -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(F.col(fetched_at))) / F.lit(3_600_000_000.0)


KEY = ["url", "fetched_at", "seq"]


def newest(snapshots: DataFrame, more: list[str] = ()) -> DataFrame:
    """url, fetched_at, seq and the narrow columns ``more`` of the latest write per url (fetched_at, then
    seq).  No body is read; a url written a million times is combined map-side."""
    rest = [c for c in ("fetched_at", "seq", *more)]
    return (snapshots.groupBy("url").agg(F.max(F.struct(*rest)).alias("_s"))
            .select("url", *[F.col(f"_s.{c}").alias(c) for c in rest]))


def bodies_of(winners: DataFrame, snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the writes that ``winners`` (url, fetched_at, seq, one per url) name.

    A Bloom filter of the winners stands at the scan, so that only their bodies are shuffled.
    Writes that agree in all three keys can't be told apart: the largest in text order counts."""
    some = maybe_in(snapshots.select(*dict.fromkeys([*KEY, *columns])), winners, KEY)
    wins = winners.select(F.col("url").alias("_u"), F.col("fetched_at").alias("_t"), F.col("seq").alias("_q"))
    same = F.col("url").eqNullSafe(F.col("_u")) & F.col("fetched_at").eqNullSafe(F.col("_t")) & F.col("seq").eqNullSafe(F.col("_q"))
    payload = [c for c in columns if c != "url"]
    return (some.join(wins, same, "left_semi").groupBy("url").agg(F.max(F.struct(*payload)).alias("_s"))
            .select("url", *[F.col(f"_s.{c}").alias(c) for c in payload]))


def latest(snapshots: DataFrame) -> DataFrame:
    """S11 read side: one row per url, the latest write (fetched_at, then seq) wins."""
    return bodies_of(newest(snapshots), snapshots, SNAPSHOT_COLUMNS).select(*SNAPSHOT_COLUMNS)


def upsert(current: DataFrame, incoming: DataFrame, only_ok: bool = True) -> DataFrame:
    """``INSERT OR REPLACE`` of a batch into ``current`` (one row per url); the fetch layer only
    stores status 200.  Rows of ``current`` whose url the batch doesn't hold stay where they are."""
    if only_ok:
        incoming = incoming.filter(F.col("status_code") == 200)
    split = flagged(current.select(*SNAPSHOT_COLUMNS), incoming, ["url"])
    met = split.where("_maybe").drop("_maybe").unionByName(incoming.select(*SNAPSHOT_COLUMNS))
    return split.where("not _maybe").drop("_maybe").unionByName(latest(met))


def fresh(snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Entries whose age in hours is not above their own ttl (expiry is strict ``>``)."""
    return snapshots.filter(age_hours(as_of) <= F.col("ttl_hours"))


def expired(snapshots: DataFrame, as_of: Column) -> DataFrame:
    """The complement of ``fresh`` (what ``clear_expired`` deletes)."""
    return snapshots.filter(age_hours(as_of) > F.col("ttl_hours"))


def lookup(frontier: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """S10 as a join: each frontier url gets body/status of its fresh snapshot, or nulls."""
    hit = fresh(newest(snapshots, ["ttl_hours"]), as_of).join(frontier.select("url").distinct(), "url", "left_semi")
    return frontier.join(bodies_of(hit, snapshots, ["url", "response_body", "status_code"]), "url", "left")


def to_fetch(frontier: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """Urls with no fresh snapshot (a cache hit skips the fetch)."""
    return frontier.join(fresh(newest(snapshots, ["ttl_hours"]), as_of).select("url"), "url", "left_anti")


# --- the driver's events table as a fetch log / snapshot feed -------------------

def event_url(user_id: Column) -> Column:
    """One host per user; the port makes the log-domain rule (netloc with port) visible."""
    return F.concat(F.lit("https://u"), user_id.cast("string"), F.lit(".example.org:8443/feed"))


def event_status(event_type: Column) -> Column:
    return (F.when(event_type == "error", F.lit(403))
            .when(event_type == "signup", F.lit(301))
            .otherwise(F.lit(200)))


def events_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a write: url per user, body = props, ttl = whole hours of ``value``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(event_url(F.col("user_id")).alias("url"), F.col("props").alias("response_body"),
                     event_status(F.col("event_type")).alias("status_code"), F.col("ts").alias("fetched_at"),
                     F.floor(F.col("value")).cast("int").alias("ttl_hours"), F.col("event_id").alias("seq"))


def pages_snapshots(spark: SparkSession, sf_dir: str, fetched_at: str = "2024-01-20 00:00:00") -> DataFrame:
    """The archived ``pages`` as snapshot writes; of one url the highest page id is the latest."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("url", F.col("html").alias("response_body"), F.lit(200).alias("status_code"),
                    F.to_timestamp(F.lit(fetched_at)).alias("fetched_at"),
                    F.lit(DEFAULT_TTL_HOURS).alias("ttl_hours"), F.col("page_id").alias("seq"))
