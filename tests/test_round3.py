"""Versioned store, late materialisation, mergeable stream state."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from newsprism.operators import extract as X
from newsprism.operators import fetchlog as FL
from newsprism.operators.keyfilter import flagged, maybe_in
from newsprism.plans import queries_core, queries_state
from newsprism.sources import snapshots as SN
from newsprism.sources import store as ST
from newsprism.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
SNAPS = "url string, response_body string, status_code int, fetched_at timestamp, ttl_hours int, seq bigint"


def snaps(spark, rows):
    """rows: (url, body, hours after T0, ttl, seq[, status])."""
    return spark.createDataFrame([(u, b, r[0] if r else 200, T0 + dt.timedelta(hours=h), ttl, q) for u, b, h, ttl, q, *r in rows], SNAPS)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


# --- key filter and late materialisation ---------------------------------------------------------

def test_key_filter_passes_all_members_and_few_others(spark):
    rows = spark.range(20000).selectExpr("concat('u', id) AS url", "id")
    some = rows.where("id % 40 = 0").unionByName(spark.createDataFrame([(None, -1)], "url string, id long"))
    passed = {r.id for r in maybe_in(rows, some, ["url"]).collect()}
    assert {i for i in range(0, 20000, 40)} <= passed and len(passed) < 520
    assert flagged(rows, some, ["url"]).where("_maybe").count() == len(passed)
    assert maybe_in(rows, some.limit(0), ["url"]).count() == 0
    assert maybe_in(some, some, ["url"]).where("url IS NULL").count() == 1       # a null key is a key


def test_latest_with_ties_nulls_and_many_versions(spark):
    rows = [("u", f"b{i}", i % 50, 24, i) for i in range(500)] + [("v", "x", 1, 24, 1), ("v", "y", 1, 24, 1), (None, "n", 1, 24, 1), ("w", None, 1, 24, 1)]
    got = {r.url: r.response_body for r in SN.latest(snaps(spark, rows)).collect()}
    assert got == {"u": "b499", "v": "y", None: "n", "w": None}
    assert SN.latest(snaps(spark, rows).limit(0)).count() == 0


def test_upsert_leaves_rows_the_batch_does_not_meet(spark):
    cur = snaps(spark, [("a", "1", 1, 24, 1), ("b", "1", 1, 24, 2), ("c", "late", 9, 24, 3)])
    new = snaps(spark, [("b", "2", 2, 24, 4), ("b", "3", 3, 24, 5), ("c", "older", 2, 24, 6), ("d", "1", 2, 24, 7), ("a", "no", 3, 24, 8, 500)])
    got = sorted((r.url, r.response_body) for r in SN.upsert(cur, new).collect())
    assert got == [("a", "1"), ("b", "3"), ("c", "late"), ("d", "1")]


def shuffled_columns(executed):
    """The columns that each exchange by a key or range carries."""
    for line in executed.splitlines():
        if re.search(r"Exchange (hash|range)partitioning", line):
            yield line


def test_frontier_and_expiry_read_no_body(spark):
    store = snaps(spark, [("a", "1", 1, 24, 1)])
    path = spark.sparkContext.getCheckpointDir() + "/plan-snaps"
    store.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    for df in (SN.to_fetch(table.select("url").distinct(), table, F.lit(T0)), SN.fresh(SN.newest(table, ["ttl_hours"]), F.lit(T0))):
        assert "response_body" not in plan(df)[1].split("Location")[0] and "response_body" not in "".join(re.findall(r"ReadSchema: \S+", plan(df)[1]))


def test_bodies_pass_the_filter_before_any_exchange(spark):
    """Below every sort and aggregate of a body stands the broadcast join with the filter."""
    path = spark.sparkContext.getCheckpointDir() + "/plan-bodies"
    snaps(spark, [(f"u{i}", "<p>" + "word " * 30, 1, 24, i) for i in range(50)]).write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    arts = spark.createDataFrame([("u1", "", 1), ("u2", "has one", 2)], "url string, article_text string, ord long")
    for df in (X.fill_article_text(arts, table), SN.lookup(arts.select("url"), table, F.lit(T0))):
        text = plan(df)[1].split("Initial Plan")[0] if "Initial Plan" in plan(df)[1] else plan(df)[1]
        lines = text.splitlines()
        scans = [i for i, line in enumerate(lines) if "FileScan" in line and "response_body" in line.split("Batched")[0]]
        assert scans
        for i in scans:
            depth = len(re.match(r"[\s:|+\-]*", lines[i]).group())
            above = []
            for line in reversed(lines[:i]):
                d = len(re.match(r"[\s:|+\-]*", line).group())
                if d < depth:
                    above.append(line)
                    depth = d
            names = [re.sub(r"^[\s:|+\-*()0-9]*", "", a).split(" ")[0] for a in above]
            first = next(n for n in names if n in ("Exchange", "Sort", "SortAggregate", "BroadcastHashJoin", "HashAggregate", "ObjectHashAggregate"))
            assert first == "BroadcastHashJoin", names


def test_expired_latest_snapshot_gives_no_text_even_if_an_older_one_lives(spark):
    page = "<html><body><article><p>" + "word " * 40 + "</p></article></body></html>"
    arts = spark.createDataFrame([("u", "")], "url string, article_text string")
    table = snaps(spark, [("u", page, 0, 1000, 1), ("u", page, 1, 1, 2)])
    at = lambda h: F.lit(T0 + dt.timedelta(hours=h))
    assert X.fill_article_text(arts, table, as_of=at(2)).first().article_text != ""
    assert X.fill_article_text(arts, table, as_of=at(3)).first().article_text == ""
    assert X.fill_article_text(arts, snaps(spark, [("u", page, 0, 24, 1), ("u", "", 1, 24, 2)])).first().article_text == ""


# --- the store -----------------------------------------------------------------------------------------

def test_put_expire_purge_and_counts(spark, tmp_path):
    store = ST.snapshot_store(spark, str(tmp_path / "s"), SN_SCHEMA(spark), 8)
    assert (store.size(), store.read().count(), store.versions()) == (0, 0, [])
    ST.put(store, snaps(spark, [("fresh", "f", 5, 2, 1), ("old", "o", 0, 1, 2), ("old", "o0", -1, 100, 3), ("bad", "x", 0, 1, 4, 500)]))
    assert store.size() == 2 == store.read().count()
    assert ST.expire(store, F.lit(T0 + dt.timedelta(hours=6))) == 1
    assert [r.url for r in store.read().collect()] == ["fresh"] and store.size() == 1
    assert ST.expire(store, F.lit(T0 + dt.timedelta(hours=6))) == 0
    assert ST.purge(store) == 1 and store.size() == 0 and store.read().count() == 0 and ST.purge(store) == 0
    assert store.read(1).count() == 2                                       # an older version can still be read
    ST.put(store, snaps(spark, [("fresh", "Привет", 5, 2, 1)]))
    again = ST.snapshot_store(spark, str(tmp_path / "s"), store.schema, 8)   # reopened
    assert [r.response_body for r in again.read().collect()] == ["Привет"]
    store.vacuum(1)
    assert again.read().count() == 1 and len(os.listdir(tmp_path / "s" / "data")) == 1


def SN_SCHEMA(spark):
    return spark.createDataFrame([], SNAPS).schema


def test_a_write_that_dies_is_never_seen_and_can_be_retried(spark, tmp_path, monkeypatch):
    store = ST.snapshot_store(spark, str(tmp_path / "s"), SN_SCHEMA(spark), 4)
    ST.put(store, snaps(spark, [("a", "1", 1, 24, 1), ("b", "1", 1, 24, 2)]), txn=0)
    sink = J.upsert_sink(store)
    batch = snaps(spark, [("a", "2", 2, 24, 3), ("c", "1", 2, 24, 4)])

    def dies(*_):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:                                         # killed after the data, before the manifest
        m.setattr(ST, "_put_once", dies)
        with pytest.raises(RuntimeError, match="killed"):
            sink(batch, 1)
    os.makedirs(tmp_path / "s" / "data" / "00000002-dead" / "_temporary" / "0")     # killed in the middle of the data
    open(tmp_path / "s" / "manifests" / ".00000002.json.dead", "w").write("{")     # or of the manifest
    rows = lambda: sorted((r.url, r.response_body) for r in store.read().collect())
    assert rows() == [("a", "1"), ("b", "1")]                                # a reader in between
    sink(batch, 1)
    assert rows() == [("a", "2"), ("b", "1"), ("c", "1")]
    sink(snaps(spark, [("a", "never", 3, 24, 9)]), 1)                        # committed batches are skipped
    assert rows()[0] == ("a", "2")
    with pytest.raises(Exception, match="(?i)exist"):                        # a version is created once
        store._commit({"version": 2, "txn": 5, "buckets": {}, "note": {}})


# --- stream state ------------------------------------------------------------------------------------------

def log_rows(n=600, keys=6):
    rnd = random.Random(11)
    # A third of all rows is one key's.
    return [("hot" if rnd.random() < 0.34 else f"k{rnd.randrange(keys)}", T0 + dt.timedelta(minutes=7 * i), i, rnd.random() < 0.3) for i in range(n)]


@pytest.mark.parametrize("cuts", [1, 6])
def test_failure_levels_do_not_depend_on_batches(spark, tmp_path, cuts):
    df = spark.createDataFrame(log_rows(), "key string, ts timestamp, seq bigint, ok boolean")
    for c in range(cuts):
        df.where(F.floor(F.col("seq") * cuts / 600) == c).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = {r.seq: r.level for r in J.failure_state(stream, spark, str(tmp_path / "base")).collect()}
    assert got == {r.seq: r.level for r in FL.failure_levels(df).collect()}
    # A key that never succeeds counts on over batches.
    assert got[max(got)] is not None and len(got) == 600


def test_failure_batches_are_redone_or_skipped(spark, tmp_path):
    sink = J.levels_sink(spark, str(tmp_path / "b"))
    rows = [("a", T0 + dt.timedelta(minutes=i), i, False) for i in range(4)]
    schema = "key string, ts timestamp, seq bigint, ok boolean"
    sink(spark.createDataFrame(rows[:2], schema), 0)
    sink(spark.createDataFrame(rows[:2], schema), 0)
    sink(spark.createDataFrame(rows[2:], schema), 1)
    got = spark.read.parquet(str(tmp_path / "b" / "out")).orderBy("seq").collect()
    assert [r.level for r in got] == [1, 2, 3, 4]
    sink(spark.createDataFrame([], schema), 2)
    spark.createDataFrame([("a", T0, 99, False, 7)], f"{schema}, level bigint").write.parquet(str(tmp_path / "b" / "out" / "batch=9"))
    assert J._committed(spark, str(tmp_path / "b"), "key string, level bigint").count() == 4      # batch 9 died before its commit


def sequential_starts(times, ttl, last=None):
    out = []
    for t in sorted(times):
        if last is None or t > last + ttl:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("ttl", [0, 1, 7, 100, 5000])
def test_interval_starts_equal_the_sequential_rule(spark, ttl):
    rnd = random.Random(ttl)
    times = {k: [rnd.randrange(3000) for _ in range(n)] for k, n in (("hot", 400), ("a", 40), ("b", 1), ("gap", 3))}
    times["gap"] = [0, 100, 2900]
    last = {"hot": 50, "a": -400, "new": 3}
    arrivals = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "key string, us long")
    state = spark.createDataFrame(list(last.items()), "key string, us long")
    got = sorted((r.key, r.us) for r in J.interval_starts(arrivals, state, ttl).collect())
    assert got == sorted((k, t) for k, ts in times.items() for t in sequential_starts(ts, ttl, last.get(k)))


def test_late_arrivals_and_ended_states_are_dropped(spark, tmp_path):
    sink = J.fresh_sink(spark, str(tmp_path / "f"), 24, 24)
    at = lambda k, h, q: (k, T0 + dt.timedelta(hours=h), q)
    for i, rows in enumerate([[at("a", 0, 1), at("b", 100, 2)], [at("c", 10, 3), at("a", 101, 4), (None, T0, 5)], [at("a", 110, 6)]]):
        sink(spark.createDataFrame(rows, "key string, ts timestamp, seq bigint"), i)
    got = sorted(r.seq for r in spark.read.parquet(str(tmp_path / "f" / "out")).collect())
    assert got == [1, 2, 4]


def test_purge_query_counts(spark):
    got = {r.step: (r.n_deleted, r.n_left) for r in queries_state.s12_snapshot_purge(spark, "/root/testdata/sf0.001").collect()}
    assert got["put"][1] == got["expire"][0] + got["expire"][1] and got["purge"] == (got["expire"][1], 0)


def test_flagship_reads_bodies_behind_the_filter(spark):
    text = plan(queries_core.flagship(spark, "/root/testdata/sf0.001"))[0]
    assert "bit_or" in text


# --- quantile, ranks, phrases ---------------------------------------------------------------------------------

def test_quantile_is_part_of_the_plan(spark):
    import numpy as np
    from newsprism.operators.expand import exact_quantile
    from newsprism.sources import outlets as O
    inf = float("inf")
    for vals in ([1.0], [3.0, 1.0], [2.0] * 9 + [5.0], [-1e300, -1.0, -1e-300, 0.0, -0.0, 5e-324, 1.0, 1e300], [-inf, 1.0, 2.0, inf, inf],
                 [float(x) ** 7 for x in range(-30, 31)], [1.0 + i * 2.0 ** -52 for i in range(40)]):
        df = spark.createDataFrame([(v,) for v in vals + [None, float("nan")]], "v double")
        for q in (0.25, 1.0):
            got = spark.range(1).select(exact_quantile(df, "v", q)).first()[0]
            want = float(np.sort(vals)[int(q * (len(vals) - 1))]) if (q * (len(vals) - 1)) % 1 == 0 else float(np.quantile(vals, q))
            assert got == want or abs(got - want) <= 1e-12 * max(1, abs(want)), (vals, q, got, want)
    # Nothing runs while the plan is made.
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    low = O.low_visibility(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", None)], "source string, visibility double"))
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setJobGroup("", "")
    assert [r.source for r in low.collect()] == ["a"]


def test_positions_are_those_of_the_stored_order(spark):
    from newsprism.operators.expand import positions
    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 AS v")
    ranks = positions(df, "v", partitions=6)
    assert sorted((r.v, r.pos) for r in ranks.collect()) == [(i, i) for i in range(5000)]
    # Read again in other splits, as after the loss of a stage: the same positions.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert sorted((r.v, r.pos) for r in ranks.where("v >= 0").repartition(3).collect()) == [(i, i) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert positions(df.limit(0), "v").count() == 0


def test_phrases_are_found_in_a_text_lowered_once(spark):
    from newsprism.functions.flags import looks_blocked
    from newsprism.functions.text import any_phrase
    from newsprism.sources.serp_html import web_blocked
    df = spark.createDataFrame([("Just a MOMENT",), ("fine",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(looks_blocked("t", F.create_map().cast("map<string,string>"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(any_phrase("t", ["x", "moment"])).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(web_blocked(F.col("t"), F.lit("u"))).collect()] == [False] * 4
    lowered = [plan(df.select(any_phrase("t", [f"p{i}" for i in range(n)])))[0].count("lower(coalesce(t") for n in (1, 30)]
    assert lowered[0] == lowered[1]
