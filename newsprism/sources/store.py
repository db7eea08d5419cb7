"""A keyed table on disk, in hash buckets and committed versions (S11, S12, ST1-ST3).

Layout: ``data/<version>-<id>/bucket=<n>/`` (Parquet) and ``manifests/<version>.json``.  A manifest
names, for each bucket, the folder that holds it and its number of rows.  A change writes the
buckets it touches into a new folder and then creates the next manifest by one rename that
fails if the version exists.  Readers follow the newest manifest only, so that a write that dies,
or is still under way, is never seen; its folder is dropped by ``vacuum``.  ``txn`` numbers the
batches of a stream: one that is already committed is skipped when it is retried.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsprism.session import file_system, path_exists, remove_path
from newsprism.sources import snapshots as SN

BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "url", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    # --- manifests ---

    def versions(self) -> list[int]:
        folder = f"{self.path}/manifests"
        names = _names(self.spark, folder) if path_exists(self.spark, folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """That of ``version``, or the newest one; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "txn": -1, "buckets": {}, "note": {}}
        return json.loads(_get(self.spark, f"{self.path}/manifests/{version:08d}.json"))

    def _commit(self, manifest: dict) -> None:
        name = f"{manifest['version']:08d}.json"
        _put_once(self.spark, f"{self.path}/manifests/.{name}.{uuid.uuid4().hex[:8]}", f"{self.path}/manifests/{name}", json.dumps(manifest))

    # --- reading ---

    def size(self, version: int | None = None) -> int:
        """Rows, from the manifest alone."""
        return sum(b["rows"] for b in self.manifest(version)["buckets"].values())

    def read(self, version: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        return self._of(self.manifest(version), only)

    def _of(self, manifest: dict, only: Iterable[int] | None = None) -> DataFrame:
        wanted = None if only is None else {str(b) for b in only}
        folders = [f"{self.path}/{b['folder']}" for n, b in manifest["buckets"].items() if wanted is None or n in wanted]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets``

    # --- changing ---

    def change(self, touched: set[int], make: Callable[[DataFrame], DataFrame | None], txn: int | None = None, note: dict | None = None) -> int:
        """The next version: the rows of the touched buckets are what ``make`` makes of them (None: no rows);
        other buckets are neither read nor written.  Returns the version."""
        old = self.manifest()
        version, kept = old["version"] + 1, {n: b for n, b in old["buckets"].items() if int(n) not in touched}
        rows = make(self._of(old, touched)) if touched else None
        if rows is not None:
            folder = f"data/{version:08d}-{uuid.uuid4().hex[:8]}"
            rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket") \
                .write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            new = self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", "integer")) \
                .parquet(f"{self.path}/{folder}").groupBy("bucket").count().collect()
            kept |= {str(n): {"folder": f"{folder}/bucket={n}", "rows": c} for n, c in new}
        self._commit({"version": version, "txn": old["txn"] if txn is None else txn, "buckets": kept, "note": old["note"] | (note or {})})
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Drop manifests but the ``keep`` newest ones, and data folders that none of those names (but a
        write under way, which is of a later version)."""
        versions = self.versions()
        used = {b["folder"].split("/")[1] for v in versions[-keep:] for b in self.manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            remove_path(self.spark, f"{self.path}/manifests/{v:08d}.json")
        data = f"{self.path}/data"
        for name in _names(self.spark, data) if path_exists(self.spark, data) else []:
            if name not in used and int(name.split("-")[0]) <= max(versions, default=0):
                remove_path(self.spark, f"{data}/{name}")


# --- snapshots in a store ---------------------------------------------------------------------

def snapshot_store(spark: SparkSession, path: str, schema: StructType, buckets: int = BUCKETS) -> Store:
    return Store(spark, path, StructType([schema[c] for c in SN.SNAPSHOT_COLUMNS]), "url", buckets)


def put(store: Store, rows: DataFrame, txn: int | None = None) -> int:
    """Upsert of a batch (200s only)."""
    rows = rows.select(*SN.SNAPSHOT_COLUMNS).filter(F.col("status_code") == 200)
    return store.change(store.buckets_of(rows), lambda current: SN.upsert(current, rows), txn)


def expire(store: Store, as_of: Column) -> int:
    """Delete what has outlived its time to live; returns the number of deleted rows.  Only buckets that
    hold such rows are written, and no body is read to find them."""
    old = SN.expired(store.read(), as_of).groupBy(store.bucket().alias("b")).count().collect()
    if old:
        store.change({r[0] for r in old}, lambda current: SN.fresh(current, as_of))
    return sum(r[1] for r in old)


def purge(store: Store) -> int:
    """Delete everything; returns the number of deleted rows.  An empty version: no data is touched."""
    n = store.size()
    store.change({int(b) for b in store.manifest()["buckets"]}, lambda current: None)
    return n


# --- files ------------------------------------------------------------------------------------------

def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)]


def _get(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put_once(spark: SparkSession, draft: str, path: str, text: str) -> None:
    """Create ``path`` with ``text`` in one step; fails if it exists."""
    fs, p = file_system(spark, draft)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    sc = spark.sparkContext
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), sc._jsc.hadoopConfiguration())
    options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files.rename(p, sc._jvm.org.apache.hadoop.fs.Path(path), options)
