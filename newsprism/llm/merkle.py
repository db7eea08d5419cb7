"""Merkle manifest of a dataset in postorder append logs (operator 13).

* **Leaves.**  One digest per row; the rows of a source, in the order of doc_id, are the leaves of its
  tree.  Their places come from range-sorted files (``ranks``), so a hot source is many tasks.
* **Aligned builders.**  A builder takes SPAN = FAN ** LEVELS consecutive leaves, starting at a multiple
  of SPAN, and appends nodes to its log in the order in which they are complete: every leaf, and
  after the last leaf of a run the node above it.  A builder's last node is a leaf of the next
  round, so that a tree of n leaves takes log(n) / log(SPAN) rounds, each one a shuffle of 1 / SPAN as
  many nodes.  The roots of the sources are the leaves of one more tree, built alike.
* **Closed-form places.**  A node is complete with the last leaf e below it, and before that leaf
  the log holds e leaves and, of each higher level m, e // FAN^m nodes: the node of level l is at
  e + e // FAN + e // FAN^2 + ... + l.  Proofs are read from the logs by these places alone.
* **Proofs.**  From the top round down, every log hands each of its leaves the siblings on its way to the
  root, as text before and after the node.  A row's digest, folded through them, must give the root.

Edge cases: null fields have their own mark in a leaf; a null source is a tree of its own and comes
first; null doc_ids come first in their tree; rows that repeat a doc_id are ordered by digest, so
that equal rows are interchangeable; long texts are hashed by the JVM and go no further; an empty
table gives an empty result; columns beyond the five of ``documents`` are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from newsprism.llm.ranks import placed, range_sorted, ranked, segments
from newsprism.llm.scratch import bound_batches, small_side, written

FAN, LEVELS = 16, 2
SPAN = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def framed(value: Column) -> Column:
    """A field of a leaf: its UTF-8 length, a colon and its text; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*(framed(F.col(f)) for f in FIELDS[:-1]), framed(text)), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- one builder ----------------------------------------------------------------------------

def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes of a builder in completion order; its last run may be short at every level."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels)]
    for i, node in enumerate(leaves, 1):
        log.append(node)
        for run in runs:
            run.append(node)
            if len(run) < FAN and i < len(leaves):
                break
            node = digest("".join(run))
            run.clear()
            log.append(node)
    return log


def place(level: int, index: int, leaves: int, levels: int = LEVELS) -> int:
    """Where node ``index`` of ``level`` stands in the log of a builder of so many leaves."""
    last = min((index + 1) * FAN ** level, leaves) - 1
    return last + sum(last // FAN ** m for m in range(1, levels + 1)) + level


def siblings(log: list[str], leaf: int, leaves: int, levels: int) -> list[tuple[str, str]]:
    """Per level, the digests before and after the node on the way from ``leaf`` up."""
    out = []
    for level in range(levels):
        index, nodes = leaf // FAN ** level, -(-leaves // FAN ** level)
        start = index - index % FAN
        at = lambda a, b: "".join(log[place(level, k, leaves, levels)] for k in range(a, b))  # noqa: B023, E731
        out.append((at(start, index), at(index + 1, min(start + FAN, nodes))))
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


# --- rounds of builders ------------------------------------------------------------------------

def grown(nodes: DataFrame, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """``nodes``: tree, n (leaves of the tree), index, node and ``carry``.  One written table per round: tree, n,
    builder, node and ``carry`` (arrays by index) and log."""
    bound_batches(nodes.sparkSession)
    rounds = []
    while True:
        rows = nodes.groupBy("tree", "n", F.expr(f"index div {SPAN}").alias("builder")) \
            .agg(F.sort_array(F.collect_list(F.struct("index", "node", *carry))).alias("rows"))
        rows = rows.select("tree", "n", "builder", *(F.col(f"rows.{c}").alias(c) for c in ("node", *carry)))
        schema = StructType([*rows.schema.fields, StructField("log", ArrayType(StringType()))])
        rounds.append(written(rows.mapInArrow(_append, schema), "merkle-log"))
        nodes = rounds[-1].where(F.col("n") > SPAN).select("tree", F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"),
                                                           F.col("builder").alias("index"), F.element_at("log", -1).alias("node"))
        carry = ()
        if nodes.isEmpty():
            return rounds


def _append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        logs = [append_log(leaves, min(LEVELS, height(n))) for leaves, n in zip(batch["node"].to_pylist(), batch["n"].to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.list_(pa.string()))], [*batch.schema.names, "log"])


def tops(rounds: list[DataFrame]) -> DataFrame:
    """tree, node: the root of every tree."""
    out = None
    for r in rounds:
        some = r.where(F.col("n") <= SPAN).select("tree", F.element_at("log", -1).alias("node"))
        out = some if out is None else out.unionByName(some)
    return out


PATH = "array<struct<before:string,after:string>>"


def paths(rounds: list[DataFrame], above: DataFrame, keep: tuple[str, ...] = (), last=None, schema: str = "") -> DataFrame:
    """From the top round down: tree, index, path and the columns ``keep`` of ``above`` for every leaf of the first round.

    ``above``: tree, path, keep: what follows the root of a tree.  ``last`` (with its ``schema``) takes the place of
    ``_handed`` in the first round."""
    kept = ", ".join(f"{c} string" for c in keep)
    handed = None
    for r in reversed(rounds):
        # A tree's only builder goes on with what lies above its root, the others with what the round above handed down.
        ends = above.select("tree", F.lit(-1).cast("long").alias("up"), "path", *keep)
        ups = ends if handed is None else ends.unionByName(handed.select("tree", F.col("index").alias("up"), "path", *keep))
        with_path = r.withColumn("up", F.when(F.col("n") <= SPAN, F.lit(-1)).otherwise(F.col("builder"))).join(ups, ["tree", "up"])
        if r is rounds[0] and last is not None:
            return with_path.mapInArrow(last, schema)
        handed = written(with_path.select("tree", "n", "builder", "node", "log", "path", *keep)
                         .mapInArrow(_handed, f"tree string, index long, path {PATH}" + (f", {kept}" if kept else "")), "merkle-path")
    return handed


def _ways(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[list[tuple[str, str]]]]]:
    for row in batch.to_pylist():
        leaves, levels = len(row["node"]), min(LEVELS, height(row["n"]))
        up = [(p["before"], p["after"]) for p in row["path"]]
        yield row, [siblings(row["log"], i, leaves, levels) + up for i in range(leaves)]


def _handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [c for c in batch.schema.names if c not in ("tree", "n", "builder", "node", "log", "path")]
        for row, ways in _ways(batch):
            out = {"tree": [row["tree"]] * len(ways), "index": [row["builder"] * SPAN + i for i in range(len(ways))],
                   "path": [[{"before": b, "after": a} for b, a in way] for way in ways]}
            out |= {c: [row[c]] * len(ways) for c in keep}
            types = [("tree", pa.string()), ("index", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))]
            yield pa.RecordBatch.from_pydict(out, pa.schema(types + [(c, pa.string()) for c in keep]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        id_type = batch.schema.field("doc_id").type.value_type
        for row, ways in _ways(batch):
            proofs = [digest("".join(b + a for b, a in way)) for way in ways]
            folds = [folded(forged or leaf, way) for leaf, forged, way in zip(row["node"], row["forged"], ways)]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_id"], id_type), pa.array(row["node"], pa.string()), pa.array([row["subroot"]] * len(ways), pa.string()),
                pa.array([row["root"]] * len(ways), pa.string()), pa.array(proofs, pa.string()), pa.array(folds, pa.string()),
                pa.array([f == row["root"] for f in folds], pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


# --- the manifest --------------------------------------------------------------------------------

def numbered(nodes: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """tree, n, index: the place of every node in its tree; ``order`` starts with tree."""
    table = range_sorted(nodes, order, name)
    pieces = small_side(written(segments(table, "tree"), f"{name}-files"))
    return ranked(table, pieces, "tree", "index").withColumnRenamed("_all", "n")


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, node (the digest) and forged (that of the tampered row, else null) per row."""
    forged = F.when(tampered(F.col("doc_id")), leaf_digest(F.translate(F.col("text").cast("string"), UPPER, LOWER)))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return docs.select(*FIELDS).select(tree.alias("tree"), "doc_id", leaf_digest(F.col("text")).alias("node"), forged.alias("forged"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified per row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    # Written before sorting: texts are hashed once.  File and row tell equal rows apart.
    first = placed(written(leaves(docs), "merkle-leaves")).withColumnRenamed("_file", "of").withColumnRenamed("_row", "at")
    order = ["tree", F.col("doc_id").asc_nulls_first(), "node", "of", "at"]
    trees = grown(numbered(first, order, "merkle-order").select("tree", "n", "index", "node", "doc_id", "forged"), ("doc_id", "forged"))
    subroots = written(tops(trees), "merkle-roots")
    whole = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), ["tree", "of"], "merkle-sources")
    top = grown(whole.select("tree", "n", "index", "node"))
    above = tops(top).select("tree", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    # The path of the k-th source belongs to the tree of that name.
    named = whole.select(F.col("index").alias("k"), F.col("of").alias("tree"), F.col("node").alias("subroot"))
    ways = paths(top, above, ("root",)).select(F.col("index").alias("k"), "path", "root")
    per_source = written(named.join(ways, "k").select("tree", "path", "subroot", "root"), "merkle-sources-path")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return paths(trees, per_source, ("subroot", "root"), _verified, schema)
