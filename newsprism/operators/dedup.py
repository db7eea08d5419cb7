"""First-wins deduplication (D1 two-key greedy, A4 composite key).

D1 semantics: scan rows in ``ord`` order; drop a row whose title key *or* url
key was already recorded by a *kept* row; otherwise keep it and record both
keys.  A dropped row records nothing, so this is neither two ``dropDuplicates``
nor connected components: it is the lexicographically first maximal
independent set of the graph "shares a key".  It is computed in rounds:

1. per key, the smallest ``ord`` still undecided (partial aggregates, so a key
   holding a third of all rows is only a few rows per map task);
2. a row that is the smallest of *every* one of its key groups has no earlier
   undecided neighbour and every earlier decided neighbour was dropped, so it
   is kept;
3. rows sharing a key with a row kept in this round are dropped (anti joins);
4. the undecided rest is written to the shared folder and goes round again.

Random orders need a handful of rounds.  What is left after ``PLAIN_ROUNDS`` hangs together in
chains, and a round then also follows them: a row with exactly one earlier undecided neighbour is
kept exactly if that one is not.  These links are doubled (a link to a link becomes one link, its
parity the sum), so a chain of n rows takes log2(n) joins in place of n/2 rounds; rows at an even
distance from a kept one are kept with it.  Nothing ever meets in one task, whatever the size;
spent tables are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsprism.functions.text import title_key
from newsprism.functions.urls import url_key
from newsprism.session import path_exists, remove_path, scratch_path


PLAIN_ROUNDS = 2


def first_wins_multi_key(keys_df: DataFrame, order: str, keys: list[str], plain_rounds: int = PLAIN_ROUNDS) -> DataFrame:
    """Return the ``order`` values kept by the greedy multi-key scan.

    ``keys_df`` holds ``order`` (unique, orderable) and the key columns (non-null).
    """
    spark = keys_df.sparkSession
    base = scratch_path(spark, "first-wins")
    # Rows with the very same key tuple: only the first can ever be kept.
    state = keys_df.groupBy(*keys).agg(F.min(order).alias(order)).withColumn("_keep", F.lit(False))
    schema = state.select(order, *keys).schema
    n = 0
    while True:
        state.select(order, *keys, "_keep").write.partitionBy("_keep").parquet(f"{base}/round={n}")
        if n:
            remove_path(spark, f"{base}/round={n - 1}/_keep=false")
            remove_path(spark, f"{base}/chain={n - 1}")
        left = f"{base}/round={n}/_keep=false"
        rem = spark.read.schema(schema).parquet(left) if path_exists(spark, left) else None
        if rem is None or rem.isEmpty():
            break
        state = _round(rem, order, keys) if n < plain_rounds else _chain_round(rem, order, keys, f"{base}/chain={n}")
        n += 1
    won = [p for p in (f"{base}/round={i}/_keep=true" for i in range(1, n + 1)) if path_exists(spark, p)]
    if not won:
        return spark.createDataFrame([], keys_df.select(order).schema)
    return spark.read.schema(schema).parquet(*won).select(order)


def _tagged(rem: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """The rows with the smallest order of each of their keys; ``_keep`` if it is their own in all."""
    mins = [rem.groupBy(k).agg(F.min(order).alias(f"_min{i}")) for i, k in enumerate(keys)]
    tagged = reduce(lambda d, km: d.join(km[1], km[0]), zip(keys, mins), rem)
    is_min = reduce(lambda a, b: a & b, [F.col(order) == F.col(f"_min{i}") for i in range(len(keys))])
    return tagged.select(order, *keys, *[f"_min{i}" for i in range(len(keys))], is_min.alias("_keep"))


def _settled(tagged: DataFrame, won: DataFrame, keys: list[str]) -> DataFrame:
    """The rows kept (``_keep``) and the rows that share no key with them."""
    rest = tagged.filter("not _keep")
    for k in keys:
        rest = rest.join(won.select(k), k, "left_anti")
    return won.unionByName(rest)


def _round(rem: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """One round: the rows kept (``_keep``) and the rows still undecided."""
    tagged = _tagged(rem, order, keys).select(order, *keys, "_keep")
    return _settled(tagged, tagged.filter("_keep"), keys)


def _chain_round(rem: DataFrame, order: str, keys: list[str], path: str) -> DataFrame:
    """One round that follows chains to their end; its tables lie below ``path``."""
    spark = rem.sparkSession
    tagged = _tagged(rem, order, keys)
    tagged.write.parquet(f"{path}/tagged")
    tagged = spark.read.schema(tagged.schema).parquet(f"{path}/tagged")
    links = _links(tagged, order, keys)
    links.write.partitionBy("done").parquet(f"{path}/hop=0")
    n = 0
    while path_exists(spark, f"{path}/hop={n}/done=false"):
        _hop(_ended(spark, path, n, links.schema), spark.read.schema(links.drop("done").schema).parquet(f"{path}/hop={n}/done=false"),
             order).write.partitionBy("done").parquet(f"{path}/hop={n + 1}")
        remove_path(spark, f"{path}/hop={n}/done=false")
        n += 1
    first = tagged.filter("_keep").select(order, *keys, "_keep")
    with_first = _ended(spark, path, n, links.schema).filter("not odd").join(first.select(F.col(order).alias("to")), "to", "left_semi")
    others = tagged.join(with_first.select(order), order, "left_semi").select(order, *keys, F.lit(True).alias("_keep"))
    return _settled(tagged.select(order, *keys, "_keep"), first.unionByName(others), keys)


def _links(tagged: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """(order, to, odd, done) for each row with exactly one earlier neighbour: it is the first row of
    every key that the row isn't the first of, and the row comes second there."""
    rows = tagged.filter("not _keep")
    for i, k in enumerate(keys):
        second = rows.filter(F.col(order) > F.col(f"_min{i}")).groupBy(k).agg(F.min(order).alias(f"_second{i}"))
        rows = rows.join(second, k, "left")
    later = [F.col(order) > F.col(f"_min{i}") for i in range(len(keys))]
    near = reduce(lambda a, b: a & b, [~x | (F.col(order) == F.col(f"_second{i}")) for i, x in enumerate(later)])
    before = [F.when(x, F.col(f"_min{i}")) for i, x in enumerate(later)]
    return rows.filter(near & (F.least(*before) == F.greatest(*before))).select(
        order, F.least(*before).alias("to"), F.lit(True).alias("odd"), F.lit(False).alias("done"))


def _ended(spark: SparkSession, path: str, n: int, schema: StructType) -> DataFrame:
    """The links that have come to the end of their chain in the first ``n`` hops."""
    done = [p for p in (f"{path}/hop={i}/done=true" for i in range(n + 1)) if path_exists(spark, p)]
    narrow = StructType([f for f in schema if f.name != "done"])
    return spark.read.schema(narrow).parquet(*done) if done else spark.createDataFrame([], narrow)


def _hop(ended: DataFrame, going: DataFrame, order: str) -> DataFrame:
    """Each unfinished link goes on by the link of the row it points to; without one it has ended.
    Many links may point to one row, but that row has one link: AQE can split the join."""
    far = ended.withColumn("_done", F.lit(True)).unionByName(going.withColumn("_done", F.lit(False))).select(
        F.col(order).alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"), "_done")
    return going.join(far, "to", "left").select(
        order, F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
        F.coalesce("_done", F.lit(True)).alias("done"))


def dedup_keys(df: DataFrame, order: str = "ord", title: str = "title", url: str = "url",
               empty_key: str = "match") -> DataFrame:
    """(ord, tkey, ukey) for D1.  ``empty_key="ignore"`` stops empty title keys from colliding."""
    tk = title_key(title)
    if empty_key == "ignore":
        tk = F.when(tk == "", F.concat(F.lit("\u0000"), F.col(order).cast("string"))).otherwise(tk)
    return df.select(F.col(order).cast("bigint").alias(order), tk.alias("tkey"), url_key(url).alias("ukey"))


def dedup_articles(df: DataFrame, order: str = "ord", empty_key: str = "match") -> DataFrame:
    """D1 on an article DataFrame: keeps the first row per title key or url key.

    Only three narrow columns go through the rounds; the wide rows are joined
    back once with a semi join on the unique ``ord``.
    """
    kept = first_wins_multi_key(dedup_keys(df, order, empty_key=empty_key), order, ["tkey", "ukey"])
    return df.join(kept, order, "left_semi")


def first_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """A4: first row per composite key, by ``order``.

    ``min_by`` is a partial aggregate, so a hot key is combined map-side
    instead of landing in one window partition.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.min_by(packed, F.col(order)).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others]))
