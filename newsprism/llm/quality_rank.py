"""Quality by Bradley-Terry pairwise ranking (operator 10).

A document's score is linear in its standardised features.  Preference pairs set a training row of
label 1 against one of label 0, and the weights minimise the logistic loss of the feature
differences (a logistic regression without intercept on the differences, each taken both ways).
A score quantile then becomes the threshold: of a grid of quantiles of the training scores, the one that
tells the labels apart best (largest sum of both hit rates, the middle of equals).  The reported score is the probability
that the document wins against one at the threshold, moved so that the threshold is ``KEEP``.

All labelled rows outside the held-out part are training rows: means, pairs, weights and threshold
come from every one of them, and every one is in a pair.  The features of all texts are found once,
written, and read by the fit and the scoring.  Ranks and quantiles are places in range-sorted files,
so no task holds a label's rows.  Pairs grow with the rows: ``OPPONENTS`` for each row of the rarer
label, more only where the other label's rows would not all be met.

Features: symbols, capitals, digits and marks per character, repeated words and lines, length of words,
lines and text, variety of words.  Labels, lang, source and doc_id are never features.

Edge cases: a null or empty text has all features 0 and is scored as such; without training rows of
both labels the score is the share of label 1 (0 without rows); repeated rows score alike; a null
doc_id is scored; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.bytewords import Words, blocks, buffers
from newsprism.llm.labelled import held_out, training_ids
from newsprism.llm.quality_rules import _per_doc, measure
from newsprism.llm.ranks import range_sorted, ranked, segments
from newsprism.llm.scratch import bound_batches, small_side, written

PARTS, HELD = 5, 0
KEEP = 0.3
#: Opponents of every row of the rarer label, at least.
OPPONENTS = 8
#: Steps between the quantiles that may become the threshold.
GRID = 400
#: Rows of the rarer label (a vector each) that a broadcast may hold: about 12 MB.
MAX_BROADCAST_VECTORS = 100_000
#: Duels of one task of the regression: few tasks keep its many small jobs short.
TASK_DUELS = 250_000
FEATURES = ("symbols", "capitals", "digits", "marks", "repeated", "again_lines", "word_length", "line_words", "log_words", "variety", "short")
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?\"'()[]{}-_/\\")] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    raw, offsets = buffers(texts)
    m = measure(texts)
    n = len(offsets) - 1
    digits, marks, distinct = (np.zeros(n) for _ in range(3))
    for i, j in blocks(offsets):
        w = Words(raw, offsets, i, j)
        digits[i:j], marks[i:j] = _per_doc(_DIGIT[w.data], w.docs), _per_doc(_MARK[w.data], w.docs)
        for d in range(j - i):
            # The first words only would be a prefix: variety is over all words, per root of their number.
            distinct[i + d] = len(np.unique(w.hashes[w.bounds[d]:w.bounds[d + 1]]))
    words, chars, lines = np.maximum(1, m["n_words"]), np.maximum(1, m["word_chars"]), np.maximum(1, m["n_lines"])
    curve = lambda x: np.log1p(100 * x)
    out = np.column_stack([
        curve(m["n_symbols"] / chars), curve(m["n_capitals"] / chars), curve(digits / chars), curve(marks / chars),
        curve(m["n_repeat_words"] / words), curve(m["n_dup_lines"] / lines), np.log1p(m["word_chars"] / words),
        np.log1p(m["n_words"] / lines), np.log1p(m["n_words"]), distinct / words, (m["n_words"] < 10).astype(float)])
    out[m["n_words"] == 0] = 0.0
    return out


def vector_of(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        x = features(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))

    return vectors(F.coalesce(text.cast("string"), F.lit("")))


@dataclass
class RankModel:
    weights: list[float] | None
    means: list[float]
    scales: list[float]
    threshold: float
    constant: float

    def raw(self, vector: Column) -> Column:
        """The Bradley-Terry score of a feature vector."""
        return sum(((vector[i] - m) / s * w for i, (w, m, s) in enumerate(zip(self.weights, self.means, self.scales, strict=True))), F.lit(0.0))

    def score(self, vector: Column) -> Column:
        if self.weights is None:
            return F.lit(self.constant)
        z = self.raw(vector) - self.threshold + float(np.log(KEEP / (1 - KEEP)))
        # The threshold itself must come out as KEEP, whatever the last bit of exp().
        p = 1 / (1 + F.exp(-z))
        return F.when(self.raw(vector) >= self.threshold, F.greatest(p, F.lit(KEEP))).otherwise(F.least(p, F.lit(KEEP - 1e-9)))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, f (the feature vector), one row per row of docs, written."""
    bound_batches(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), vector_of(F.col("text")).alias("f")), "features")


def pairs(fit: DataFrame, opponents: int = OPPONENTS, parts: int | None = None) -> DataFrame:
    """winner, loser (vectors) over all rows of ``fit`` (doc_id, label, z): each row of the rarer label
    meets ``opponents`` of the other, or as many as it takes for all of the other to be met, dealt in turn."""
    table = range_sorted(fit.select("doc_id", "label", "z"), ["label", F.xxhash64("doc_id"), "doc_id", "z"], "ranked", parts)
    pieces = written(segments(table, "label"), "ranked-pieces")
    n = {r[0]: r[1] for r in pieces.select("label", "_all").distinct().collect()}
    few, many = (0, 1) if n[0] <= n[1] else (1, 0)
    take = min(max(opponents, -(-n[many] // n[few])), n[many])
    rows = ranked(table, F.broadcast(pieces), "label", "rank")
    # Duel d is that of row d div take of the rarer label and row d mod n[many] of the other.
    last, step = F.lit(n[few] * take - 1).cast("long"), F.lit(n[many]).cast("long")
    met = rows.where(F.col("label") == many).select(F.col("z").alias("many"), F.explode(F.sequence(F.col("rank").cast("long"), last, step)).alias("duel"))
    met = met.select("many", F.floor(F.col("duel") / take).alias("rank"))
    left = rows.where(F.col("label") == few).select("rank", F.col("z").alias("few"))
    met = met.join(small_side(left, n[few], MAX_BROADCAST_VECTORS), "rank")
    return met.select(F.col("many" if many else "few").alias("winner"), F.col("few" if many else "many").alias("loser"))


def fit(own: DataFrame, labels: DataFrame) -> RankModel:
    """Learn from all labelled rows of ``own`` (see ``vectors``) outside the held-out part."""
    book = written(own.join(training_ids(labels, "quality", PARTS, HELD), "doc_id").select("doc_id", "label", "f"), "book")
    k = len(FEATURES)
    stats = book.agg(F.count_distinct("label"), F.avg("label"), *(F.avg(F.col("f")[i]) for i in range(k)), *(F.stddev_pop(F.col("f")[i]) for i in range(k))).first()
    if stats[0] < 2:
        return RankModel(None, [], [], 0.0, float(stats[1] or 0.0))
    means, scales = [float(x) for x in stats[2:2 + k]], [float(x) or 1.0 for x in stats[2 + k:]]
    met = pairs(book.withColumn("z", F.array(*((F.col("f")[i] - means[i]) / scales[i] for i in range(k)))))
    met = written(met.select(F.zip_with("winner", "loser", lambda a, b: a - b).alias("d")), "duels")
    both = met.select("d", F.lit(1.0).alias("label")).unionByName(met.select(F.transform("d", lambda x: -x).alias("d"), F.lit(0.0).alias("label")))
    both = both.coalesce(1 + 2 * met.count() // TASK_DUELS).select(array_to_vector("d").alias("features"), "label")
    duel = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=50).fit(both)
    model = RankModel([float(x) for x in duel.coefficients], means, scales, 0.0, float(stats[1]))
    model.threshold = threshold(book.select(model.raw(F.col("f")).alias("score"), "label"))
    return model


def threshold(scores: DataFrame, grid: int = GRID, parts: int | None = None) -> float:
    """The quantile of the scores (score, label) that tells the labels apart best; the middle one of equals."""
    values = scores.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("good"))
    table = range_sorted(values, ["score"], "scores", parts)
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = written(table.groupBy("_file").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "score-files")
    n, good = files.agg(F.sum("n"), F.sum("good")).first()
    starts = files.select("_file", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_start") for c in ("n", "good")))
    here = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = table.join(F.broadcast(starts), "_file").select(
        "score", "n", *((F.col(f"{c}_start") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(f"{c}_before") for c in ("n", "good")))
    needed = np.unique(np.concatenate(around(n, grid)[:2]))

    @F.arrow_udf("boolean")
    def holds(before: pa.Array, count: pa.Array) -> pa.Array:
        first = before.to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(needed, first + count.to_numpy(zero_copy_only=False)) > np.searchsorted(needed, first))

    # At most two values per quantile.
    found = np.array(placed.where(holds("n_before", "n")).orderBy("score").select("score", "n_before", "good_before").collect(), dtype=float)
    return best_level(*found.T, n, good, grid)


def around(n: int, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places (of n sorted values) below and above each quantile, and how far it is between them."""
    at = (n - 1) * np.linspace(0, 1, grid + 1)
    below = np.floor(at)
    return below, np.minimum(below + 1, n - 1), at - below


def best_level(values: np.ndarray, before: np.ndarray, good_before: np.ndarray, n: int, good: int, grid: int = GRID) -> float:
    """The best quantile by the distinct scores around all quantiles, and the rows (and those of label 1) before each."""
    below, above, part = around(n, grid)
    a, b = (values[np.searchsorted(before, x, side="right") - 1] for x in (below, above))
    levels = np.unique(np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part)))
    at = np.searchsorted(values, levels)  # no score lies between a level and the next of ``values``
    hit = (good - good_before[at]) / good + (before[at] - good_before[at]) / (n - good)
    best = levels[hit >= hit.max() - 1e-12]
    return float((best[0] + best[-1]) / 2)


def quantile_threshold(scores: np.ndarray, labels: np.ndarray, grid: int = GRID) -> float:
    """``threshold`` of scores in memory."""
    values, at, n = np.unique(scores, return_inverse=True, return_counts=True)
    good = np.bincount(at, weights=labels == 1)
    return best_level(values, np.cumsum(n) - n, np.cumsum(good) - good, len(scores), good.sum(), grid)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from KEEP on), one row per row of docs."""
    own = vectors(docs)
    model = fit(own, labels)
    return own.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD).alias("held_out"), model.score(F.col("f")).alias("score")) \
        .withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
