"""Toxicity by gradient-boosted trees over dense features, calibrated (operator 7).

Features of a text: density of lexicon words, how near they stand to words of the second person,
density of lexicon words in disguise (digits and signs for letters), share of capitals and of words
in capitals, rates of exclamation marks, punctuation, digits and obfuscated words, length.  The
lexicon is a short list of English insults plus words and stems (first four to six letters, so
that inflected forms count) mined from the training rows: a term is taken if it stands in toxic
texts almost only, and in more of them than chance allows at the base rate over the whole
vocabulary.  (Near copies of one label count once: texts that agree in all four smallest hashes of
a band, of which there are four, are compared with the first text of the band, and folded into it
if their word sets are alike by ``ALIKE`` at least.)

The trees (Spark ML) are fitted on three quarters of a bounded sample of training rows, the
isotonic calibration of their margin on the rest.  Labels, lang, source and doc_id are never
features.

Edge cases: a null or empty text has all features 0 and gets the score of such a vector; without
training rows of both labels the score is the share of label 1 (0 without rows); repeated rows score
alike; a null doc_id is scored; other columns are never read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.labelled import FIT_ROWS, held_out, sample
from newsprism.llm.scratch import bound_batches, written

PARTS, HELD = 3, 1
REJECT = 0.7
#: Common English insults (fixed values).
INSULTS = ("idiot", "moron", "stupid", "dumb", "fool", "loser", "scum", "trash", "garbage", "clown", "pathetic", "worthless", "disgusting",
           "ugly", "liar", "pig", "coward", "jerk", "freak", "filth", "vermin", "imbecile", "cretin", "bastard", "bitch", "asshole", "shit",
           "fuck", "fucking", "crap", "retard", "whore", "slut")
#: Words of the second person (fixed values).
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos ti tuyo usted ustedes su sus".split())
#: Signs and digits that stand for letters (fixed values).
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", "#": ""})
NEAR = 5
MINED_WORDS = 2000
#: Bands, hashes of a band, and the Jaccard similarity of the word sets of near copies.
BANDS, BAND_HASHES, ALIKE = 4, 4, 0.8
STEMS = (4, 5, 6)
FEATURES = ("hits", "log_hits", "near_you", "you", "disguised", "obfuscated", "capitals", "shouted", "exclamations", "punctuation", "digits", "log_words")
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![\w@$*#!|])[^\W\d_]+[0-9@$*#!|]+[^\W_][\w@$*#!|]*")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_MARKS = re.compile(r"[.,;:!?\"'()]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")


class Lexicon:
    """Words, and stems written with a star at their end."""

    def __init__(self, terms):
        self.words = frozenset(t for t in terms if not t.endswith("*"))
        self.stems = [(n, frozenset(t[:-1] for t in terms if t.endswith("*") and len(t) == n + 1)) for n in STEMS]
        self.stems = [(n, s) for n, s in self.stems if s]

    def __contains__(self, word: str) -> bool:
        if word in self.words:
            return True
        for n, stems in self.stems:
            if word[:n] in stems:
                return True
        return False

    def places(self, words: list[str]) -> list[int]:
        """Places of the words that it holds."""
        found = {i for i, w in enumerate(words) if w in self.words}
        for n, stems in self.stems:
            found.update([i for i, w in enumerate(words) if w[:n] in stems])
        return sorted(found)


def features(text: str, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text.lower())
    n, chars = max(1, len(words)), len(text)
    hits = lexicon.places(words)
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR):i + NEAR + 1]) for i in hits)
    mixed = [w.lower() for w in _MIXED.findall(text)]
    disguised = sum(w.translate(DISGUISE) in lexicon for w in mixed)
    return [100 * len(hits) / n, math.log1p(len(hits)), near / max(1, len(hits)), 100 * sum(w in SECOND_PERSON for w in words) / n,
            100 * disguised / n, 100 * len(mixed) / n, len(_UPPER.findall(text)) / chars, len(_SHOUTED.findall(text)) / n,
            100 * text.count("!") / n, len(_MARKS.findall(text)) / chars, len(_DIGIT.findall(text)) / chars, math.log1p(len(words))]


def families(fit: DataFrame) -> DataFrame:
    """doc_id, label, words of the rows that hold words, near copies of one label folded."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)))
    rows = fit.select("doc_id", "label", words.alias("words")).where(F.size("words") > 0)
    rows = rows.groupBy("label", "words").agg(F.min("doc_id").alias("doc_id"))  # equal word sets

    def smallest(seed: int) -> Column:
        return F.array_min(F.transform("words", lambda w: F.xxhash64(F.lit(seed), w)))

    for band in range(BANDS):
        seeds = range(band * BAND_HASHES, (band + 1) * BAND_HASHES)
        rows = written(rows.select("doc_id", "label", "words", F.xxhash64("label", *map(smallest, seeds)).alias("h")), "band")
        first = rows.groupBy("h").agg(F.min(F.struct("doc_id", "words")).alias("r"), F.count("*").alias("n")).where("n > 1").select("h", "r")
        alike = F.size(F.array_intersect("words", "r.words")) >= ALIKE * F.size(F.array_union("words", "r.words"))
        copy = (F.col("doc_id") != F.col("r.doc_id")) & alike
        rows = rows.join(first, "h", "left").where(~F.coalesce(copy, F.lit(False))).select("doc_id", "label", "words")
    return written(rows, "families")


def mined_words(rows: DataFrame, most: int = MINED_WORDS) -> list[str]:
    """Words and stems of the families that mark toxic texts, at most ``most`` of them."""
    def stems(n: int) -> Column:
        return F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    terms = rows.select("label", F.explode(F.array_distinct(F.concat("words", *map(stems, STEMS)))).alias("word"))
    seen = terms.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("texts"))
    rate, n = rows.agg(F.avg("label"), F.count("*")).first()
    if not n or not 0 < rate < 1:
        return []
    seen = written(seen.where("toxic >= 3"), "vocabulary")
    size = max(1, seen.count())
    need = max(4, math.ceil(math.log(20 * size) / -math.log(rate)))
    good = seen.where((F.col("toxic") >= need) & (F.col("toxic") >= 0.95 * F.col("texts")) & (F.length("word") >= 3))
    # A term that a shorter stem of the list covers adds nothing.
    found = [r[0] for r in good.orderBy(F.desc("toxic"), F.length("word"), "word").limit(most).select("word").collect()]
    have = set(found)
    return [t for t in found if not any(n < len(t.rstrip("*")) and t[:n] + "*" in have for n in STEMS)]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    constant: float
    #: Training rows left out of the mining as near copies of others, or without words.
    folded: int = 0

    def scored(self, df: DataFrame, text: Column) -> DataFrame:
        """df with a column ``score``; every other column of df must be a struct or be named apart
        from Spark ML's (features, rawPrediction, probability, prediction)."""
        if self.trees is None:
            return df.withColumn("score", F.lit(self.constant))
        out = df.withColumn("features", array_to_vector(vector_of(text, self.lexicon)))
        out = self.trees.transform(out).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")
        out = self.calibration.transform(out)
        return out.withColumn("score", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))).drop("prediction", "margin")


def vector_of(text: Column, lexicon: Lexicon) -> Column:
    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py() or "", lexicon) for t in texts], pa.list_(pa.float64()))

    return vectors(F.coalesce(text.cast("string"), F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> ToxicityModel:
    """Learn from at most ``most`` labelled rows outside the held-out part."""
    bound_batches(docs.sparkSession)
    rows = sample(docs, labels, "toxic", PARTS, HELD, most)
    rate, n, both = rows.agg(F.avg("label"), F.count("*"), F.count_distinct("label")).first()
    if both < 2:
        return ToxicityModel(Lexicon(INSULTS), None, None, float(rate or 0.0))
    apart = families(rows)
    folded = n - apart.count()
    lexicon = Lexicon([*INSULTS, *mined_words(apart)])
    calib = F.pmod(F.crc32(F.concat(F.lit("calibrate:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(4)) == 0
    book = written(rows.select("doc_id", F.col("label").cast("double").alias("label"), calib.alias("calib"), vector_of(F.col("text"), lexicon).alias("f")), "features")
    # A bounded table: one task per level keeps the many small jobs of boosting short.
    book = book.coalesce(1).sortWithinPartitions("doc_id").withColumn("features", array_to_vector("f"))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=2, seed=7).fit(book.where(~F.col("calib")).select("features", "label"))
    margin = trees.transform(book.where(F.col("calib")).select("features", "label")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    if margin.select("label").distinct().count() < 2:  # a tiny sample: calibrate on all of it
        margin = trees.transform(book.select("features", "label")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="prediction").fit(margin)
    return ToxicityModel(lexicon, trees, calibration, float(rate), folded)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from REJECT on), one row per row of docs."""
    model = fit(docs, labels, most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return model.scored(own, F.col("text")).select("doc_id", held_out(F.col("doc_id"), PARTS, HELD).alias("held_out"), "score",
                                                   (F.col("score") >= REJECT).cast("int").alias("predicted"))


def harmless(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that score below REJECT; texts aren't shuffled."""
    model = fit(docs, labels, most)
    rows = model.scored(docs.select(F.struct("*").alias("row")), F.col("row.text"))
    return rows.where(F.col("score") < REJECT).select("row.*")
