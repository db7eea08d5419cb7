"""Rule bitmask ledger (operator 5).

Every rule is evaluated once per document into a *ledger*: the measurements and one failure bit
per rule.  A policy is a versioned mask over those bits, so verdicts of any policy, the share
each rule removes and every leave-one-rule-out ablation come from the ledger by bitwise
operations, without reading a text again.

Edge cases: a null or empty text has no words and fails ``few_words``; rules that are shares of
words or lines never fail on a text without words; repeated rows are judged one by one; a null
doc_id is carried through; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.bytewords import SPACE, Words, blocks, buffers
from newsprism.llm.scratch import bound_batches

#: Rule -> SQL condition over the measurements that makes a document fail.  Bit = place.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "10 * word_chars < 15 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
}
BASE = ("few_words", "repeated_words")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Policy:
    """A version of the policy: a document is rejected if a rule of ``rules`` fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(r) for r in self.rules)


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


POLICIES = (Policy("v1", BASE), Policy("v2", tuple(RULES)))


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text (see the contract of the query for their meaning)."""
    raw, offsets = buffers(texts)
    out = {m: np.zeros(len(offsets) - 1, dtype=np.int64) for m in MEASURES}
    for i, j in blocks(offsets):
        w = Words(raw, offsets, i, j, fold_case=False)
        b, offs = w.data, w.docs
        out["n_words"][i:j] = np.diff(w.bounds)
        out["word_chars"][i:j] = _per_doc(((b & 0xC0) != 0x80) & ~SPACE[b], offs)
        out["n_symbols"][i:j] = _per_doc(_SYMBOL[b], offs)
        out["n_capitals"][i:j] = _per_doc((b >= 65) & (b <= 90), offs)
        triples = w.windows(3)
        newlines = _per_doc(b == 10, offs)
        for d in range(j - i):
            lo, hi = w.bounds[d], w.bounds[d + 1]
            if hi - lo >= 3:
                _, place, times = np.unique(triples[lo:hi - 2], return_inverse=True, return_counts=True)
                again = times[place] > 1
                if again.any():
                    covered = np.zeros(hi - lo, dtype=bool)
                    for x in range(3):
                        covered[x:x + len(again)] |= again
                    out["n_repeat_words"][i + d] = int(covered.sum())
            if hi > lo:
                out["n_lines"][i + d] = 1
                if newlines[d]:
                    lines = [x for x in b[offs[d]:offs[d + 1]].tobytes().split(b"\n") if x.strip(b" \t\n\v\f\r")]
                    out["n_lines"][i + d] = len(lines)
                    out["n_dup_lines"][i + d] = len(lines) - len(set(lines))
    return out


def failure_bits() -> Column:
    """One long with bit i set if rule i fails."""
    mask = F.lit(0).cast("long")
    for rule, condition in RULES.items():
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return mask


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, ``failed`` (the bits), one row per row of docs."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            m = measure(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[k]) for k in MEASURES)], names=["doc_id", *MEASURES])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumn("failed", failure_bits())


def rejects(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """policy, rule, n_failed (the rule fails), n_alone (no other rule of the policy fails: what
    the policy would win back without it), n_rejected (by the policy).

    The ledger is folded to one count per distinct mask (at most 2^rules rows) before any rule
    or policy is looked at.
    """
    masks = book.groupBy("failed").agg(F.count("*").alias("n"))
    plan = F.array(*(F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r).alias("rule"),
                              F.lit(bit(r)).cast("long").alias("bit")) for p in policies for r in p.rules))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return masks.select("failed", "n", F.explode(plan).alias("p")).select("failed", "n", "p.*").groupBy("policy", "rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_alone"), total(hit != 0).alias("n_rejected"))


def judged(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    base = rejects(Policy("base", BASE))
    return ledger(docs).withColumns({"base_failed": base, "kept": ~(base | rejects(policy))})


def passing(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The rows of docs, with all their columns, that no rule of the policy rejects.

    The measurements are a scalar Arrow function beside the row, so texts are not shuffled.
    """
    bound_batches(docs.sparkSession)
    kind = "struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">"

    @F.arrow_udf(kind)
    def measured(texts: pa.Array) -> pa.Array:
        m = measure(texts)
        return pa.StructArray.from_arrays([pa.array(m[k]) for k in MEASURES], names=list(MEASURES))

    one = docs.select(F.struct("*").alias("row"), measured(F.col("text").cast("string")).alias("m"))
    book = one.select("row", "m.*").withColumn("failed", failure_bits())
    return book.where(~(rejects(policy) | rejects(Policy("base", BASE)))).select("row.*")
