"""Whitening of embeddings by shifted CholeskyQR (operator 12).

* **Integers.**  An entry c becomes x = floor(1024 c) + 100000; n and the sums S of each dimension
  are exact integers.  All later passes work on centred rows y = x - S / n.
* **Orthogonalising.**  Each pass maps a row y through the triangular factors found so far,
  q = y / R1 / R2 ..., by back substitution, and adds up the Gram matrix of the q, one matrix per
  task, summed by Spark.  The driver factors the d x d matrix by Cholesky, after adding a shift of
  the size of its rounding error as long as it is not yet the identity on its range, and the next pass has one
  factor more.  The shift keeps the factorisation alive for ill-conditioned and rank-deficient
  tables; passes repeat until every direction is of length 1 or 0 (three as a rule).
* **Components.**  The factors are composed to R (Y = Q R); its right singular vectors are the unit
  eigenvectors of the covariance, its squared singular values over n the eigenvalues.  The
  sign is that with the largest entry positive.  Directions without variance (below 1e-12 of the
  largest eigenvalue) have no component.

Each pass reads the vectors once, and a task sends d * d / 2 numbers at most; the driver holds
d x d matrices, whatever the number of rows (d is the length of a vector).

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped, so are vectors
of another length than most (ties: the shorter; a defect of the table); null and repeated ids are
rows as any other; entries beyond 2^40 in size count as that; ``deviation`` is null where it
exceeds a long; equal vectors throughout (no variance) and an empty table give an empty result;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.llm.scratch import bound_batches

SCALE, LIFT = 1024.0, 100_000
COMPONENTS = 8
#: Passes at most; a Gram matrix this close to a projection is orthonormal; least eigenvalue of a component.
PASSES, CLOSE, LEAST = 12, 1e-13, 1e-12
WIDEST = 2.0 ** 40
_LOW = (1 << 20) - 1


# --- rows of one batch ------------------------------------------------------------------------

def lifted(vectors: pa.Array, dim: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places of the usable vectors of that length, their integers)."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)    # null entries read as NaN
    sizes = np.diff(offsets)
    usable = vectors.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    for d in [dim] if dim is not None else np.unique(sizes[usable]).tolist():
        if not d:
            continue
        at = np.flatnonzero(usable & (sizes == d))
        rows = flat[offsets[:-1][at][:, None] + np.arange(d)]
        good = np.isfinite(rows).all(axis=1)
        out[d] = at[good], (np.floor(np.clip(rows[good] * SCALE, -WIDEST, WIDEST))).astype(np.int64) + LIFT
    return out


def substituted(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows y times the inverses of upper triangular factors, first one first."""
    for r in factors:
        q = np.empty_like(y)
        for j in range(len(r)):
            q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        y = q
    return y


# --- sums over all rows -------------------------------------------------------------------------

def _per_task(rows: DataFrame, step: Callable[[pa.RecordBatch, dict], None], schema: str) -> DataFrame:
    """A task's numbers: ``step`` adds a batch to {key: array}; a row (key, j, value) per number at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            step(b, held)
        for key, numbers in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(numbers), pa.int64()), pa.array(np.arange(len(numbers))), pa.array(numbers)],
                                             ["key", "j", "value"])
    return rows.mapInArrow(run, schema)


def integer_sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Length of the vectors, how many there are, and the exact sum of each dimension."""
    def step(b, held):
        for d, (at, x) in lifted(b.column(0)).items():
            # High and low parts, so that no partial sum overflows.
            add = np.concatenate([[len(at)], (x >> 20).sum(axis=0), (x & _LOW).sum(axis=0)])
            held[d] = held.get(d, 0) + add
    sums = _per_task(rows, step, "key long, j long, value long").groupBy("key", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
    per_length = sums.where("j = 0 AND s > 0").orderBy(F.desc("s"), "key").limit(1).collect()
    if not per_length:
        return 0, 0, []
    d, n = per_length[0]["key"], int(per_length[0]["s"])
    part = {r["j"]: int(r["s"]) for r in sums.where(F.col("key") == d).collect()}  # 2 d + 1 rows
    return d, n, [(part[1 + j] << 20) + part[1 + d + j] for j in range(d)]


def _total(rows: DataFrame, d: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of ``of`` (a batch's integers -> ``width`` numbers)."""
    def step(b, held):
        for _, x in lifted(b.column(0), d).values():
            if len(x):
                held[0] = held.get(0, 0.0) + of(x)
    sums = _per_task(rows, step, "key long, j long, value double").groupBy("j").agg(F.sum("value").alias("s")).collect()
    out = np.zeros(width)
    for r in sums:
        out[r["j"]] = r["s"]
    return out


def _gram(rows: DataFrame, d: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The Gram matrix of the rows that ``of`` makes of the integers; its upper triangle travels."""
    upper = np.triu_indices(width)

    def triangle(x):
        q = of(x)
        return (q.T @ q)[upper]
    out = np.zeros((width, width))
    out[upper] = _total(rows, d, len(upper[0]), triangle)
    return out + np.triu(out, 1).T


# --- the factors ---------------------------------------------------------------------------------

def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each dimension as a whole number and the rest of it."""
    return np.array([s // n for s in sums]), np.array([s % n / n for s in sums])


def qr_factors(rows: DataFrame, d: int, n: int, mean: tuple[np.ndarray, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Triangular factors R1, R2, ... and the Gram matrix that rows mapped through all of them have."""
    factors: list[np.ndarray] = []
    for _ in range(PASSES):
        known = list(factors)
        gram = _gram(rows, d, d, lambda x: substituted((x - mean[0]) - mean[1], known))  # noqa: B023
        if not gram.any():
            return factors, gram
        lengths = np.linalg.eigvalsh(gram)
        if factors and (np.minimum(abs(lengths - 1), abs(lengths)) <= CLOSE * d).all():
            return factors, gram
        shift = 11 * (n * d + d * (d + 1)) * 2.0 ** -53 * lengths[-1]
        # Once the lengths are those of an orthonormal basis no shift is needed.
        sound = lengths[0] > max(1e-3 * lengths[-1], 0)
        factors.append(np.linalg.cholesky(gram + (0 if sound else min(shift, 1e-3 * lengths[-1])) * np.eye(d)).T)
    return factors, gram


def components(factors: list[np.ndarray], gram: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns), eigenvalues and the trace of the covariance."""
    r = np.eye(len(gram))
    for f in factors:
        r = f @ r
    lengths, basis = np.linalg.eigh(gram)
    r = np.sqrt(np.clip(lengths, 0, None))[:, None] * basis.T @ r
    _, sizes, rows = np.linalg.svd(r)
    values = sizes ** 2 / n
    keep = int(min(most, (values > LEAST * values[0]).sum())) if values[0] > 0 else 0
    vectors = rows[:keep].T
    for k in range(keep):
        if vectors[abs(vectors[:, k]).argmax(), k] < 0:
            vectors[:, k] = -vectors[:, k]
    return vectors, values[:keep], float(values.sum())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    y = x - whole                                    # n x - S = n y - rest
    most = (n * (int(abs(y).max(initial=0)) + 1)) ** 2 * x.shape[1]
    if most < 1 << 63:
        t = n * y - np.array(rest, dtype=np.int64)
        return (t * t).sum(axis=1).tolist()
    t = n * y.astype(object) - np.array(rest, dtype=object)
    return [v if v < 1 << 63 else None for v in (int(s) for s in (t * t).sum(axis=1))]


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per usable vector and component."""
    spark = rows.sparkSession
    bound_batches(spark)
    id_type = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = rows.select(vector)
    d, n, sums = integer_sums(vectors)
    if not n:
        return spark.createDataFrame([], schema)
    mean = centre(n, sums)
    factors, gram = qr_factors(vectors, d, n, mean)
    basis, values, trace = components(factors, gram, n, most)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)

    def white(x: np.ndarray) -> np.ndarray:
        return ((x - mean[0]) - mean[1]) @ basis / np.sqrt(values)
    middle = _total(vectors, d, k, lambda x: white(x).sum(axis=0)) / n
    error = float(abs(_gram(vectors, d, k, lambda x: white(x) - middle) / n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = lifted(b.column(1), d)[d]
            each = np.repeat(at, k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                 pa.array(np.full(len(each), n), pa.int64()), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                 pa.array(white(x).ravel()), pa.array(np.tile(values / trace, len(at))), pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.select(F.col(vec_id).alias("vec_id"), vector).mapInArrow(run, schema)
