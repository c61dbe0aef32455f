"""PCA whitening of embeddings, with a covariance merged by Chan's formula and an identity check on the result.

Each task reduces its vectors to a count, a mean and a scatter matrix centred on that mean; a treeReduce merges pairs of
these, so what meets in one place is one d x d matrix a branch. The driver decomposes the merged covariance, a second
pass over all vectors measures the covariance of the whitened values, and a third writes them. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, OFFSET = 64, 1_000_000
#: Entries beyond this size saturate, so that whole numbers made of them fit 53 bits.
LARGEST = float(1 << 52)
#: Vectors that one product of matrices takes, in entries.
BLOCK = 1 << 20


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of vectors; `low` and `high` bound the entries of whole numbers."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray
    low: list[int]
    high: list[int]

    @classmethod
    def of(cls, rows: np.ndarray, whole: bool = True) -> Moments:
        mean = rows.mean(axis=0)
        centred = rows - mean
        if not whole:
            return cls(len(rows), [], mean, centred.T @ centred, [], [])
        as_ints = lambda v: [int(x) for x in v]
        # Entries are whole and below 2**53; sums of them are taken in halves, so that none leaves a long.
        ints = rows.astype(np.int64)
        sums = [(int(h) << 26) + int(lo) for h, lo in zip((ints >> 26).sum(axis=0), (ints & ((1 << 26) - 1)).sum(axis=0), strict=True)]
        return cls(len(rows), sums, mean, centred.T @ centred, as_ints(rows.min(axis=0)), as_ints(rows.max(axis=0)))


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's pairwise formula: scatter = A + B + (d d^T) n_a n_b / n, d being the difference of the means."""
    if a is None or b is None:
        return a if b is None else b
    n = a.n + b.n
    gap = b.mean - a.mean
    mean = a.mean + gap * (b.n / n)
    scatter = a.scatter + b.scatter + np.outer(gap, gap) * (a.n * (b.n / n))
    both = lambda f, x, y: [f(p, q) for p, q in zip(x, y, strict=True)]
    return Moments(n, both(int.__add__, a.sums, b.sums), mean, scatter, both(min, a.low, b.low), both(max, a.high, b.high))


def quantised(part: pa.Array) -> np.ndarray:
    """floor(64 c) of each entry, one row a vector, as doubles that hold whole numbers. The offset is left out: it moves
    neither covariance nor deviations, and doubles are more exact without it."""
    values = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(np.clip(values * STEPS, -LARGEST, LARGEST)).reshape(len(part), -1)


def _blocks(part: pa.Array) -> Iterator[np.ndarray]:
    if len(part):
        step = max(1, BLOCK // max(1, len(part[0])))
        for at in range(0, len(part), step):
            yield quantised(part.slice(at, step))


def moments(rows: DataFrame, vector: str, shown=None) -> Moments | None:
    """The Moments of all vectors, or of what `shown` makes of them; None without rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        held = None
        for batch in batches:
            for block in _blocks(batch.column(0)):
                held = merged(held, Moments.of(block) if shown is None else Moments.of(shown(block), whole=False))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["moments"])

    def load(row) -> Moments | None:
        import pickle

        return pickle.loads(row[0])

    summaries = rows.select(vector).mapInArrow(gather, "moments binary").rdd.map(load)
    return summaries.treeReduce(merged) if summaries.getNumPartitions() else None


@dataclass
class Whitening:
    """Axes (columns), the mean and what is needed to write the result. `explained` is None where nothing varies."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    mean: np.ndarray
    axes: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def __call__(self, block: np.ndarray) -> np.ndarray:
        return (block - self.mean) @ self.axes

    @classmethod
    def fit(cls, held: Moments, components: int) -> Whitening:
        cov = held.scatter / held.n
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1], axes[:, ::-1]
        trace = float(np.trace(cov))
        varies = values > max(values[0], 0) * len(values) * np.finfo(float).eps
        scaled = np.divide(axes, np.sqrt(np.where(varies, values, 1)))[:, :components]
        explained = [float(max(v, 0) / trace) if trace > 0 else None for v in values[:components]]
        mean = np.array([float(s // held.n) + (s % held.n) / held.n for s in held.sums])
        return cls(held.n, held.sums, held.low, held.high, mean, scaled[:, varies[:components]], explained)

    def deviations(self, block: np.ndarray) -> list[int] | np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact: in longs where the extremes of all vectors say that they fit."""
        far = [max(abs(self.n * lo - s), abs(self.n * hi - s)) for lo, hi, s in zip(self.low, self.high, self.sums, strict=True)]
        small = sum(f * f for f in far) < 1 << 63 and all(abs(self.n * v) < 1 << 62 for v in (*self.low, *self.high))
        kind = np.int64 if small else object
        gaps = block.astype(np.int64).astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return (gaps * gaps).sum(axis=1)


def usable(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(finite(c), F.lit(False))), F.lit(False))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error), one row a usable vector.

    Each entry c becomes floor(64 c) + 1000000 (entries beyond 2**52 in size saturate). `whitened` holds the vector on
    the unit eigenvectors of the covariance, over the root of the eigenvalue, the largest first; components that do not
    vary, by double precision, hold null. `explained` has each component's share of the variance, null where nothing
    varies. `deviation` is decimal(38), exact, null beyond that. Vectors of another length than the commonest (the longer
    one of two as common) drop out, as do null ones; the empty length is none. Ids may be null or repeat: every row is
    fitted and returned. Other columns are dropped; without usable vectors there are no rows.
    """
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & (F.size("vector") > 0))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if length is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == length["length"])
    fitted = Whitening.fit(moments(rows, "vector"), components)
    if fitted.axes.shape[1]:
        after = moments(rows, "vector", fitted)
        fitted.identity_error = float(np.abs(after.scatter / after.n - np.eye(fitted.axes.shape[1])).max())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = 10**38
        for batch in batches:
            at = 0
            for block in _blocks(batch.column("vector")):
                size, width, own = len(block), len(fitted.explained), fitted.axes.shape[1]
                values, empty = np.zeros((size, width)), np.zeros((size, width), dtype=bool)
                values[:, :own], empty[:, own:] = fitted(block), True
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (size + 1) * width, width, dtype=np.int32)), pa.array(values.ravel(), mask=empty.ravel()))
                far = fitted.deviations(block)
                far = pa.array(far).cast(pa.decimal128(38, 0)) if far.dtype == np.int64 else pa.array([_decimal(x) if x < limit else None for x in far], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, size), far, lists], names=["vec_id", "deviation", "whitened"])
                at += size

    written = rows.mapInArrow(write, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
    shares = F.array(*(F.lit(e).cast("double") for e in fitted.explained))
    return written.select("vec_id", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(fitted.identity_error).cast("double").alias("identity_error"))


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(x)


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component, numbered from 1; deviations beyond a long become null."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "held")
    flat = whitened.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", pairs)
    return flat.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("held.whitened").alias("whitened"), F.col("held.explained").alias("explained"), "identity_error")
