"""Whitening of embedding vectors by principal components.

Each partition counts its vectors and finds their mean and their scatter around that mean; Chan's formula merges two such
summaries, and a treeReduce merges all, so that the driver receives one matrix and nothing is summed far from its mean. The driver
finds the eigenvectors; a second pass projects every vector and checks, by the same summaries, that the covariance has become the identity.

Vectors are counted in steps of 1/64 (see `steps`), so that sums are exact whatever the order in which partitions are merged.

Defined cases: null vectors and those with a null or non-finite entry are dropped; null ids and repeated rows stay; vectors of each
length are whitened among themselves, as no covariance joins different lengths; components without variance (below TINY of the
first one's) are left out, so that a single vector or an empty one gives no row; steps beyond 2**40 count as 2**40; a deviation beyond
a long is null; an empty table gives an empty table; other columns, of whatever names, are kept as they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow

STEP = 64.0
SHIFT = 1_000_000
#: Steps in either direction, at most; components below this share of the first one's variance count as none.
FARTHEST = float(1 << 40)
TINY = 1e-10
COMPONENTS = 32


@dataclass
class Moments:
    """Number of vectors, their exact sum in steps, their mean and their scatter around it."""

    n: int
    total: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


Summary = dict[int, Moments]  # by the vectors' length


def moments(x: np.ndarray) -> Moments:
    """x: vectors x entries, at least one vector."""
    mean = x.mean(axis=0)
    centred = x - mean
    return Moments(len(x), [int(v) for v in x.sum(axis=0)], mean, centred.T @ centred)


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula: both scatters, and the scatter of the two means around the common one."""
    n, apart = a.n + b.n, b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(apart, apart) * (a.n / n * b.n)
    return Moments(n, [p + q for p, q in zip(a.total, b.total, strict=True)], a.mean + apart * (b.n / n), scatter)


def merge_summaries(a: Summary, b: Summary) -> Summary:
    out = dict(a)
    for length, m in b.items():
        out[length] = merged(out[length], m) if length in out else m
    return out


def steps(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row numbers and the vectors, in whole steps of 1/64, of the usable rows of a list column, for each length of vector."""
    lengths = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # null lists take no place
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    for length in sorted(set(lengths.tolist()) - {-1, 0}):
        at = np.flatnonzero(lengths == length)
        rows = values[starts[at][:, None] + np.arange(length)]
        good = np.isfinite(rows).all(axis=1)
        yield at[good], np.clip(np.floor(STEP * rows[good]), -FARTHEST, FARTHEST)


@dataclass
class Axes:
    """What whitens the vectors of one length: their number, sum, mean, the components as columns, their deviations and shares."""

    n: int
    total: list[int]
    mean: np.ndarray
    vectors: np.ndarray
    spread: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.vectors) / self.spread

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over all entries of (n * x - total) squared, exactly."""
        far = np.abs(x - self.mean).max(initial=0.0) * self.n
        if x.shape[1] * (far + 1) ** 2 < 2**62:
            apart = self.n * x.astype(np.int64) - np.array(self.total, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - t) ** 2 for v, t in zip(row, self.total, strict=True)) for row in x]
        return [d if d < 2**63 else None for d in exact]


def axes(m: Moments, most: int = COMPONENTS) -> Axes:
    """The components of greatest variance; each one's largest entry is positive."""
    values, vectors = np.linalg.eigh(m.covariance())
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > TINY * max(values[0], 0)).sum()))
    values, vectors = values[:keep], vectors[:, :keep]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(keep)])
    total = float(np.trace(m.covariance()))
    return Axes(m.n, m.total, m.mean, vectors * signs, np.sqrt(values), values / total if keep else values)


def summary(rows: DataFrame, column: str, project: dict[int, Axes] | None = None) -> Summary:
    """The moments of all usable vectors of a column, or of their projections, by the vectors' length."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Summary = {}
        for batch in batches:
            for _, x in steps(batch.column(0)):
                if len(x):
                    out = merge_summaries(out, {x.shape[1]: moments(project[x.shape[1]].project(x) if project else x)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["state"])

    bound_arrow(rows.sparkSession)
    states = rows.select(column).mapInArrow(local, "state binary").rdd
    if states.getNumPartitions() == 0:
        return {}
    return states.map(lambda r: pickle.loads(bytes(r[0]))).treeReduce(merge_summaries)


def fit(rows: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> dict[int, Axes]:
    """Axes for each length of vector, with the largest entry of |covariance - identity| that a second pass finds."""
    found = {length: axes(m, most) for length, m in summary(rows, column).items()}
    usable = {length: a for length, a in found.items() if len(a.spread)}
    if usable:
        for length, m in summary(rows.filter(F.size(column).isin(list(usable))), column, usable).items():
            usable[length].error = float(np.abs(m.covariance() - np.eye(len(m.mean))).max())
    return found


def whiten(rows: DataFrame, model: dict[int, Axes], column: str = "embedding") -> DataFrame:
    """Usable rows with n, deviation, whitened and explained (a value for each component) and identity_error.

    Columns of rows that have such a name are replaced.
    """
    added = T.StructType.fromDDL("n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    kept = [f for f in rows.schema.fields if f.name not in added.names]
    at = [f.name for f in kept].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for picked, x in steps(batch.column(at)):
                if not len(x):
                    continue
                a = model[x.shape[1]]
                y = a.project(x)
                ends = pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32())
                new = [pa.array([a.n] * len(x), pa.int64()), pa.array(a.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))]
                new += [pa.ListArray.from_arrays(ends, pa.array(np.tile(a.explained, len(x)))), pa.array([a.error] * len(x), pa.float64())]
                old = batch.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([*old.columns, *new], [*old.schema.names, *added.names])

    bound_arrow(rows.sparkSession)
    return rows.select([F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *added.fields]))


def components(rows: DataFrame, key: str) -> DataFrame:
    """One row for each vector and component of what `whiten` returns."""
    zipped = rows.select(key, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_of"))
    return zipped.select(key, (F.col("_at") + 1).alias("component"), "n", "deviation", F.col("_of.whitened").alias("whitened"), F.col("_of.explained").alias("explained"), "identity_error")
