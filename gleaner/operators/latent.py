"""Learned vectors of texts: latent semantic analysis fitted over the whole corpus.

A text is a row of weights (1 + log of a term's count, times the term's rarity, scaled to unit length). Terms are hashed to FEATURES
columns with a sign, so that no vocabulary has to reach the driver. The strongest singular directions are found in a randomised block Krylov
space: a pass multiplies the rows' matrix and its transpose with a thin orthonormal block, partition by partition, the sums meet in a
treeReduce, and what they add to the blocks so far is the next block. PASSES of them and a small eigenproblem on the driver, which needs no further
pass, give the directions. Several blocks are kept because texts' singular values fall slowly, and a single one would need many more
passes. A text's vector is its row's projection, scaled to unit length, made in Arrow batches.

Defined cases: texts without terms, null ones included, have the zero vector; fewer than `size` directions (a corpus of few texts) leave
the others zero; an empty corpus gives a model whose vectors are all zero; repeated texts get equal vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..functions.text import terms
from ..sources.scratch import shared_path

FEATURES = 1 << 15
PASSES = 8
#: Columns of a block beyond the directions wanted, and weights that are multiplied at once.
SPARE = 16
AT_ONCE = 1 << 11
#: Directions weaker than this share of the strongest count as none.
TINY = 1e-9


def hashes(text: Column) -> Column:
    """A text's terms as hashes, in order; Arrow takes numbers faster than strings."""
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def features(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column and the sign of each hash."""
    return (hashed.view(np.uint64) >> np.uint64(1)).astype(np.int64) % FEATURES, 1.0 - 2.0 * (hashed & 1)


@dataclass
class Rows:
    """Texts' rows without their zeros: the row, column and weight of each entry, rows in order."""

    row: np.ndarray
    col: np.ndarray
    weight: np.ndarray
    n: int

    @classmethod
    def of(cls, lists: pa.Array | list, rarity: np.ndarray | None = None) -> Rows:
        """lists: the hashes of each text's terms. rarity: a factor for each column; without it weights are signed counts."""
        lists = lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(pa.int64()))
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        col, sign = features(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        cells, at = np.unique(np.repeat(np.arange(len(sizes)), sizes) * FEATURES + col, return_inverse=True)
        count = np.bincount(at, sign, minlength=len(cells))
        cells, count = cells[count != 0], count[count != 0]
        row, col = cells // FEATURES, cells % FEATURES
        return cls(row, col, count, len(sizes)).weighed(rarity)

    @classmethod
    def stored(cls, cols: pa.Array, counts: pa.Array, rarity: np.ndarray | None = None) -> Rows:
        """cols, counts: the columns and signed counts of each text."""
        sizes = cols.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        col, count = (x.flatten().to_numpy(zero_copy_only=False) for x in (cols, counts))
        return cls(np.repeat(np.arange(len(sizes)), sizes), col.astype(np.int64), count.astype(float), len(sizes)).weighed(rarity)

    def weighed(self, rarity: np.ndarray | None) -> Rows:
        """The rows of signed counts with weights in their place."""
        if rarity is None:
            return self
        row, col, count = self.row, self.col, self.weight
        weight = np.sign(count) * (1 + np.log(np.abs(count))) * rarity[col]
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=self.n))
        return Rows(row, col, weight / np.where(norm > 0, norm, 1)[row], self.n)

    def parts(self) -> Iterator[Rows]:
        """The rows, some at a time, so that products stay small; a row longer than that alone."""
        start = 0
        while start < len(self.row):
            end = min(len(self.row), start + AT_ONCE)
            if end < len(self.row):
                end = int(np.searchsorted(self.row, self.row[end]))
                end = end if end > start else int(np.searchsorted(self.row, self.row[start], side="right"))
            first = self.row[start]
            yield Rows(self.row[start:end] - first, self.col[start:end], self.weight[start:end], int(self.row[end - 1] - first) + 1)
            start = end

    def times(self, right: np.ndarray) -> np.ndarray:
        """The product with a matrix of a row for each column."""
        out = np.zeros((self.n, right.shape[1]))
        for part, first in zip(self.parts(), self.firsts(), strict=True):
            starts = np.flatnonzero(np.append(True, part.row[1:] != part.row[:-1]))
            out[first + part.row[starts]] = np.add.reduceat(part.weight[:, None] * right[part.col], starts, axis=0)
        return out

    def firsts(self) -> Iterator[int]:
        start = 0
        for part in self.parts():
            yield int(self.row[start])
            start += len(part.row)

    def back(self, left: np.ndarray, into: np.ndarray) -> None:
        """Add the transpose's product with a matrix of a row for each text."""
        starts = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1])) if len(self.row) else np.zeros(0, np.int64)
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(self.row)], strict=False):
            into[self.col[i:j]] += self.weight[i:j, None] * left[self.row[i]]  # a text's columns are different


@dataclass
class Model:
    """What turns texts into vectors: each column's rarity and its place among the directions, and the singular values."""

    rarity: np.ndarray
    directions: np.ndarray
    values: np.ndarray

    def vectors(self, lists: pa.Array | list) -> np.ndarray:
        out = Rows.of(lists, self.rarity).times(self.directions)
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def column(self, text: Column) -> Column:
        """A column of vectors; in place of embed_text for texts and queries alike."""

        def embedded(hashed: pd.Series) -> pd.Series:
            return pd.Series(list(self.vectors([h if h is not None else [] for h in hashed])))

        bound_batches()
        return F.pandas_udf(embedded, "array<double>")(hashes(text))


def summed(rows: DataFrame, local, zero):  # noqa: ANN001, ANN201
    """The sum over all partitions of what local makes of the batches of one: a matrix, or what merges by +."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(local(batches))], pa.binary())], ["part"])

    parts = rows.mapInArrow(run, "part binary").rdd
    return parts.map(lambda r: pickle.loads(bytes(r[0]))).treeReduce(lambda a, b: a + b) if parts.getNumPartitions() else zero


def counted(docs: DataFrame, text: str) -> DataFrame:
    """cols, counts: the columns and signed counts of each text, stored, as every pass reads them again."""
    path = shared_path(docs.sparkSession, "latent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Rows.of(batch.column(0))
            ends = pa.array(np.searchsorted(found.row, np.arange(found.n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (found.col, found.weight)], ["cols", "counts"])

    bound_batches(docs.sparkSession)
    docs.select(hashes(F.col(text)).alias("hashes")).mapInArrow(run, "cols array<int>, counts array<int>").write.parquet(path)
    return docs.sparkSession.read.schema("cols array<int>, counts array<int>").parquet(path)


def fit(docs: DataFrame, text: str = "text", size: int = 64, passes: int = PASSES, seed: int = 11) -> Model:
    """A model of `size` directions from every text. The driver holds 2 * passes matrices of FEATURES rows and size + SPARE columns, whatever the corpus."""
    rows = counted(docs, text)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(FEATURES + 1)
        for batch in batches:
            found = Rows.stored(*batch.columns)
            out += np.bincount(found.col, minlength=FEATURES + 1)
            out[FEATURES] += found.n
        return out

    seen = summed(rows, frequencies, np.zeros(FEATURES + 1))
    n, df = seen[FEATURES], seen[:FEATURES]
    rarity = np.log((n + 1) / (df + 1)) + 1
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(FEATURES, size + SPARE)))[0]
    basis, products = block[:, :0], block[:, :0]
    for _ in range(passes):

        def gram(batches: Iterator[pa.RecordBatch], block: np.ndarray = block) -> np.ndarray:
            out = np.zeros_like(block)
            for batch in batches:
                found = Rows.stored(*batch.columns, rarity)
                found.back(found.times(block), out)
            return out

        product = summed(rows, gram, np.zeros_like(block))
        basis, products = np.hstack([basis, block]), np.hstack([products, product])
        block = product
        for _ in range(3):  # what rounding leaves of the blocks so far grows where little else is left, so that it is taken off again
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    core = basis.T @ products
    values, turns = np.linalg.eigh((core + core.T) / 2)
    values, turns = np.maximum(values[::-1][:size], 0), turns[:, ::-1][:, :size]
    directions = basis @ turns * (values > TINY * max(values[0], TINY))
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(size)])
    return Model(rarity, directions * signs, np.sqrt(values))


def embedded(docs: DataFrame, model: Model, text: str = "text", name: str = "vector") -> DataFrame:
    """docs with their vectors."""
    return docs.withColumn(name, model.column(F.col(text)))
