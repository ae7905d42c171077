"""Exact nearest neighbours of a set of query vectors, with metadata filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import top_k
from .scan import PRODUCT, Best, added_best, numbers, query_blocks, rounded

#: Bytes of the query vectors of one scan, queries of one product, items of a task's first products, and hits whose scores are worked out at once.
BLOCK_BYTES, AT_ONCE, FIRST, EXACT = 16 << 20, 1024, 16, 1 << 14


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the length asked for as rows, and which entries of the column they are."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(kept)).flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(kept), dim), kept


def likely(rows: np.ndarray, q: np.ndarray, least: np.ndarray, metric: str, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a row and a query may score as much as the query's least, rounded; all that do are among them.

    Products are of single precision where the numbers allow it, and the bound is lowered by more than they can be wrong.
    """
    biggest = max(np.abs(rows).max(initial=0), np.abs(q).max(initial=0))
    kind = np.float32 if biggest < 1e15 else np.float64  # NaN goes the slower way
    long, wide = (rows**2).sum(1), (q**2).sum(1)
    need = least - 10.0**-digits
    if metric == "l2":
        with np.errstate(divide="ignore"):
            need = np.where(need > 0, (wide + 1 - 1 / need) / 2, -np.inf)  # and half of the row's square
    slack = (q.shape[1] + 8) * 2.0**-22 * np.sqrt(long.max(initial=0) * wide) + 2.0**-22 * np.abs(need) + 1e-30
    if metric == "l2":
        slack += 2.0**-22 * (long.max(initial=0) + wide)
    value = rows.astype(kind) @ q.astype(kind).T
    if metric == "l2":
        value -= (long / 2).astype(kind)[:, None]
    return np.nonzero(value >= (need - slack).astype(kind))


def pair_scores(rows: np.ndarray, q: np.ndarray, row: np.ndarray, query: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Scores of these pairs, in double precision."""
    out = np.zeros(len(row))
    for i in range(0, len(row), EXACT):
        x, y = rows[row[i : i + EXACT]], q[query[i : i + EXACT]]
        value = np.einsum("ij,ij->i", x, y)
        out[i : i + EXACT] = 1 / (1 + np.maximum((x**2).sum(1) + (y**2).sum(1) - 2 * value, 0)) if metric == "l2" else value
    return rounded(out, digits)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", digits: int = 6) -> DataFrame:
    """vectors: item, vector; queries: query_id, vector. Returns query_id, item, score, rank.

    metric l2 scores 1 / (1 + squared distance), cosine the dot product. Every query meets every vector of its length, once for a block of
    queries; each task keeps its k best of each query, and works out exact scores of those pairs alone that may be among them. Null and empty vectors are left out.
    """
    items, asked_for = vectors.select("item", "vector"), queries.select("query_id", "vector").filter(F.size("vector") > 0)
    longest = asked_for.select(F.max(F.size("vector"))).first()[0] or 0
    out = None
    for asked in query_blocks(asked_for, 8 * max(1, longest), BLOCK_BYTES):
        at: dict[int, list[int]] = {}
        for i, r in enumerate(asked):
            at.setdefault(len(r["vector"]), []).append(i)
        by_length = {dim: (np.array(rows), np.array([asked[i]["vector"] for i in rows], float)) for dim, rows in at.items()}

        def add(batch: pa.RecordBatch, best: Best, by_length: dict = by_length) -> None:
            every = numbers(batch.column("item"))
            for dim, (mine, q) in by_length.items():
                rows, kept = matrix(batch.column("vector"), dim)
                start, step = 0, FIRST if (best.least[mine] == -np.inf).any() else PRODUCT // AT_ONCE
                while start < len(rows):
                    part, ids = rows[start : start + step], every[kept[start : start + step]]
                    for j in range(0, len(q), AT_ONCE):
                        row, query = likely(part, q[j : j + AT_ONCE], best.least[mine[j : j + AT_ONCE]], metric, digits)
                        value = pair_scores(part, q[j : j + AT_ONCE], row, query, metric, digits)
                        number = value > -np.inf
                        best.hold(mine[j + query[number]], ids[row[number]], value[number])
                    if (best.least[mine] == -np.inf).any():
                        best.flush()
                    start, step = start + step, min(2 * step, PRODUCT // AT_ONCE)

        best = added_best(items, asked, queries.schema, k, add)
        out = best if out is None else out.union(best)
    return top_k(out, k, item="item")


def filtered(chunks: DataFrame, section: str | None = None, has_figures: bool | None = None, pages: tuple[int, int] | None = None, criterion: str | None = None) -> DataFrame:
    """Metadata filters, all of which must hold; they reach the scan."""
    if section is not None:
        chunks = chunks.filter(F.col("section_title") == section)
    if has_figures is not None:
        chunks = chunks.filter(F.col("has_figure_reference") == has_figures)
    if pages is not None:
        chunks = chunks.filter((F.col("page_start") >= pages[0]) & (F.col("page_end") <= pages[1]))
    if criterion is not None:
        chunks = chunks.filter(F.col("criterion_id") == criterion)
    return chunks
