"""Top lists of many queries in one scan of the items: every task keeps the best of its own rows, and few rows are shuffled.

Scores are computed for a batch of items and all queries at once as a product of matrices, which travels with the task. Queries are
taken in blocks of a bounded number of bytes; each block scans the items once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from ..functions.batches import bound_batches

#: Bytes of what describes the queries of one scan, and scores of one product, at most.
QUERY_BYTES = 64 << 20
PRODUCT = 1 << 21
#: Hits that wait to be merged with the best so far, about.
HELD = 1 << 18


class Best:
    """For each of n queries the k best items so far, by score and then item."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.item: np.ndarray | None = None
        self.least = np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, items: np.ndarray) -> None:
        """scores: items x queries; -inf for what is no hit."""
        least = self.least
        if len(scores) > 4 * self.k:  # below the k-th best of these items alone nothing is kept, so that few are sorted
            least = np.fmax(least, np.partition(scores, -self.k, axis=0)[-self.k])
        row, query = np.nonzero((scores >= least) & (scores > -np.inf))
        self.merge(query, items[row], scores[row, query])

    def hold(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        """Hits as one row each, merged once there are as many as are kept, and no fewer than HELD."""
        self.held.append((query, item, score))
        if sum(len(q) for q, _, _ in self.held) >= max(HELD, len(self.query)):
            self.flush()

    def flush(self) -> None:
        if self.held:
            held, self.held = self.held, []
            self.merge(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def merge(self, query: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        """Hits as one row each."""
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        item = item if self.item is None else np.concatenate([self.item, item])
        order = np.lexsort((item, -score, query))
        query, score, item = query[order], score[order], item[order]
        start = np.searchsorted(query, np.arange(self.n))
        kept = np.arange(len(query)) - start[query] < self.k
        self.query, self.score, self.item = query[kept], score[kept], item[kept]
        full = np.bincount(self.query, minlength=self.n) >= self.k
        last = np.searchsorted(self.query, np.arange(self.n), side="right") - 1
        self.least[full] = self.score[last[full]]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def numbers(column: pa.Array) -> np.ndarray:
    """Item ids as an array that sorts as they do."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=str)


def best_of_tasks(items: DataFrame, asked: list[Row], schema: StructType, k: int, score: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], item: DataType | None = None) -> DataFrame:
    """query_id, item, score: the k best of each task for each of the queries asked.

    items has a column item, of the type given if its rows hold several; score turns a batch into pairs of scores (items x queries) and items.
    """

    def add(batch: pa.RecordBatch, best: Best) -> None:
        for scores, found in score(batch):
            best.add(scores, found)

    return added_best(items, asked, schema, k, add, item)


def added_best(items: DataFrame, asked: list[Row], schema: StructType, k: int, add: Callable[[pa.RecordBatch, Best], None], item: DataType | None = None) -> DataFrame:
    """The same, where add puts a batch's hits to those that the task has so far."""
    item_type = item or items.schema["item"].dataType
    ids = [r.asDict(recursive=True)["query_id"] for r in asked]
    kind, item_kind = to_arrow_type(schema["query_id"].dataType), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            add(batch, best)
        best.flush()
        if best.item is not None and len(best.query):
            columns = [pa.array([ids[q] for q in best.query.tolist()], kind), pa.array(best.item.tolist(), item_kind), pa.array(best.score)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "item", "score"])

    bound_batches(items.sparkSession)
    out = StructType([schema["query_id"], StructField("item", item_type)]).add("score", "double")
    return items.mapInArrow(run, out)


def query_blocks(queries: DataFrame, each_bytes: int, most: int = QUERY_BYTES) -> Iterator[list[Row]]:
    """The queries in blocks that fit in `most` bytes, by a hash of their ids; only one block is on the driver at a time."""
    n = queries.count()
    blocks = max(1, -(-n * each_bytes // most))
    for i in range(blocks):
        rows = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        yield rows.collect()
