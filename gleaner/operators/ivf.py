"""Approximate nearest neighbours by an inverted file: vectors in lists around centres, and searches in the lists nearest to a query.

The centres are fitted on a bounded sample of the vectors (`most`, drawn by a hash of their ids), and so is the number of lists to search; every vector
is in a list. Scores are exact, so that only a vector in a list that was not searched can be missed; `recall` measures how many are.

Defined cases: null vectors and those of another length than the first centre's are left out; an empty table has no centres and no
neighbours; ties go to the smaller item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bm25 import top_k
from .knn import matrix, neighbours
from .scan import best_of_tasks, numbers, query_blocks, rounded

#: Vectors on which the centres are fitted, at most.
SAMPLE = 20_000
ROUNDS = 12


def nearest(rows: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    distance = (centres**2).sum(1) - 2 * rows @ centres.T
    return np.argsort(distance, axis=1, kind="stable")[:, :k]


def probes_for(data: np.ndarray, centres: np.ndarray, k: int, share: float, asked: int = 500, others: bool = False) -> int:
    """How many lists to search so that `share` of the k nearest among the sample's vectors lie in them, by some of them as queries.

    others: a query is not its own neighbour, which is right for queries that are no vectors of the index.
    """
    rows = np.linspace(0, len(data) - 1, min(asked, len(data))).astype(int)
    lists, order = nearest(data, centres)[:, 0], nearest(data[rows], centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None], axis=1)
    near = nearest(data[rows], data, min(k + others, len(data)))
    at = np.take_along_axis(place, lists[near], axis=1)
    counted = at[near != rows[:, None]] if others and len(data) > 1 else at
    return int(np.quantile(counted, share, method="higher")) + 1


def fit(vectors: DataFrame, lists: int, k: int = 10, share: float = 0.95, most: int = SAMPLE, others: bool = False) -> tuple[np.ndarray, int]:
    """Centres (rows) by k-means on at most `most` vectors (item, vector), those whose ids hash lowest, and the number of lists to search."""
    n = vectors.count()
    bound = F.lit(int(min(1.0, 2 * most / max(1, n)) * (1 << 30)))
    drawn = vectors.filter(F.col("vector").isNotNull()).withColumn("_draw", F.pmod(F.xxhash64("item"), F.lit(1 << 30))).filter(F.col("_draw") < bound)
    rows = [r["vector"] for r in drawn.orderBy("_draw", "item").limit(most).select("vector").collect()]
    if not rows:
        return np.zeros((0, 0)), 0
    data = np.array([r for r in rows if len(r) == len(rows[0])], float)
    centres = data[np.linspace(0, len(data) - 1, min(lists, len(data))).astype(int)]
    for _ in range(ROUNDS):
        at = nearest(data, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, at, data)
        sizes = np.bincount(at, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres, probes_for(data, centres, k, share, others=others)


def listed(vectors: DataFrame, centres: np.ndarray, more: list[str] | None = None) -> DataFrame:
    """vectors (item, vector and the columns of `more`) with the list of each."""
    kept_columns = ["item", "vector", *(more or [])]
    schema = StructType([vectors.schema[c] for c in kept_columns]).add("list", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = matrix(batch.column("vector"), centres.shape[1])
            part = batch.take(pa.array(kept))
            at = nearest(rows, centres)[:, 0] if len(kept) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32))], schema.names)

    return vectors.select(*kept_columns).mapInArrow(run, schema)


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, metric: str = "l2", digits: int = 6) -> DataFrame:
    """index: item, vector, list; queries: query_id, vector. query_id, item, score, rank from the `probes` lists nearest to each query.

    A batch's vectors meet, list by list, the queries that look into their list.
    """
    out = None
    for asked in query_blocks(queries.select("query_id", "vector"), 8 * max(1, centres.shape[1])):
        q = np.array([r["vector"] for r in asked], float).reshape(len(asked), centres.shape[1])
        looks = np.zeros((len(asked), len(centres)), bool)
        if len(asked):
            np.put_along_axis(looks, nearest(q, centres, probes), True, axis=1)

        def score(batch: pa.RecordBatch, q: np.ndarray = q, looks: np.ndarray = looks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            every, at = numbers(batch.column("item")), batch.column("list").to_numpy()
            rows, _ = matrix(batch.column("vector"), centres.shape[1])
            for one in np.unique(at):
                who, mine = np.flatnonzero(at == one), np.flatnonzero(looks[:, one])
                value = rows[who] @ q[mine].T
                if metric == "l2":
                    value = 1 / (1 + np.maximum((rows[who] ** 2).sum(1)[:, None] + (q[mine] ** 2).sum(1) - 2 * value, 0))
                scores = np.full((len(who), len(q)), -np.inf)
                scores[:, mine] = rounded(value, digits)
                yield scores, every[who]

        best = best_of_tasks(index, asked, queries.schema, k, score)
        out = best if out is None else out.union(best)
    return top_k(out, k, item="item")


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> float:
    """The share of the exact k nearest neighbours that was found."""
    exact = neighbours(vectors, queries, k, metric).select("query_id", "item")
    n = exact.count()
    return exact.join(found, ["query_id", "item"]).count() / n if n else 1.0
