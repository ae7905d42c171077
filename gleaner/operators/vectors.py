"""A stored index of vectors: in folders by list, in chunks with a bitmap for each metadata value.

Below a path there are:

- chunks, in a folder for each list of an inverted file: up to CHUNK vectors of one list (items, values end to end), and for each metadata
  column and value that occurs among them a compressed bitmap of where (tags, by `column=value`);
- centres: each list's number and centre, with the number of lists to search that was tuned on the sample.

The number of lists follows the table's size. A search reads the folders of those lists alone that a query looks into. A filter on metadata leaves
out the chunks that lack a value wanted, and within the others the vectors whose bits are not set. Scores are exact; what lies in a list
that was not searched is missed, `recall` says how much. With `probes` as many as there are lists the search is exact.

Defined cases: null vectors and those of another length than the centres' are left out; null metadata has the value `null`; an empty table
has no lists and no hits; ties go to the smaller item.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ivf
from .bm25 import top_k
from .scan import best_of_tasks, query_blocks, rounded

CHUNK = 1024
MOST_LISTS = 4096


def lists_for(rows: int) -> int:
    """The number of lists for so many vectors: about the root of their number."""
    return max(1, min(MOST_LISTS, round(rows**0.5 * 0.75)))


def tag(column: str, value: object) -> str:
    return f"{column}={'null' if value is None else value}"


def bits(where: np.ndarray, n: int) -> bytes:
    marks = np.zeros(n, bool)
    marks[where] = True
    return zlib.compress(np.packbits(marks).tobytes())


def marked(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


def write(vectors: DataFrame, path: str, by: list[str], k: int = 10, share: float = 0.95) -> None:
    """vectors: item, vector and the metadata columns of `by`. Replaces the index below the path."""
    spark = vectors.sparkSession
    rows = vectors.select("item", "vector", *[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in by])
    n = rows.count()
    centres, probes = ivf.fit(rows.select("item", "vector"), lists_for(n), k, share, others=True)
    spark.createDataFrame([(i, [float(x) for x in c], probes) for i, c in enumerate(centres)], "list int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    dealt = ivf.listed(rows, centres, by)
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("items", T.ArrayType(vectors.schema["item"].dataType)), *T.StructType.fromDDL("values array<float>, n int, tags map<string, binary>").fields])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("list").to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                for start in range(a, b, CHUNK):
                    part = batch.slice(start, min(CHUNK, b - start))
                    tags: dict[str, np.ndarray] = {}
                    for c in by:
                        coded = part.column(c).dictionary_encode()
                        codes = coded.indices.to_numpy()
                        tags |= {tag(c, v): np.flatnonzero(codes == i) for i, v in enumerate(coded.dictionary.to_pylist())}
                    columns = [pa.array([at[start]], pa.int32()), pa.array([part.column("item").to_pylist()], pa.list_(part.column("item").type))]
                    values = part.column("vector").flatten().cast(pa.float32())
                    columns += [pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.array([part.num_rows], pa.int32())]
                    columns.append(pa.array([[(t, bits(w, part.num_rows)) for t, w in tags.items()]], pa.map_(pa.string(), pa.binary())))
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    placed = dealt.repartitionByRange("list", "item").sortWithinPartitions("list", "item")
    placed.mapInArrow(packed, schema).write.mode("overwrite").partitionBy("list").parquet(f"{path}/chunks")


def read(spark: SparkSession, path: str, item: str = "bigint") -> tuple[DataFrame, np.ndarray, int]:
    """The chunks, the centres and the number of lists to search."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    chunks = spark.read.schema(f"items array<{item}>, values array<float>, n int, tags map<string, binary>, list int").parquet(f"{path}/chunks")
    return chunks, np.array([r["centre"] for r in rows], float).reshape(len(rows), len(rows[0]["centre"]) if rows else 0), rows[0]["probes"] if rows else 0


def search(chunks: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, where: dict[str, list] | None = None, metric: str = "l2", digits: int = 6) -> DataFrame:
    """queries: query_id, vector. query_id, item, score, rank of the k nearest in the lists searched.

    where: for each metadata column the values allowed; all columns must hold.
    """
    spark, dim = chunks.sparkSession, centres.shape[1] if len(centres) else 0
    kind = chunks.schema["items"].dataType.elementType
    schema = T.StructType([queries.schema["query_id"], T.StructField("item", kind), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    out = spark.createDataFrame([], schema)
    if not dim:
        return out
    wanted = {c: [tag(c, v) for v in values] for c, values in (where or {}).items()}
    for asked in query_blocks(queries.select("query_id", "vector").filter(F.size("vector") == dim), 8 * dim):
        if not asked:
            continue
        q = np.array([r["vector"] for r in asked], float)
        looks = np.zeros((len(asked), len(centres)), bool)
        np.put_along_axis(looks, ivf.nearest(q, centres, probes), True, axis=1)

        def score(batch: pa.RecordBatch, q: np.ndarray = q, looks: np.ndarray = looks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n, tags = one.column("n")[0].as_py(), dict(one.column("tags")[0].as_py())
                kept = np.ones(n, bool)
                for names in wanted.values():
                    kept &= np.any([marked(tags[t], n) for t in names if t in tags] or [np.zeros(n, bool)], axis=0)
                mine = np.flatnonzero(looks[:, one.column("list")[0].as_py()])
                rows = one.column("values").flatten().to_numpy().astype(float).reshape(n, dim)[kept]
                if not len(rows) or not len(mine):
                    continue
                value = rows @ q[mine].T
                if metric == "l2":
                    value = 1 / (1 + np.maximum((rows**2).sum(1)[:, None] + (q[mine] ** 2).sum(1) - 2 * value, 0))
                scores = np.full((len(rows), len(q)), -np.inf)
                scores[:, mine] = rounded(value, digits)
                items = one.column("item").flatten()
                items = items.to_numpy() if pa.types.is_integer(items.type) else np.array(items.to_pylist(), dtype=str)
                yield scores, items[kept]

        found = some_lists(chunks, np.flatnonzero(looks.any(axis=0)).tolist(), wanted).withColumnRenamed("items", "item")
        best = best_of_tasks(found, asked, queries.schema, k, score, kind)
        out = out.unionByName(top_k(best, k, item="item"))
    return out


def some_lists(chunks: DataFrame, lists: list[int], wanted: dict[str, list[str]]) -> DataFrame:
    """The chunks in the folders of these lists that have, for each column, one of the tags wanted."""
    found = chunks.filter(F.col("list").isin(lists))
    for names in wanted.values():
        found = found.filter(F.exists(F.array(*[F.lit(t) for t in names]), lambda t: F.map_contains_key("tags", t)))
    return found


def reads(chunks: DataFrame, centres: np.ndarray, queries: DataFrame, probes: int, where: dict[str, list] | None = None) -> dict[str, int]:
    """How many lists, chunks and vectors the search of these queries reads, and how many the index has."""
    lists: set[int] = set()
    for asked in query_blocks(queries.select("query_id", "vector"), 8 * centres.shape[1]):
        lists |= set(ivf.nearest(np.array([r["vector"] for r in asked], float), centres, probes).ravel().tolist()) if asked else set()
    count = [F.count("*").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors")]
    wanted = {c: [tag(c, v) for v in values] for c, values in (where or {}).items()}
    own, every = some_lists(chunks, sorted(lists), wanted).agg(*count).first(), chunks.agg(*count).first()
    return {"lists_read": len(lists), "chunks_read": own["chunks"], "vectors_read": own["vectors"], "lists": len(centres), **every.asDict()}
