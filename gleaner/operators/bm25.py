"""BM25: an index as tables, and top documents for a set of queries in one plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..functions.fixed import K1, B
from ..functions.text import terms
from .scan import PRODUCT, QUERY_BYTES, best_of_tasks, numbers, rounded

#: A table of query terms up to this many rows is broadcast; a larger one is joined by its key.
BROADCAST_TERMS = 200_000


@dataclass
class Index:
    """postings: term, doc_id, tf, dl. terms: term, df. corpus: n_docs, avg_len (one row)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def write(self, path: str) -> None:
        for name in ("postings", "terms", "corpus"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus")))


def lengths(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc_id"), terms(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> Index:
    """only (term): index these terms alone; lengths and the corpus's size still count all."""
    sized = lengths(docs, doc, text)
    words = sized.select("doc_id", "dl", F.explode("terms").alias("term"))
    if only is not None:
        only = only.select("term").distinct()
        if only.count() <= BROADCAST_TERMS:
            only = F.broadcast(only)
        words = words.join(only, "term", "left_semi")
    postings = words.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    # a term counts once for a document, which its own row tells
    each = sized.select(F.explode(F.array_distinct("terms")).alias("term"))
    found = each if only is None else each.join(only, "term", "left_semi")
    corpus = sized.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_len"))
    return Index(postings, found.groupBy("term").agg(F.count("*").alias("df")), corpus)


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """query_id, term, qtf."""
    words = queries.select(F.col(query).alias("query_id"), F.explode(terms(F.col(text))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def score(index: Index, wanted: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score of all documents that share a term with a query (query_id, term, qtf)."""
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    rare = wanted.join(index.terms, "term").crossJoin(F.broadcast(index.corpus)).withColumn("idf", idf)  # one row: a proven bound
    hits = rare.join(index.postings, "term")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), digits).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", value: str = "score") -> DataFrame:
    """The k best by value for each query, ties by item, with rank from 1."""
    order = Window.partitionBy(by).orderBy(F.col(value).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vocabulary(wanted: DataFrame) -> tuple[list[str], dict[object, list[tuple[int, int]]]]:
    """The different terms of the queries (query_id, term, qtf), and each query's terms by number with their counts."""
    number: dict[str, int] = {}
    asked: dict[object, list[tuple[int, int]]] = {}
    for r in wanted.collect():
        asked.setdefault(r["query_id"], []).append((number.setdefault(r["term"], len(number)), r["qtf"]))
    return list(number), asked


def best_documents(docs: DataFrame, wanted: DataFrame, k: int, doc: str = "doc_id", text: str = "text", digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query (query_id, term, qtf) that share a term with it.

    A document's terms are all in its own row, so that every task scores its documents where they lie, for all queries at once,
    and sends on its k best. Document frequencies come from a first scan. Queries whose terms don't fit in QUERY_BYTES
    go by way of an index.
    """
    n_queries, n_terms = wanted.agg(F.countDistinct("query_id"), F.countDistinct("term")).first()
    if 8 * n_queries * n_terms > QUERY_BYTES:
        return top_k(score(build_index(docs, doc, text, only=wanted), wanted, digits).filter("score > 0"), k)
    names, asked = vocabulary(wanted)
    words = pa.array(names, pa.string())
    items = docs.select(F.col(doc).alias("item"), terms(F.col(text)).alias("terms"))

    def counted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
        """How often each document has each term of the queries, documents' lengths, and which of the batch they are."""
        column = batch.column("terms")
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = pa.compute.index_in(column.flatten(), words).fill_null(-1).to_numpy(zero_copy_only=False)
        for i in range(0, len(column), step := max(1, PRODUCT // max(1, len(names)))):
            part = ends[i : i + step]
            first = ends[i - 1] if i else 0
            known = at[first : part[-1]]
            row = np.searchsorted(part, np.arange(first, part[-1]), side="right")
            cell = (row * len(names) + known)[known >= 0]
            yield np.bincount(cell, minlength=len(part) * len(names)).reshape(len(part), len(names)), np.diff(part, prepend=first), slice(i, i + step)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(names) + 2, np.int64)  # the documents and their terms in all behind the terms' frequencies
        for batch in batches:
            for tf, dl, _ in counted(batch):
                seen += np.append((tf > 0).sum(0), [len(dl), int(dl.sum())])
        yield pa.RecordBatch.from_arrays([pa.array([seen.tolist()], pa.list_(pa.int64()))], ["seen"])

    bound_batches(docs.sparkSession)
    seen = items.select("terms").mapInArrow(frequencies, "seen array<long>").select(F.posexplode("seen").alias("at", "n"))
    df = np.zeros(len(names) + 2)
    for r in seen.groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each term
        df[r["at"]] = r["n"]
    (n_docs, total), df = df[-2:], df[:-2]
    weights = np.zeros((len(names), len(asked)))
    for j, parts in enumerate(asked.values()):
        for t, qtf in parts:
            weights[t, j] += qtf * np.log((n_docs - df[t] + 0.5) / (df[t] + 0.5) + 1) * (K1 + 1)
    mean = total / n_docs if n_docs else 0.0

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = numbers(batch.column("item"))
        for tf, dl, where in counted(batch):
            norm = K1 * (1 - B + B * dl / mean) if mean else np.ones(len(dl))
            value = rounded((tf / (tf + norm[:, None])) @ weights, digits)
            yield np.where(value > 0, value, -np.inf), ids[where]

    rows = [Row(query_id=q) for q in asked]
    return top_k(best_of_tasks(items, rows, wanted.schema, k, scored), k, item="item").withColumnRenamed("item", "doc_id")


def search(docs: DataFrame, queries: DataFrame, k: int = 8, query: str = "item_id", doc: str = "doc_id") -> DataFrame:
    """query_id, doc_id, score, rank."""
    return best_documents(docs, query_terms(queries, query, "text"), k, doc)
