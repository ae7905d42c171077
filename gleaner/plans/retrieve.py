"""Retrieval plans: keywords, cached embeddings, result lists of all variants at once, fusion, selection, presets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..functions.fixed import PRESETS, RRF_K, STOPWORDS
from ..functions.text import terms, token_count
from ..functions.vector import embed_text
from ..operators import bm25, fusion, impacts, knn
from ..operators.expand import expanded
from .settings import Settings


def keywords(docs: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, word, n, rank: the most frequent words of at least four letters, earlier ones first where counts are equal.

    A document's words are all in its row, so that they are counted there.
    """
    words = F.filter(terms(F.col("text")), lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(STOPWORDS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            cells, first, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
            order = np.lexsort((first, -n, cells // width))
            row = cells[order] // width
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            kept = rank <= most
            at, word = row[kept], cells[order][kept] % width
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), coded.dictionary.take(pa.array(word, pa.int64())), pa.array(n[order][kept], pa.int64()), pa.array(rank[kept], pa.int32())], ["doc_id", "word", "n", "rank"])

    return docs.select("doc_id", words.alias("words")).mapInArrow(run, f"doc_id {kind}, word string, n long, rank int")


def embed_distinct(rows: DataFrame, text: str, size: int = 64) -> DataFrame:
    """text, n, vector: every different text embedded once; join it back by the text."""
    return rows.groupBy(text).agg(F.count("*").alias("n")).withColumn("vector", embed_text(F.col(text), size))


def embed_cached(rows: DataFrame, text: str, path: str, size: int = 64) -> DataFrame:
    """text, vector of every different text, embedded only if the cache below path lacks it; new ones are added there.

    The cache is known by the texts' hashes and compared by the texts themselves. Two writers or a repeated one may store a text twice; one of
    its vectors is read.
    """
    spark = rows.sparkSession
    wanted = rows.select(F.col(text).alias("text")).distinct().filter("text IS NOT NULL").withColumn("key", F.xxhash64("text"))
    kept = spark.createDataFrame([], "text string, key long, vector array<double>")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        kept = spark.read.schema(kept.schema).parquet(path)
    new = wanted.join(kept, ["key", "text"], "left_anti")
    new.select("text", "key", embed_text(F.col("text"), size).alias("vector")).write.mode("append").parquet(path)
    found = spark.read.schema(kept.schema).parquet(path).join(wanted, ["key", "text"])
    return found.groupBy("key", "text").agg(F.min("vector").alias("vector")).select(F.col("text").alias(text), "vector")


def result_lists(docs: DataFrame | impacts.Stored, asked: DataFrame, k: int, embed: Callable[[Column], Column] = embed_text) -> DataFrame:
    """asked: query_id, variant, query. The k best documents of every variant in both modalities, with modality and rank.

    docs are texts (doc_id, text) or a stored index of them, which has their terms and vectors already; the rows are the same. embed makes
    vectors of the queries, and of the texts where they are not stored.
    """
    indexed = isinstance(docs, impacts.Stored)
    keyed = asked.withColumn("_v", F.struct("query_id", "variant"))
    wanted = bm25.query_terms(keyed, "_v", "query")
    found = impacts.search(docs, wanted, k) if indexed else bm25.best_documents(docs, wanted, k)
    by_word = found.select("query_id", "doc_id", "score", F.lit("keyword").alias("modality"), "rank")
    vectors = docs.vectors() if indexed else docs.select(F.col("doc_id").alias("item"), embed(F.col("text")).alias("vector"))
    near = knn.neighbours(vectors, keyed.select(F.col("_v").alias("query_id"), embed(F.col("query")).alias("vector")), k)
    by_vector = near.select("query_id", F.col("item").alias("doc_id"), "score", F.lit("semantic").alias("modality"), "rank")
    both = by_word.unionByName(by_vector)
    return both.select("query_id.query_id", "query_id.variant", "modality", "doc_id", "score", "rank")


def sweep(lists: DataFrame) -> DataFrame:
    """All presets over the same result lists: preset, query_id, doc_id, score, rank.

    Of each list a preset reads as many ranks as it returns, as its own search does.
    """
    rows = [(n, h, s, w, k) for n, (h, s, w, _, k) in PRESETS.items()]
    presets = lists.sparkSession.createDataFrame(rows, "preset string, hybrid boolean, ws double, wk double, k int")
    used = lists.crossJoin(F.broadcast(presets)).filter("hybrid OR modality = 'semantic'")  # five rows: a proven bound
    used = used.filter(F.col("rank") <= F.col("k"))
    weight = F.when(F.col("modality") == "semantic", F.col("ws")).otherwise(F.col("wk"))
    fused = used.groupBy("preset", "k", "query_id", "doc_id").agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 8).alias("score"))
    order = Window.partitionBy("preset", "query_id").orderBy(F.col("score").desc(), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter("rank <= k").select("preset", "query_id", "doc_id", "score", "rank")


def retrieve(docs: DataFrame | impacts.Stored, criteria: DataFrame, preset: str | Settings = "BALANCED", scale: str = "normalised", embed: Callable[[Column], Column] = embed_text) -> DataFrame:
    """criteria: query_id, text, code. Selected evidence: query_id, doc_id, score, token_count, place, n_variants.

    docs are texts or a stored index (see result_lists). One plan for all criteria. scale raw compares the threshold with plain sums of reciprocal ranks, which many variants
    alone can lift above it; normalised divides by what as many variants can reach.
    """
    chosen = preset if isinstance(preset, Settings) else Settings.preset(preset)
    hybrid, semantic, keyword, threshold, k = chosen.hybrid, chosen.semantic, chosen.keyword, chosen.threshold, chosen.k
    asked = expanded(criteria, concepts=True)
    lists = result_lists(docs, asked, k, embed)
    if not hybrid:
        lists = lists.filter("modality = 'semantic'")
    n = asked.groupBy("query_id").agg(F.count("*").alias("n_variants"))
    fused = bm25.top_k(fusion.weighted(lists, semantic, keyword), 2 * k).join(n, "query_id")
    if scale == "normalised":
        fused = fusion.normalised(fused)
    tokens = docs.docs().select("doc_id", "token_count") if isinstance(docs, impacts.Stored) else docs.select("doc_id", token_count(F.col("text")).alias("token_count"))
    return fusion.select_budget(fused.join(tokens, "doc_id"), threshold, k).join(n, "query_id")


def retrieve_all(docs: DataFrame, criteria: DataFrame, whole: str = "", preset: str | Settings = "BALANCED", longest: int = 1000) -> DataFrame:
    """retrieve for all criteria; without any, for one query made of the criteria document's whole text, cut, under the id 0."""
    if criteria.isEmpty():
        criteria = docs.sparkSession.createDataFrame([(0, whole[:longest], "")], "query_id long, text string, code string")
    return retrieve(docs, criteria, preset)


def totals(evidence: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """One row: n_criteria, n_chunks, n_tokens, any_figure of selected evidence; figures: doc_id of chunks that refer to one."""
    marked = evidence.withColumn("_figure", F.lit(False))
    if figures is not None:
        marked = evidence.join(figures.select("doc_id").distinct().withColumn("_f", F.lit(True)), "doc_id", "left").withColumn("_figure", F.coalesce("_f", F.lit(False)))
    counts = [F.countDistinct("query_id").alias("n_criteria"), F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("n_tokens")]
    return marked.agg(*counts, F.coalesce(F.bool_or("_figure"), F.lit(False)).alias("any_figure"))
