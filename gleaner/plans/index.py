"""The index of a report's and a rubric's chunks: built, cleared, searched and fetched from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import NO_STRUCTURE, STRUCTURE_LEAD, STRUCTURE_QUERY
from ..functions.vector import embed_text
from ..operators import knn, segment
from ..sources import store
from .retrieve import keywords

#: Fetched ids up to this number are broadcast; more are joined by their keys.
BROADCAST_IDS = 100_000


def report_chunks(blocks: DataFrame) -> DataFrame:
    """The chunks of reports with all that the store keeps of them, keywords included."""
    records = segment.report_records(blocks)
    words = keywords(records.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")))
    joined = words.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    return records.join(joined.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "left")


def clear(spark: SparkSession, path: str, document_type: str | None = None) -> None:
    """Remove the chunks of one document type, or all."""
    folder = f"{path}/chunks" + (f"/document_type={document_type}" if document_type else "")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def build(chunks: DataFrame, path: str, size: int = 64) -> None:
    """Embed the chunks and replace the document types they have; types in other partitions stay, bad rows go to the quarantine."""
    flat = store.metadata(chunks.drop("figure_ids"))
    store.write_chunks(flat.withColumn("vector", embed_text(F.col("content"), size)), path)


def fetch(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: chunk_id and others. The rows of ids with the chunk's content and place; ids that the store lacks are left out."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return chunks.select("chunk_id", *[c for c in chunks.columns if c not in ids.columns and c != "vector"]).join(wanted, "chunk_id")


def search(chunks: DataFrame, queries: DataFrame, k: int, size: int = 64, **filters: object) -> DataFrame:
    """queries: query_id, text. query_id, chunk_id, score, rank of the nearest chunks that pass the filters."""
    items = knn.filtered(chunks, **filters).select(F.col("chunk_id").alias("item"), "vector")  # type: ignore[arg-type]
    asked = queries.select("query_id", embed_text(F.col("text"), size).alias("vector"))
    return knn.neighbours(items, asked, k).withColumnRenamed("item", "chunk_id")


def search_words(chunks: DataFrame, words: list[str], k: int = 10, size: int = 64) -> DataFrame:
    """chunk_id, score, rank of the chunks nearest to a list of keywords."""
    asked = chunks.sparkSession.createDataFrame([(0, " ".join(words))], "query_id long, text string")
    return search(chunks, asked, k, size).select("chunk_id", "score", "rank")


def structure(chunks: DataFrame, most: int = 10) -> str:
    """The sections that a general query finds, as one line."""
    found = fetch(chunks, search_words(chunks, [STRUCTURE_QUERY], most).select("chunk_id"))
    names = sorted(r["section_title"] for r in found.filter("section_title <> ''").select("section_title").distinct().collect())  # at most `most`
    return STRUCTURE_LEAD + ", ".join(names) if names else NO_STRUCTURE
