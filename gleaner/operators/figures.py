"""Figures: captions, the chunks that refer to them, their neighbours, and relevance to a criterion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import figure_ids
from .bm25 import top_k


def captions(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, block_idx, content, style. doc_id, figure_id, caption: the n-th caption belongs to figure n."""
    is_caption = F.lower(F.coalesce("style", F.lit(""))).contains("caption") | (F.lower("content").startswith("figure") & F.col("content").contains(":"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx"))
    return blocks.filter(is_caption).select("doc_id", F.concat(F.lit("figure_"), n.cast("string")).alias("figure_id"), F.col("content").alias("caption"))


def with_context(figures: DataFrame, chunks: DataFrame, beside: int = 200) -> DataFrame:
    """figures: doc_id, figure_id, caption; chunks: doc_id, chunk_index, content, page. Adds context and page.

    Context is the first chunk that refers to the figure between parts of its neighbours; page is that chunk's, else 1.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    around = chunks.withColumn("_before", F.substring(F.lag("content").over(order), -beside, beside)).withColumn("_after", F.substring(F.lead("content").over(order), 1, beside))
    refers = around.withColumn("figure_id", F.explode(figure_ids(F.col("content"))))
    text = F.concat_ws(" ... ", "_before", "content", "_after")
    first = refers.groupBy("doc_id", "figure_id").agg(F.min_by(F.struct(text.alias("context"), "page"), "chunk_index").alias("r"))
    joined = figures.join(first, ["doc_id", "figure_id"], "left")
    return joined.select("doc_id", "figure_id", "caption", F.col("r.context").alias("context"), F.coalesce("r.page", F.lit(1)).alias("page"))


def relevant(figures: DataFrame, criteria: DataFrame, most: int = 3) -> DataFrame:
    """criteria: query_id, text. query_id, doc_id, figure_id, score, rank: shared words, twice for the caption's; the best `most` above 0.

    A figure is one of a document: others may have one of the same name. Both sides meet on their words, so that only what shares one is paired.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))
    sides = [figures.select("doc_id", "figure_id", F.explode(words(c)).alias("word"), F.lit(worth).alias("worth")) for c, worth in (("caption", 2), ("context", 1))]
    asked = criteria.select("query_id", F.explode(words("text")).alias("word"))
    scored = asked.join(sides[0].unionByName(sides[1]), "word").groupBy("query_id", "doc_id", "figure_id").agg(F.sum("worth").cast("int").alias("score"))
    best = top_k(scored.withColumn("_figure", F.struct("doc_id", "figure_id")), most, item="_figure")
    return best.select("query_id", "doc_id", "figure_id", "score", "rank")


def with_images(images: DataFrame, captions_: DataFrame) -> DataFrame:
    """images: doc_id, figure_id and others; every image, with its caption where there is one."""
    return images.join(captions_.select("doc_id", "figure_id", "caption"), ["doc_id", "figure_id"], "left")
