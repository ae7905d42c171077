"""Keeping a stored index of a growing folder of documents up to date with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import impacts


def follow(spark: SparkSession, source: str, schema: StructType, index: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Add each batch of documents (doc_id, text) to the index below a path as a segment, so that a repeated batch replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        impacts.add(batch, index, number)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def followed(spark: SparkSession, index: str) -> impacts.Stored:
    """The index of all batches so far; a document that came twice, in two batches, counts twice."""
    return impacts.Stored(spark, index)
