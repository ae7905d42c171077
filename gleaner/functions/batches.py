"""The size of what Spark hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch, at most; a row wider than that travels alone.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession | None = None) -> None:
    """Bound the Arrow batches of this session (by default the active one) by bytes, so that a worker's memory follows neither the rows of a task nor
    their width. The number of rows stays bounded by Spark's own setting."""
    spark = spark or SparkSession.getActiveSession()
    if spark:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
