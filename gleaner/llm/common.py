"""Shared helpers of the corpus operators: tables, scratch space, Arrow batches, stored intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of one Arrow batch handed to Python, so that memory follows neither row count nor row width.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20

#: Values of the hash that draws a sample.
DRAWS = 1 << 30

#: Word characters of the contracts: everything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; rows wider than the byte bound travel alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without that setting; it then gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; Spark removes it when the application ends."""
    path = f"{shared_dir(spark)}/gleaner-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, label: str, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    rows is about how many there are, where that is known and they are narrow: a small table then goes to few files, by a
    shuffle of its own, as a task that runs many partitions one after the other may not get back what they held.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    if rows is not None and -(-rows // each) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(max(1, -(-rows // each)))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove stored tables that no later step reads, and the shuffle files of queries that have ended.

    Spark drops a shuffle's files once the driver's JVM has collected the plan that made them, so ask it to.
    """
    for df in tables:
        path = getattr(df, "_stored_path", None) if df is not None and "_stored_path" in df.__dict__ else None
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
            spark.sparkContext._jvm.System.gc()


def drawn(rows: DataFrame, by: list[str], most: int, spare: float = 2.0, seed: int = 0) -> DataFrame:
    """Rows whose hash (column _draw) is below a bound that follows from their number: about spare * most, and at least `most` if there are as many.

    So a bounded sample can be sorted and cut without every task sending as many rows as are wanted in all. Rows alike in `by` are drawn
    together, which is why a draw may fall short and is widened then.
    """
    hashed = rows.withColumn("_draw", F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(DRAWS)))
    share = min(1.0, spare * most / max(1, rows.count()))
    while True:
        some = hashed.filter(F.col("_draw") < int(share * DRAWS))
        if share >= 1 or some.count() >= most:
            return some
        share = min(1.0, 4 * share)


def open_path(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI, also with the schemes that Hadoop has for S3."""
    scheme, sep, rest = uri.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else uri)


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the values of one string or binary column hold at most limit bytes, or one row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0)
    sizes[:] = lengths.to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
