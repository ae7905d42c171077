"""The chunk store: tables of chunks by document type, written with a quarantine for bad rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest values of metadata columns.
LONGEST = {"section_title": 500, "keywords": 1000, "parent_section": 200}


def metadata(chunks: DataFrame) -> DataFrame:
    """Absent text as empty, arrays joined by commas, long values cut."""
    for name, kind in chunks.dtypes:
        if kind == "array<string>":
            chunks = chunks.withColumn(name, F.concat_ws(",", name))
        if kind in ("string", "array<string>"):
            value = F.coalesce(name, F.lit(""))
            chunks = chunks.withColumn(name, F.substring(value, 1, LONGEST[name]) if name in LONGEST else value)
    return chunks


def split_bad(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and content, and the others with a reason."""
    reason = F.when(F.coalesce("chunk_id", F.lit("")) == "", "no id").when(F.coalesce("content", F.lit("")) == "", "no content")
    marked = chunks.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the document types that chunks has; other types stay. Bad rows go to a table beside it, each once however often it is written."""
    spark, (good, bad) = chunks.sparkSession, split_bad(chunks)
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_type").parquet(f"{path}/chunks")
    new = bad.withColumn("row_key", F.sha2(F.to_json(F.struct("*")), 256)).dropDuplicates(["row_key"])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/quarantine")
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(spark.read.schema("row_key string").parquet(f"{path}/quarantine"), "row_key", "left_anti")
    new.write.mode("append").parquet(f"{path}/quarantine")


def read_chunks(spark: SparkSession, path: str, document_type: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/chunks")
    return rows.filter(F.col("document_type") == document_type) if document_type else rows


def stats(chunks: DataFrame) -> DataFrame:
    """document_type, n_chunks."""
    return chunks.groupBy("document_type").agg(F.count("*").alias("n_chunks"))
