"""Table functions of SQL against the DataFrame functions of the same names."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner import queries as engine
from gleaner.operators import fusion, segment, tables

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_report_chunks(spark, docs):
    lines = segment.line_blocks(docs)
    lines = lines.withColumn("heading_level", F.when(F.xxhash64("content") % 5 == 0, (F.col("block_idx") % 4)).cast("int")).withColumn("page", (F.col("block_idx") / 3).cast("int") + 1)
    lines.createOrReplaceTempView("blocks_of_documents")
    got = spark.sql("SELECT * FROM report_chunks(TABLE(blocks_of_documents) PARTITION BY doc_id ORDER BY block_idx)")
    assert rows(got) == rows(segment.report_chunks(lines))
    small = spark.sql("SELECT * FROM report_chunks(TABLE(blocks_of_documents) PARTITION BY doc_id ORDER BY (block_idx), 90, 0)")
    assert rows(small) == rows(segment.report_chunks(lines, 90, 0))
    same = engine.queries()["chunks_by_sql"](spark, DATA)
    assert rows(same) == rows(engine.queries()["pack_report_chunks"](spark, DATA))


def test_sliding_windows(spark, docs):
    texts = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b. " * 9000)], "doc_id long, text string"))
    texts.createOrReplaceTempView("texts_of_documents")
    got = spark.sql("SELECT * FROM sliding_windows(TABLE(texts_of_documents) PARTITION BY doc_id)")
    assert rows(got) == rows(segment.sliding_windows(texts))


def test_budget_select(spark, docs):
    rng = random.Random(4)
    made = [(q, d, rng.random(), rng.choice([None, 50, 900, 2000, 3100])) for q in range(30) for d in range(20)]
    hits = spark.createDataFrame(made, "query_id long, doc_id long, score double, token_count int")
    hits.createOrReplaceTempView("hits_of_queries")
    got = spark.sql("SELECT * FROM budget_select(TABLE(hits_of_queries) PARTITION BY query_id ORDER BY (score DESC, doc_id), 0.2D, 4)")
    assert rows(got) == rows(fusion.select_budget(hits, 0.2, 4))


def test_nothing(spark, docs):
    spark.createDataFrame([], "doc_id long, block_idx int, content string").createOrReplaceTempView("no_blocks")
    assert spark.sql("SELECT * FROM report_chunks(TABLE(no_blocks) PARTITION BY doc_id ORDER BY block_idx)").count() == 0
    spark.createDataFrame([(1, 0, None), (1, 1, "x")], "doc_id long, block_idx int, content string").createOrReplaceTempView("null_blocks")
    assert [r["content"] for r in spark.sql("SELECT * FROM report_chunks(TABLE(null_blocks) PARTITION BY doc_id ORDER BY block_idx)").collect()] == ["\n\nx"]
