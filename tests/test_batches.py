"""What Spark hands to Python at once stays small, and vectors made of it equal those made by columns."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import batches, vector
from gleaner.plans import retrieve


@pytest.mark.parametrize("make", [lambda d: retrieve.keywords(d), lambda d: d.select(vector.embed_text(F.col("text")))])
def test_batches_are_bounded_by_bytes(spark, make):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert make(docs).count() >= 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(batches.BATCH_BYTES)


def test_places_of_words_equal_the_columns(spark):
    words = ["a", "zz", "abc", "0", "longer7word", "abc"]
    column = spark.createDataFrame([(words,)], "w array<string>").select(vector.slots(F.col("w"), 64).alias("s")).first()["s"]
    assert vector.word_slots(pa.array(words), 64).tolist() == column
    assert vector.word_slots(pa.array(["x", *words])[1:], 64).tolist() == column
    assert vector.word_slots(pa.array([], pa.string()), 64).tolist() == []


def test_vectors_of_odd_texts(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é _ a_b"), (4, "word")], "doc_id long, text string")
    got = {r["doc_id"]: r["v"] for r in odd.select("doc_id", vector.embed_text(F.col("text")).alias("v")).collect()}
    assert got[1] == got[2] == got[3] == [0.0] * 64 and sum(got[4]) == 1.0
