"""Cuts near every thousandth character."""

from pyspark.sql import functions as F

from gleaner import queries as engine
from gleaner.operators import segment


def test_cuts_of_odd_texts(spark, tmp_path):
    text = "x" * 950 + ". " + "y" * 1100 + "\n\n" + "z" * 40
    rows = [(1, None), (2, "a, b"), (3, text), (4, "\U0001d400" * 990 + "\n" + "w" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in engine.queries()["best_split"](spark, str(tmp_path)).collect())
    assert got == [(1, 1000, 1000), (2, 4, 2), (3, 1000, 951), (3, 2000, 2053), (3, 2094, 2053), (4, 1000, 991), (4, 1021, 991)]
    made = segment.best_splits(F.col("text"), F.array(F.lit(4)))
    assert spark.createDataFrame(rows[1:2], "doc_id long, text string").select(made.alias("c")).first()["c"] == [2]
