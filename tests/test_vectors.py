"""The stored index of vectors: recall against the exact lists, filters, what is read, and the exact way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import ivf, knn, vectors
from gleaner.queries import retrieval

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('vectors')}"
    rows, asked = retrieval.vectors(spark, DATA)
    vectors.write(rows, path, ["label"], k=8)
    return rows, asked, *vectors.read(spark, path)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["item"], r["score"]) for r in df.collect())


def test_recall_with_and_without_a_filter(stored):
    rows, asked, chunks, centres, probes = stored
    assert len(centres) == vectors.lists_for(rows.count()) and 0 < probes < len(centres)
    found = vectors.search(chunks, centres, asked, 8, probes)
    got = ivf.recall(found, rows, asked, 8)
    labelled = rows.filter("label = 1")
    within = ivf.recall(vectors.search(chunks, centres, asked, 5, probes, {"label": [1]}), labelled, asked, 5)
    print(f"probes {probes} of {len(centres)}, recall {got:.3f}, with a filter {within:.3f}")
    assert got >= 0.9 and within >= 0.9


def test_every_list_is_the_exact_way(stored):
    rows, asked, chunks, centres, _ = stored
    assert rows_of(vectors.search(chunks, centres, asked, 8, len(centres))) == rows_of(knn.neighbours(rows, asked, 8))
    some = rows.filter("label IN (0, 3)")
    assert rows_of(vectors.search(chunks, centres, asked, 5, len(centres), {"label": [0, 3]}, "cosine")) == rows_of(knn.neighbours(some, asked, 5, "cosine"))


def test_only_lists_looked_into_are_read(stored):
    rows, asked, chunks, centres, probes = stored
    one = asked.orderBy("query_id").limit(1)
    got = vectors.reads(chunks, centres, one, probes)
    print(got)
    assert got["lists_read"] == probes and got["vectors_read"] < got["vectors"] == rows.count()
    assert vectors.reads(chunks, centres, one, 1, {"label": ["none has it"]})["chunks_read"] == 0
    plan = vectors.some_lists(chunks, [1, 2], {})._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        where = np.flatnonzero(rng.random(n) < 0.3)
        assert np.flatnonzero(vectors.marked(vectors.bits(where, n), n)).tolist() == where.tolist()
    assert vectors.lists_for(0) == 1 and vectors.lists_for(10**12) == vectors.MOST_LISTS


def test_defined_cases(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 2)
    rows = [("a", [1.0, 0.0], "x", None), ("b", [1.0, 0.0], "x", 1), ("c", None, "x", 1), ("d", [0.0, 1.0], None, 2), ("e", [0.0, 1.0, 2.0], "y", 1), ("f", [0.9, 0.1], "y", 1)] + [(f"g{i}", [1.0, float(i)], "x", 2) for i in range(5)]
    df = spark.createDataFrame(rows, "item string, vector array<double>, kind string, size int")
    vectors.write(df.filter("item <> 'e'"), f"file://{tmp_path}/v", ["kind", "size"])
    chunks, centres, _ = vectors.read(spark, f"file://{tmp_path}/v", "string")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, vector array<double>")
    near = lambda k, where=None: [r["item"] for r in vectors.search(chunks, centres, asked, k, len(centres), where).orderBy("rank").collect()]
    assert near(3) == ["a", "b", "g0"] and near(9, {"kind": [None]}) == ["d"] and near(9, {"kind": ["y"], "size": [1]}) == ["f"]
    assert near(9, {"kind": ["x"], "size": [None, 1]}) == ["a", "b"] and near(9, {"kind": ["z"]}) == []
    vectors.write(df.limit(0), f"file://{tmp_path}/none", ["kind"])
    chunks, centres, probes = vectors.read(spark, f"file://{tmp_path}/none", "string")
    assert vectors.search(chunks, centres, asked, 3, probes).count() == 0
