"""Searches that must answer for the whole table, whatever its size."""

import pytest

from gleaner import queries as engine
from gleaner.functions.fixed import PRESETS
from gleaner.operators import ivf, knn
from gleaner.plans import retrieve
from gleaner.queries import retrieval


@pytest.mark.parametrize("name", ["cosine_topk", "l2_similarity_topk", "filtered_knn", "ivf_topk"])
def test_every_twentieth_vector_is_asked(spark, tmp_path, name):
    rows = [(i, [float(i % 13), float(i % 11), 1.0], 1) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = engine.queries()[name](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in got} == set(range(0, 900, 20))
    assert max(r["item"] for r in got) > 400


def test_presets_read_lists_to_their_own_depth(spark):
    rows = [(1, v, "semantic", 100 * v + r, r) for v in (0, 1) for r in range(1, 15) if r != 7] + [(1, v, "semantic", 7, 7) for v in (0, 1)]
    lists = spark.createDataFrame(rows, "query_id long, variant int, modality string, doc_id long, rank int")
    got = {(r["preset"], r["doc_id"]): r["score"] for r in retrieve.sweep(lists).collect()}
    for name, (_, weight, _, _, k) in PRESETS.items():
        assert got.get((name, 7)) == (round(2 * weight / 67, 8) if k >= 7 else None)
    by_list = [(1, "semantic", d, r) for d, r in zip("abcdefghijkl", range(1, 13), strict=True)]
    one = spark.createDataFrame(by_list, "query_id long, modality string, doc_id string, rank int")
    assert retrieve.sweep(one).filter("preset = 'HIGH_RECALL'").count() == 12


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_inverted_file_finds_nine_of_ten(spark, sf):
    rows, asked = retrieval.vectors(spark, f"/root/testdata/{sf}")
    found = engine.queries()["ivf_topk"](spark, f"/root/testdata/{sf}")
    got = ivf.recall(found, rows, asked, 8)
    print(f"{sf}: recall {got:.3f}")
    assert got >= 0.9
    exact = {(r["query_id"], r["item"]): r["score"] for r in knn.neighbours(rows, asked, 8).collect()}
    assert all(exact.get((r["query_id"], r["item"]), r["score"]) == r["score"] for r in found.collect())


def test_inverted_file_of_nothing(spark):
    none = spark.createDataFrame([], "item long, vector array<float>")
    assert ivf.fit(none, 4)[0].shape == (0, 0)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0])], "item long, vector array<float>")
    centres, probes = ivf.fit(odd.filter("item <> 3"), 2, 1)
    assert probes == 1
    index = ivf.listed(odd, centres)
    assert {r["item"] for r in index.collect()} == {1, 4}
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, vector array<float>")
    assert [r["item"] for r in ivf.search(index, centres, asked, 2, 2).orderBy("rank").collect()] == [1, 4]
