"""Searches of many queries at sizes where time once followed the square of the table."""

import numpy as np
import pytest

from gleaner.operators import knn, latent, scan


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("size", [1.0, 1e-3, 1e4, 1e20])
def test_pairs_that_may_be_best_hold_all_that_are(metric, size):
    rng = np.random.default_rng(4)
    rows, q = rng.normal(size=(400, 6)) * size, rng.normal(size=(90, 6)) * size
    rows[::7], rows[::11] = q[3], q[3] * (1 + 1e-9)
    value = rows @ q.T
    if metric == "l2":
        value = 1 / (1 + np.maximum((rows**2).sum(1)[:, None] + (q**2).sum(1) - 2 * value, 0))
    value = scan.rounded(value, 6)
    least = np.sort(value, axis=0)[-8]
    found = set(zip(*knn.likely(rows, q, least, metric, 6), strict=True))
    assert found >= set(zip(*np.nonzero((value >= least) & (value > 1e-5 if metric == "l2" else value >= least)), strict=True))
    if size == 1.0:
        assert len(found) < 0.1 * value.size


def test_many_queries_sort_few_hits(spark, monkeypatch):
    """Once each query has its k best, later vectors cost no sort of all that is kept."""
    sorts = []
    monkeypatch.setattr(scan.Best, "merge", lambda self, query, *_, merge=scan.Best.merge: (sorts.append(len(query)), merge(self, query, *_))[1])
    best, rng = scan.Best(500, 3), np.random.default_rng(1)
    for i in range(60):
        best.hold(np.arange(500), np.full(500, i), rng.random(500))
    best.flush()
    assert len(sorts) < 20 and len(best.query) == 1500


def test_neighbours_equal_a_plain_search(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 5)).round(1)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(900, None), (901, [1.0])]
    items = spark.createDataFrame(rows, "item long, vector array<double>").repartition(3)
    asked = items.filter("item % 20 = 0 AND item < 700").withColumnRenamed("item", "query_id")
    for metric in ("l2", "cosine"):
        got = {(r["query_id"], r["rank"]): (r["item"], r["score"]) for r in knn.neighbours(items, asked, 4, metric).collect()}
        for q in range(0, 700, 20):
            value = x @ x[q] if metric == "cosine" else 1 / (1 + ((x - x[q]) ** 2).sum(1))
            order = np.lexsort((np.arange(700), -scan.rounded(value, 6)))[:4]
            assert [got[q, i + 1][0] for i in range(4)] == order.tolist()
            assert [got[q, i + 1][1] for i in range(4)] == pytest.approx(value[order], abs=1.1e-6)


def test_texts_are_split_once_for_a_model(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, None)], "doc_id long, text string")
    rows = latent.counted(docs, "text")
    assert sorted(sorted(np.abs(r["counts"]).tolist()) for r in rows.collect()) == [[], [1, 2]]
    assert not any("text" in f or "documents" in f for f in rows.columns) and rows.inputFiles()
