"""The stored BM25 index against the search that scans texts, with and without cuts, segments that change the mean, and defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import bm25, impacts

DATA = "/root/testdata/sf0.01"


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def asked(spark):
    whole = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    short = whole.select((F.col("item_id") + 1000).alias("item_id"), F.concat_ws(" ", F.slice(F.split("text", " "), 5, 3)).alias("text"))
    return bm25.query_terms(whole.union(short), "item_id", "text").cache()


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('impacts')}"
    impacts.add(docs, path, buckets=64)
    return impacts.Stored(spark, path)


def test_same_rows_as_a_scan(stored, docs, asked):
    for k in (1, 20):
        assert rows(impacts.search(stored, asked, k)) == rows(bm25.best_documents(docs, asked, k))


def test_cuts_leave_blocks_unread_and_rows_alike(stored, docs, asked, monkeypatch):
    taken = []
    cut_off = impacts.cut_off

    def seen(batch, sizes, bounds):
        few, cuts = cut_off(batch, sizes, bounds)
        every = impacts.wanted_blocks(stored, batch.ask(few)).agg(F.sum("n")).first()[0] if few else 0
        left = impacts.wanted_blocks(stored, batch, cuts).agg(F.sum("n")).first()[0] if few else 0
        taken.append((len(few), every, left))
        return few, cuts

    monkeypatch.setattr(impacts, "cut_off", seen)
    monkeypatch.setattr(impacts, "BLOCK", 8)
    assert rows(impacts.search(stored, asked, 2)) == rows(bm25.best_documents(docs, asked, 2))
    (few, every, left), = taken
    assert few > 0 and left < every
    # every query cut, however little that saves: the rows are still the same
    monkeypatch.setattr(impacts, "cut_off", lambda batch, sizes, bounds: cut_off(batch, {t: np.append(np.zeros(31), 1) * 0 for t in sizes}, bounds))
    assert rows(impacts.search(stored, asked, 8)) == rows(bm25.best_documents(docs, asked, 8))


def test_queries_in_blocks(stored, docs, asked, monkeypatch):
    from gleaner.operators import scan

    monkeypatch.setattr(scan, "QUERY_BYTES", 1 << 18)
    assert rows(impacts.search(stored, asked, 5)) == rows(bm25.best_documents(docs, asked, 5))


def test_segments_that_change_the_mean(spark, docs, asked, tmp_path):
    path = f"file://{tmp_path}/parts"
    long = F.length("text") > 2500
    impacts.add(docs.filter(~long), path, 0, buckets=16)
    impacts.add(docs.filter(long & (F.col("doc_id") % 3 > 0)), path, 1, buckets=16)
    impacts.add(docs.limit(3), path, 2, buckets=16)
    impacts.add(docs.filter(long & (F.col("doc_id") % 3 == 0)), path, 2, buckets=16)  # replaces what had this number
    index = impacts.Stored(spark, path)
    means = [c["mean"] for c in index.corpus()]
    assert max(means) > 3 * min(means)
    assert rows(impacts.search(index, asked, 4)) == rows(bm25.best_documents(docs, asked, 4))


def test_reads_its_terms_alone(spark, stored, asked):
    one = asked.filter("query_id = 3")
    got = impacts.reads(stored, one)
    print(got)
    assert got["blocks_read"] < 0.2 * got["blocks"] and got["files_read"] < 0.5 * got["files"]
    assert got["postings"] == stored.docs().agg(F.sum(F.size("terms"))).first()[0]
    every = impacts.reads(stored, asked)
    print(every)
    assert every["blocks_read"] < 0.2 * every["blocks"]


def test_levels():
    rng = np.random.default_rng(1)
    for _ in range(200):
        up = rng.exponential(1, rng.integers(1, 9))
        bound = rng.uniform(0, up.sum() * 0.999)
        got = impacts.level(up, bound)
        assert np.minimum(up, got).sum() == pytest.approx(bound)
    assert impacts.level(np.array([1.0, 2.0]), 3.0) == float("inf") and impacts.level(np.array([1.0]), 0.0) == 0.0


def test_defined_cases(spark, tmp_path):
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "Tie word"), ("d", "tie word"), ("e", "é €"), ("f", "word " * 100_000)], "name string, body string")
    path = f"file://{tmp_path}/odd"
    impacts.add(odd, path, doc="name", text="body", buckets=4)
    wanted = bm25.query_terms(spark.createDataFrame([(1, "tie"), (2, "nothing here"), (3, ""), (4, "word")], "id long, t string"), "id", "t")
    got = rows(impacts.search(impacts.Stored(spark, path), wanted, 3))
    assert [(q, d) for q, _, d, _ in got] == [(1, "c"), (1, "d"), (4, "f"), (4, "c"), (4, "d")]
    assert impacts.Stored(spark, path).docs().filter("dl = 0").count() == 3
    impacts.add(odd.limit(0), f"{path}-none", doc="name", text="body", buckets=4)
    assert impacts.search(impacts.Stored(spark, f"{path}-none"), wanted, 3).count() == 0
    assert impacts.search(impacts.Stored(spark, path), wanted.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="document c is there 2 times"):
        impacts.add(odd.union(odd.filter("name = 'c'")), f"{path}-twice", doc="name", text="body", buckets=4)
