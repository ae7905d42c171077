"""Whitening against exact integers and numpy over all rows at once."""

import math

import numpy as np
import pytest

from gleaner.llm import whitening
from gleaner.llm.queries import queries

DATA = "/root/testdata/sf0.01"


def test_query_against_all_rows_at_once(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in rows.items()}
    n, dims = len(x), len(next(iter(x.values())))
    total = [sum(v[j] for v in x.values()) for j in range(dims)]
    plain = np.array(list(x.values()), float)
    cov = np.cov(plain.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    got = queries()["op12_whitening"](spark, DATA)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 32 * n and len({(r["vec_id"], r["component"]) for r in got}) == len(got)
    signs = {}
    for r in got:
        k = r["component"]
        v = x[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * c - t) ** 2 for c, t in zip(v, total, strict=True))
        want = (np.array(v, float) - np.array(total) / n) @ vectors[:, -k] / math.sqrt(values[-k])
        if abs(want) > 1e-3:
            signs.setdefault(k, np.sign(want * r["whitened"]))
        assert r["whitened"] == pytest.approx(signs.get(k, 1) * want, abs=1e-6)
        assert r["explained"] == pytest.approx(values[-k] / cov.trace(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert len(signs) == 32


def test_merging_is_the_same_in_any_order():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 40, (1000, 5)) @ rng.normal(0, 1, (5, 5))) + 10.0**9
    whole = whitening.moments(x)
    for cuts in ([1, 2, 999], [500], list(range(1, 1000))):
        parts = [whitening.moments(p) for p in np.split(x, cuts)]
        while len(parts) > 1:
            parts = [whitening.merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        assert parts[0].n == 1000 and parts[0].total == whole.total
        assert parts[0].scatter == pytest.approx(whole.scatter, rel=1e-9) and parts[0].mean == pytest.approx(whole.mean, rel=1e-14)


def test_defined_cases(spark):
    schema = "vec_id long, embedding array<float>, n string, `a b` int"
    rng = np.random.default_rng(2)
    rows = [(i, [float(a) for a in rng.normal(0, 1, 3)], "x", 1) for i in range(20)]
    rows += [(None, rows[0][1], None, None), (0, rows[0][1], "x", 1), (21, None, "x", 1), (22, [1.0, None, 2.0], "x", 1), (23, [math.nan, 1.0, 2.0], "x", 1), (24, [math.inf, 1.0, 2.0], "x", 1), (25, [], "x", 1)]
    rows += [(30, [1.0, 2.0], "x", 1), (31, [1.0, 4.0], "x", 1), (40, [7.0], "x", 1)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    white = whitening.whiten(df, whitening.fit(df))
    assert white.columns == ["vec_id", "embedding", "a b", "n", "deviation", "whitened", "explained", "identity_error"]
    got = {}
    for r in white.collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert sorted(k for k in got if k is not None) == [*range(20), 30, 31, 40]
    assert len(got[0]) == 2 and got[0][0]["whitened"] == got[0][1]["whitened"] == got[None][0]["whitened"]
    assert got[1][0]["n"] == 22 and len(got[1][0]["whitened"]) == 3 and got[1][0]["identity_error"] < 1e-9
    assert [got[30][0]["whitened"], got[31][0]["whitened"]] == [[-1.0], [1.0]] and got[30][0]["explained"] == [1.0]
    assert got[40][0]["whitened"] == [] and got[40][0]["deviation"] == 0
    assert whitening.components(white, "vec_id").filter("vec_id = 40").count() == 0
    huge = spark.createDataFrame([(1, [3e38]), (2, [-3e38]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert [r["deviation"] for r in whitening.whiten(huge, whitening.fit(huge)).orderBy("vec_id").collect()] == [None, None, 0]
    none = df.limit(0)
    assert whitening.components(whitening.whiten(none, whitening.fit(none)), "vec_id").count() == 0
    nulls = df.filter("vec_id = 21")
    assert whitening.whiten(nulls, whitening.fit(nulls)).count() == 0
