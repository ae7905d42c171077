"""Learned vectors against a plain singular value decomposition of the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import terms
from gleaner.operators import latent

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def model(docs):
    return latent.fit(docs.repartition(5))


def matrix(docs, rarity=None):
    """The weights from the definition, a dense matrix over the columns that occur, and those columns."""
    rows = docs.select("doc_id", terms(F.col("text")).alias("w"), latent.hashes(F.col("text")).alias("h")).orderBy("doc_id").collect()
    counts = []
    for r in rows:
        mine = {}
        for h in r["h"]:
            col, sign = (h % 2**64 >> 1) % latent.FEATURES, -1 if h & 1 else 1
            mine[col] = mine.get(col, 0) + sign
        counts.append({c: v for c, v in mine.items() if v})
    names = sorted({c for m in counts for c in m})
    at = {c: i for i, c in enumerate(names)}
    out = np.zeros((len(rows), len(names)))
    df = np.zeros(len(names))
    for m in counts:
        for c in m:
            df[at[c]] += 1
    for i, m in enumerate(counts):
        for c, v in m.items():
            out[i, at[c]] = np.sign(v) * (1 + np.log(abs(v))) * (np.log((len(rows) + 1) / (df[at[c]] + 1)) + 1)
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1), names


def unit(x):
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def test_neighbours_agree_with_a_plain_decomposition(docs, model):
    a, names = matrix(docs)
    got = np.array([r["vector"] for r in latent.embedded(docs, model).orderBy("doc_id").select("vector").collect()])
    assert got.shape == (len(a), 64)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    want = unit(a @ vt[:64].T)
    assert model.values[:40] == pytest.approx(s[:40], rel=0.001) and (model.values <= s[:64] * (1 + 1e-9)).all()
    near = lambda x: np.argsort(-np.round(x @ x.T, 9) + 1e9 * np.eye(len(x)), axis=1, kind="stable")[:, :10]
    recall = np.mean([len(set(p) & set(q)) / 10 for p, q in zip(near(got), near(want), strict=True)])
    print(f"recall {recall:.3f}")
    assert recall >= 0.9
    assert got == pytest.approx(unit(a @ model.directions[names]), abs=1e-9)


def test_related_texts_are_nearer_than_others(docs, model):
    rows = {r["doc_id"]: (set(r["w"]), np.array(r["vector"])) for r in latent.embedded(docs, model).withColumn("w", terms(F.col("text"))).collect()}
    ids = [i for i, (w, _) in rows.items() if len(w) > 30]
    rng = np.random.default_rng(5)
    pairs = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if len(rows[i][0] & rows[j][0]) >= 0.8 * len(rows[i][0] | rows[j][0])]
    assert len(pairs) > 20
    closer = [rows[i][1] @ rows[j][1] > rows[i][1] @ rows[int(o)][1] for i, j in pairs for o in rng.choice([k for k in ids if k not in (i, j)], 5) if len(rows[i][0] & rows[int(o)][0]) < 0.5 * len(rows[i][0])]
    assert np.mean(closer) > 0.99


def test_products_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    lists = [rng.integers(-(2**62), 2**62, n).tolist() * 2 for n in (3, 0, 50, 1, 0, 7, 400, 2)]
    whole, right, left = latent.Rows.of(lists), rng.normal(size=(latent.FEATURES, 3)), rng.normal(size=(8, 3))
    dense = np.zeros((8, latent.FEATURES))
    dense[whole.row, whole.col] = whole.weight
    for size in (1 << 16, 10, 1):
        monkeypatch.setattr(latent, "AT_ONCE", size)
        into = np.zeros((latent.FEATURES, 3))
        whole.back(left, into)
        assert whole.times(right) == pytest.approx(dense @ right) and into == pytest.approx(dense.T @ left)


def test_defined_cases(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "three")], "doc_id long, text string")
    got = {r["doc_id"]: r["vector"] for r in latent.embedded(odd, latent.fit(odd, size=8)).collect()}
    assert got[1] == got[2] == [0.0] * 8 and got[3] == got[4] and np.linalg.norm(got[3]) == pytest.approx(1) and np.dot(got[3], got[5]) == pytest.approx(0, abs=1e-9)
    none = latent.fit(odd.limit(0), size=4)
    assert not none.directions.any() and none.vectors([[1, 2]]).tolist() == [[0.0] * 4]
