"""Every engine query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from gleaner import queries as engine

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_same_rows(spark, duck, name):
    df = engine.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    if name in engine.oracle_sql():
        rel = duck.sql(engine.oracle_sql()[name])
        at = [rel.columns.index(c) for c in cols]
        assert rows == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
        assert len(rel.columns) == len(cols)
    else:
        assert rows
