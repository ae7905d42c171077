"""Queries of corpus operators against their SQL."""

import duckdb
import pytest

from gleaner.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    rel = con.sql(oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
