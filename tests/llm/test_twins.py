"""Corpus queries against their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfspark import llm

TABLES = ["documents", "embeddings", "benchmark", "conversations"]


@pytest.mark.parametrize("name", sorted(llm.all_sql()))
def test_query_equals_its_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = llm.all_queries()[name](spark, sf).toPandas(), con.execute(llm.all_sql()[name]).df()
    rows = lambda f: sorted(tuple(str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)
    assert name in entry.queries() and name in entry.oracle_sql()
