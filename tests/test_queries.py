"""Every registered query against its SQL twin on the smallest tables, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from shelfspark.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:4] == ["entry_id", "title", "publisher", "quartile"] and df.count() > 0
