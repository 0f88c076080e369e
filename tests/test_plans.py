"""Plans: pushdown, pruning, no nested loops, no window on a hot key."""

import pytest

from pyspark.sql import functions as F

from shelfspark.operators import catalogue as cat
from shelfspark.operators import markdown as md
from shelfspark.plans import all_queries
from shelfspark.plans import roles as r

SF = "/root/testdata/sf0.01"
QUERIES = all_queries()


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(cat.filter_publisher(r.journals(spark, SF), "Brand#17").select("entry_id", "title"))
    assert "EqualTo(p_brand,Brand#17)" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_brand:string>" in text


def test_title_filter_stays_below_the_lookups(spark):
    text = plan(QUERIES["catalogue_flow"](spark, SF))
    assert "Filter" in text and "CartesianProduct" not in text


# sinks and streams run on call; the others are one lazy plan
LAZY = sorted(
    set(QUERIES) - {n for n in QUERIES if n.startswith(("sink_", "scan_", "sort_")) or n.endswith("_stream") or n.startswith(("cluster_t", "k_scan", "papers_per"))}
)


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loop_and_no_global_window(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "PythonUDF" not in text and "MapInPandas" not in text


def test_markdown_parsing_has_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "x")], "doc int, body string")
    for df in (md.explode_md_tables(docs), md.explode_paper_blocks(docs), md.explode_report_sections(docs), md.explode_content_blocks(docs), md.chunk_report(docs)):
        assert "Exchange" not in plan(df)


@pytest.mark.parametrize("name", ["dedupe_catalogue", "latest_per_prefix", "clean_corpus", "session_blocks"])
def test_winners_come_from_partial_aggregates(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Window" not in text and "partial_m" in text


@pytest.mark.parametrize("name", ["metric_index", "dedupe_catalogue", "clean_corpus", "scan_job_logs", "resolve_record", "resolve_cross_key", "category_override", "catalogue_flow"])
def test_wide_rows_are_not_sorted_for_an_aggregate(spark, name):
    assert "SortAggregate" not in plan(QUERIES[name](spark, SF))


def test_metric_winners_are_numbers_in_a_hash_table(spark):
    ranked = cat.metric_ranks(r.metrics(spark, SF), spark.createDataFrame([("metrics_A", 0)], "file_name string, _file int"), "file_name", list(r.LINE_WIDTHS.items()))
    text = plan(cat.metric_winners(ranked))
    assert "HashAggregate" in text and "SortAggregate" not in text and "Window" not in text


def test_packed_ranks_order_rows_as_their_fields_do(spark):
    from pyspark.errors import PySparkException

    from shelfspark.operators.ranking import first_by_rank, packed_rank

    values = [None, 0, 1, 5, 2**40, 2**61]
    rows = [(a, b, c) for a in (None, 0, 3, 14) for b in values for c in (0, 1, None)]
    df = spark.createDataFrame(rows, "a int, b long, c int")
    low = lambda v: -1 if v is None else v
    got = [tuple(x) for x in df.orderBy(packed_rank(("a", 4), ("b", 62, "down"), ("c", 2))).collect()]
    assert got == sorted(rows, key=lambda x: (low(x[0]), -low(x[1]), low(x[2])))
    assert dict(df.select(packed_rank(("a", 4), ("c", 2)).alias("r")).dtypes)["r"] == "bigint"
    first = {(x["a"], x["b"]) for x in first_by_rank(df.where("c = 1"), ["a"], packed_rank(("b", 62, "down"), ("a", 4))).collect()}
    assert first == {(a, 2**61) for a in (None, 0, 3, 14)}  # null is a key
    for bad in ("b", "a - 9"):
        with pytest.raises(PySparkException):
            df.selectExpr(f"{bad} AS v").select(packed_rank(("v", 8))).collect()


def test_scratch_is_removed(spark, tmp_path):
    import os

    from shelfspark.operators.ranking import distributed_row_number
    from shelfspark.session import clear_scratch, scratch_path

    clear_scratch(spark)
    path = scratch_path(spark, "probe")
    ranked = distributed_row_number(spark.range(50), [F.desc("id")])
    assert ranked.agg(F.max("rn")).first()[0] == 50
    spark.range(3).write.parquet(path)
    assert clear_scratch(spark) == 2 and not os.path.exists(path.removeprefix("file:")) and clear_scratch(spark) == 0
