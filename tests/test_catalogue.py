"""First and last wins, lookups, de-duplication, facets."""

from pyspark.sql import functions as F

from shelfspark.operators import catalogue as cat
from shelfspark.operators import jobs as jb
from shelfspark.operators.ranking import distributed_row_number, first_per_key, last_per_key

METRIC = "file_name string, line_no int, issn_print string, issn_e string, quartile string, jif string, jci string, oa_citable_pct string, total_citations string, jcr_abbrev string"


def metric(spark, rows):
    return spark.createDataFrame([(f, n, p, e, q, j, None, None, None, None) for f, n, p, e, q, j in rows], METRIC)


def test_last_row_in_a_file_first_file_over_files(spark):
    m = metric(
        spark,
        [
            ("a", 1, "0001-0001", "", "Q1", "1.0"),
            ("a", 2, "0001-0001", "0002-000X", "N/A", "2.0"),
            ("b", 1, "0001-0001", "", "Q3", "9.0"),
            ("b", 2, "0003-0003", "", "q2", ""),
        ],
    )
    got = {r["issn_key"]: (r["quartile"], r["quartile_raw"], r["jif"]) for r in cat.metric_index(m).collect()}
    # the quartile skips invalid values, the detail does not
    assert got["00010001"] == ("Q1", "N/A", "2.0")
    assert got["0002000X"] == (None, "N/A", "2.0")
    assert got["00030003"] == ("Q2", "q2", None)
    assert set(got) == {"00010001", "0002000X", "00030003"}


def test_quartile_may_come_from_a_later_file(spark):
    m = metric(spark, [("a", 1, "1", "", "N/A", "1"), ("b", 1, "1", "", "Q4", "2")])
    r = cat.metric_index(m).first()
    assert (r["quartile"], r["jif"]) == ("Q4", "1")


def test_lookup_prefers_the_print_key_and_never_mixes_records(spark):
    idx = cat.metric_index(
        metric(spark, [("a", 1, "11111111", "", "N/A", ""), ("a", 2, "22222222", "", "Q2", "5.5"), ("a", 3, "", "33333333", "Q1", "7")])
    )
    j = spark.createDataFrame(
        [("both", "1111-1111", "2222-2222"), ("e only", "", "2222-2222"), ("none", "", ""), ("swapped", "33333333", "")],
        "title string, issn string, eissn string",
    )
    got = {r["title"]: (r["quartile"], r["jif"]) for r in cat.enrich_two_key(j, idx).collect()}
    # quartile falls back on its own, the empty jif of the print record stays empty
    assert got == {"both": ("Q2", None), "e only": ("Q2", "5.5"), "none": (None, None), "swapped": ("Q1", "7")}


def test_overlay_fills_field_by_field(spark):
    idx = cat.metric_index(metric(spark, [("a", 1, "11111111", "", "", "3.3")]))
    e = spark.createDataFrame(
        [("n", "11111111", "", "Q1", "0"), ("m", "", "", "Q2", "1")], "name string, issn string, eissn string, quartile string, jif string"
    )
    got = {r["name"]: (r["quartile"], r["jif"], r["title"], r["categories"]) for r in cat.overlay_nonnull(e, idx, ["X"]).collect()}
    assert got == {"n": ("Q1", "3.3", "n", ["X"]), "m": ("Q2", "1", "m", ["X"])}


def test_shifted_rows(spark):
    cols = ["category", "edition", "journal_name", "issn_print"]
    raw = spark.createDataFrame(
        [(["PSYCHOLOGY", " SOCIAL", "SSCI", "Mind", "1"],), (["ECONOMICS", "SSCI", "Money", "2"],)], "cells array<string>"
    )
    got = {tuple(r)[:4] for r in cat.repair_shifted_rows(raw, cols).collect()}
    assert got == {("PSYCHOLOGY, SOCIAL", "SSCI", "Mind", "1"), ("ECONOMICS", "SSCI", "Money", "2")}


def entries(spark):
    return spark.createDataFrame(
        [
            (1, 1, 0, 0, "", "", "", "Same Name"),
            (2, 0, 0, 1, "", "", "", " same  name "),
            (3, 0, 0, 2, "", "", "", "Other"),
            (4, 0, 1, 0, "W1", "11111111", "", "A"),
            (5, 0, 0, 9, "W1", "", "", "B"),
            (6, 0, 0, 3, "", "11111111", "", "C"),
            (7, 2, 0, 0, "", "", "", ""),
            (8, 3, 0, 0, "", "", "", ""),
        ],
        "k int, disc_pos int, q_pos int, row_pos int, openalex_source_id string, issn string, eissn string, name string",
    )


def test_dedupe_uses_the_real_key_and_the_first_record(spark):
    once = cat.dedupe_catalogue(entries(spark))
    # records without an ISSN do not collapse, records without any key are kept
    assert {r["k"] for r in once.collect()} == {2, 3, 5, 6, 7, 8}
    assert {r["k"] for r in cat.dedupe_catalogue(once).collect()} == {2, 3, 5, 6, 7, 8}


def test_resolve_order_and_cross_keys(spark):
    reg = spark.createDataFrame(
        [(0, "Alpha", "11111111", "22222222"), (1, "Beta", "33333333", ""), (2, "Beta", "", "44444444")],
        "row_pos int, name string, issn string, eissn string",
    )
    e = spark.createDataFrame(
        [(1, "beta", "", "22222222"), (2, " BETA ", "", ""), (3, "x", "22222222", ""), (4, "x", "33333333", "22222222")],
        "entry_id int, name string, issn string, eissn string",
    )
    by = {r["entry_id"]: r["resolved"] and r["resolved"]["issn"] for r in cat.resolve_record(e, reg).collect()}
    # the last record of a repeated key wins in the registry
    assert by == {1: "11111111", 2: "", 3: None, 4: "33333333"}
    cross = {r["entry_id"]: r["matched_by"] for r in cat.resolve_cross_key(e, reg).collect()}
    assert cross == {1: 1, 2: None, 3: 2, 4: 0}


def test_records_are_resolved_without_an_aggregate_of_entries(spark):
    reg = spark.createDataFrame([(0, "A", "11111111", "22222222")], "row_pos int, name string, issn string, eissn string")
    rows = [(1, "x", "22222222", ""), (1, "x", "11111111", ""), (None, "x", "11111111", ""), (2, "x", "", "")]
    out = cat.resolve_cross_key(spark.createDataFrame(rows, "entry_id int, name string, issn string, eissn string"), reg)
    # rows of one id, or of none, are looked up on their own
    assert sorted((r["entry_id"] or 0, r["issn"], r["matched_by"], r["resolved"] and r["resolved"]["name"]) for r in out.collect()) == [
        (0, "11111111", 0, "A"), (1, "11111111", 0, "A"), (1, "22222222", 2, "A"), (2, "", None, None)]
    assert "entry_id" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)


def test_discipline_filter(spark):
    j = spark.createDataFrame(
        [(1, ["Psychology, Social Q1"]), (2, ["Women'S Studies"]), (3, ["Economics", "Area Studies"]), (4, [])],
        "k int, categories array<string>",
    )
    pick = lambda d: {r["k"] for r in cat.filter_discipline(j, d).collect()}
    assert pick("Psychology") == {1}
    assert pick("women's studies") == {2}
    assert pick("Area and Asian Studies") == {3}
    assert pick("Law") == set()
    assert cat.filter_quartile(j, "Q7") is j


def test_source_fallback(spark):
    make = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    got = cat.source_fallback(make(), make(5, 6), make(7))
    assert {r["id"] for r in got.collect()} == {5, 6}


def test_source_scope_ignores_blank_ids(spark):
    reg = spark.createDataFrame(
        [(0, "W1", "11111111", ""), (1, "", "22222222", ""), (2, "W2", "", "22222222")],
        "row_pos int, openalex_source_id string, issn string, eissn string",
    )
    ids = spark.createDataFrame([("W1",), ("",)], "source_id string")
    assert {r["row_pos"] for r in cat.search_scope_by_ids(reg, ids).collect()} == {0}
    issns = spark.createDataFrame([("2222-2222",), ("1111",)], "issn string")
    assert {r["row_pos"] for r in cat.search_scope_by_issns(reg, issns).collect()} == {2}


def test_row_number_equals_window_on_a_hot_key(spark):
    from pyspark.sql import Window

    df = spark.range(5000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"),
        "id",
    )
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "id")))
    got = distributed_row_number(df, [F.desc("v"), F.asc("id")], ["g"], "rn", partitions=16)
    assert got.join(want.select("id", "w"), "id").where("rn <> w").count() == 0
    assert got.count() == 5000
    overall = distributed_row_number(df, [F.asc("v"), F.asc("id")], name="rn", partitions=16)
    assert overall.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()[:] == (1, 5000, 5000)


def test_row_number_without_a_number_of_partitions(spark):
    df = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(3)).alias("g"), F.hash("id").alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = distributed_row_number(df, [F.asc("v"), F.asc("id")], ["g"])
        ranks = got.groupBy("g").agg(F.min("rn").alias("a"), F.max("rn").alias("b"), F.countDistinct("rn").alias("n"), F.count("*").alias("c"))
        assert ranks.where("a <> 1 OR b <> c OR n <> c").count() == 0
        assert got.alias("x").join(got.alias("y"), F.expr("x.g = y.g AND x.rn = y.rn - 1 AND x.v > y.v")).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_row_number_handles_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    got = {(r["g"], r["v"], r["rn"]) for r in distributed_row_number(df, [F.asc("v")], ["g"]).collect()}
    assert got == {(None, 1, 1), (None, 2, 2), ("a", 3, 1)}


def test_pick_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r["v"] for r in first_per_key(df, ["k"], ["o"]).collect()} == {"y", "z"}
    assert {r["v"] for r in last_per_key(df, ["k"], ["o"]).collect()} == {"x", "z"}


def test_order_ignores_case_and_accents(spark):
    df = spark.createDataFrame([("zeta",), ("Élan",), ("elan",), ("Alpha",), ("ELAN",)], "n string")
    got = [r["n"] for r in jb.sort_base_insensitive(df, "n").orderBy("rank").collect()]
    assert got[0] == "Alpha" and got[-1] == "zeta" and set(got[1:4]) == {"Élan", "elan", "ELAN"}


def test_facets_and_letters(spark):
    j = spark.createDataFrame(
        [("abc", ["Women Studies", "Law"], "P"), ("éa", ["women's studies"], ""), ("Abd", ["Economics"], "P")],
        "title string, categories array<string>, publisher string",
    )
    assert {r[0] for r in cat.facet_disciplines(j).collect()} == {"Women's Studies", "Law", "Economics"}
    assert {(r["discipline"], r["ord"]) for r in cat.facet_ordered_canonical(cat.facet_disciplines(j)).collect()} == {("Economics", 4), ("Women's Studies", 13)}
    assert {r[0] for r in cat.facet_publishers(j).collect()} == {"P"}
    assert {(r["letter"], r["n"]) for r in cat.letter_groups(j).collect()} == {("A", 2), ("#", 1)}


def test_discipline_without_journals_takes_its_metric_file(spark):
    from shelfspark.plans.catalogue import journal_catalogue

    journals = spark.createDataFrame([("A", "1111-1111", "", "P", ["Law"])], "title string, issn string, eissn string, publisher string, categories array<string>")
    metrics = spark.createDataFrame(
        [("f1", "Social Work", "One", "2222-2222", "", "P", "SSCI", "Q1", "1.5", "1", "2", "3", "O", 1), ("f2", "Arts", "Two", "3333-3333", "", "P", "SSCI", "Q2", "1", "1", "2", "3", "T", 1)],
        "file_name string, file_discipline string, journal_name string, issn_print string, issn_e string, publisher string, edition string, quartile string, jif string, jci string, oa_citable_pct string, total_citations string, jcr_abbrev string, line int",
    )
    index = cat.metric_index(metrics, line_cols=["line"])
    assert [r["title"] for r in journal_catalogue(journals, index, discipline="Law", metrics=metrics).collect()] == ["A"]
    got = journal_catalogue(journals, index, discipline="Social Work", metrics=metrics).collect()
    assert [(r["title"], r["jif"]) for r in got] == [("One", "1.5")]


def test_letter_groups_of_sharp_s_and_no_title(spark):
    j = spark.createDataFrame([("ßa",), ("sa",), ("",), (None,), (None,)], "title string")
    assert {tuple(r) for r in cat.letter_groups(j).collect()} == {("#", 2, 1), ("S", 1, 0), ("#", 2, None)}
