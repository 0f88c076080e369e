"""Retention, versions and session blocks."""

from pyspark.sql import functions as F

from shelfspark.operators import jobs as jb

NOW = "2026-02-20 12:00:00"


def jobs(spark, *rows):
    return spark.createDataFrame(rows, "job_id string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))


def ids(df):
    return {r["job_id"] for r in df.collect()}


def test_archive_takes_the_cutoff_and_delete_does_not(spark):
    j = jobs(spark, ("old", "2026-02-16 00:00:00"), ("edge", "2026-02-17 12:00:00"), ("new", "2026-02-17 12:00:01"))
    assert ids(jb.retention_archive(j, NOW, 3)) == {"old", "edge"}
    assert ids(jb.retention_delete(j, NOW, 3)) == {"old"}
    # days are clamped
    assert ids(jb.retention_archive(j, NOW, 0)) == {"old", "edge", "new"}
    assert ids(jb.retention_archive(j, NOW, 9999)) == set()
    assert ids(jb.retention_delete(j, NOW, -5)) == {"old", "edge", "new"}


def test_keep_last_is_a_partition_of_the_jobs(spark):
    j = spark.range(200).select(F.concat(F.lit("j"), F.col("id")).alias("job_id"), F.timestamp_seconds(F.col("id") % 50).alias("mtime"))
    for n in (0, 1, 7, 200, 500):
        r = jb.retention_keep_last(j, n).first()
        assert (r["total"], r["kept"], r["retired"]) == (200, min(n, 200), 200 - min(n, 200))
    oldest_kept = jb.keep_last_n_jobs(j, 7).where("kept").agg(F.min("mtime")).first()[0]
    assert jb.keep_last_n_jobs(j, 7).where(~F.col("kept") & (F.col("mtime") > oldest_kept)).count() == 0


def test_rollup_and_months(spark):
    f = spark.createDataFrame(
        [("a", "2026-01-31 23:59:59", "log", 5, None), ("a", "2026-02-01 00:00:00", "meta", 2, True), ("b", "2026-01-01 00:00:00", "log", 1, None)],
        "job_id string, mtime string, kind string, size long, done boolean",
    ).withColumn("mtime", F.col("mtime").cast("timestamp"))
    r = {x["job_id"]: (x["size_log"], x["size_meta"], x["done"]) for x in jb.job_rollup(f).collect()}
    assert r == {"a": (5, 2, True), "b": (1, 0, False)}
    assert {x["month"] for x in jb.retired_to_months(jb.job_rollup(f)).collect()} == {"2026-02", "2026-01"}


def test_version_orders(spark):
    names = ["papers_20260221_v2.md", "papers_20260221_v10.md", "papers_latest.md", "notes.md", "papers_20260301_v1.md"]
    f = spark.createDataFrame([("t", "01_raw", n) for n in names], "topic string, stage string, name string")
    got = [r["name"] for r in jb.sort_stage_files(f).orderBy("rank").collect()]
    assert got == ["papers_latest.md", "notes.md", "papers_20260301_v1.md", "papers_20260221_v10.md", "papers_20260221_v2.md"]
    v = spark.createDataFrame([("t", n) for n in names if n != "notes.md"], "topic string, name string")
    assert [r["label"] for r in jb.sort_versions(v).orderBy("rank").collect()] == ["当前使用 (summaries_latest)", "2026-03-01 v1", "2026-02-21 v10", "2026-02-21 v2"]


def test_stage_file_versions_are_padded_not_cut(spark):
    names = [f"papers_20260221_v{v}.md" for v in (9, 999, 9999, 10000, 12340, 12345, 12349)]
    f = spark.createDataFrame([("t", "01_raw", n) for n in names], "topic string, stage string, name string")
    keys = {r["name"]: r["k"] for r in f.select("name", jb.stage_file_key().alias("k")).collect()}
    assert [keys[n][11:] for n in names] == ["0009", "0999", "9999", "10000", "12340", "12345", "12349"]
    got = [r["name"] for r in jb.sort_stage_files(f).orderBy("rank").collect()]
    assert got == sorted(names, key=lambda n: keys[n], reverse=True)


def test_near_version_takes_the_newest_within_two_seconds(spark):
    ts = lambda df, c="mtime": df.withColumn(c, F.col(c).cast("timestamp"))
    latest = ts(spark.createDataFrame([("t", "2026-02-20 12:00:02"), ("u", "2026-02-20 12:00:02")], "topic string, mtime string"))
    vs = ts(
        spark.createDataFrame(
            [("t", "v1", "2026-02-20 12:00:00.001"), ("t", "v2", "2026-02-20 12:00:03.999"), ("t", "v3", "2026-02-20 12:00:04"), ("u", "w", "2026-02-20 12:00:00")],
            "topic string, name string, mtime string",
        )
    )
    assert {(r["topic"], r["name"]) for r in jb.near_version_match(latest, vs).collect()} == {("t", "v2")}


def test_next_version(spark):
    v = spark.createDataFrame([("20260101", 2), ("20260101", 10), ("20260102", 1)], "date_tag string, version int")
    assert jb.next_version(v, "20260101").first()[0] == 11
    assert jb.next_version(v, "20270101").first()[0] == 1


def session(spark):
    rows = [
        ("job_a", "====== job_a started ======"), ("job_b", "====== job_b started ======"), ("job_a", "one"), ("job_b", "two"),
        ("job_a", "====== job_a finished code=0 ======"), ("job_b", "three"), ("job_a", "====== job_a finished code=1 ======"), ("job_c", "stray"),
    ]
    return spark.createDataFrame([(j, i, t) for i, (j, t) in enumerate(rows)], "job_id string, pos int, line string")


def test_interleaved_jobs_keep_their_lines(spark):
    lines = session(spark)
    b = {r["job_id"]: (r["start_pos"], r["finish_pos"], r["code"], r["finished"]) for r in jb.session_blocks(lines).collect()}
    assert b == {"job_a": (0, 4, "0", True), "job_b": (1, None, None, False)}
    inside = [(r["job_id"], r["pos"]) for r in jb.block_lines(lines, jb.session_blocks(lines)).orderBy("pos").collect()]
    assert inside == [("job_a", 0), ("job_a", 2), ("job_a", 4)]
    gone = spark.createDataFrame([("job_a",), ("job_a",)], "job_id string")
    assert ids(jb.purge_archived_blocks(lines, gone)) == {"job_b", "job_c"}
