"""A stream gives what the batch gives."""

from pyspark.sql import functions as F

from shelfspark.operators.jobs import purge_archived_blocks, session_blocks
from shelfspark.streaming import drain, fold_blocks, fold_status, job_status_stream, late_lines, parts_with_late, purge_archived_stream, session_blocks_stream, state_rows

START = "timestamp_seconds(1700000000 + pos * 60)"


def lines(spark):
    rows = [("job_a", 0, "====== job_a started ======"), ("job_b", 1, "====== job_b started ======"), ("job_a", 2, "x"), ("job_a", 3, "====== job_a finished code=0 ======"),
            ("job_a", 4, "====== job_a finished code=0 ======"), ("job_b", 500, "y"), ("job_z", 900, "====== job_z started ======")]
    return spark.createDataFrame(rows, "job_id string, pos int, line string").withColumn("ts", F.expr(START))


def stream(spark, tmp_path, per_file=None):
    df = lines(spark)
    path = str(tmp_path / "lines")
    df.repartition(7).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", per_file) if per_file else reader).parquet(path)


def test_status(spark, tmp_path):
    got = fold_status(drain(job_status_stream(stream(spark, tmp_path, 1), span="1 hour", delay="30 days"), "update", ["job_id", "part"]))
    want = fold_status(job_status_stream(lines(spark)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert {r["job_id"]: r["state"] for r in got.collect()} == {"job_a": "done", "job_b": "running", "job_z": "running"}


def test_blocks(spark, tmp_path):
    parts = drain(session_blocks_stream(stream(spark, tmp_path, 2), span="1 hour", delay="30 days"), "update", ["job_id", "part"])
    got = {r["job_id"]: (r["code"], r["n_lines"], r["finished_at"] is not None) for r in fold_blocks(parts).collect()}
    # open jobs, a pause of hours within a job and a second finish mark: the same as in one batch
    want = {r["job_id"]: (r["code"], r["n_lines"], r["finished"]) for r in session_blocks(lines(spark)).collect()}
    assert got == want and set(want) == {"job_a", "job_b", "job_z"}


def ordered(spark, tmp_path, frames):
    """A stream that takes the frames one by one."""
    import os

    for k, part in enumerate(frames):
        path = f"{tmp_path}/ordered/{k}"
        part.coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(frames[0].schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ordered")


def test_late_lines_leave_the_state_and_are_folded_in(spark, tmp_path):
    df = lines(spark)
    more = spark.createDataFrame([("job_z", 1200 + k, "z") for k in range(3)], "job_id string, pos int, line string").withColumn("ts", F.expr(START))
    late = df.where("job_id = 'job_b' and pos = 500").withColumn("line", F.lit("too late"))
    frames = [df.where("pos <= 4"), df.where("pos = 900"), *(more.where(F.col("pos") == 1200 + k) for k in range(3)), late]
    stream_ = ordered(spark, tmp_path, frames)
    kept = drain(session_blocks_stream(stream_, span="1 hour", delay="1 minute"), "update", ["job_id", "part"])
    assert {r["job_id"]: r["n_lines"] for r in fold_blocks(kept).collect()} == {"job_a": 4, "job_b": 1, "job_z": 4}  # the watermark drops it
    aside, total = late_lines(stream_, span="1 hour", delay="1 minute")
    assert [(r["job_id"], r["pos"], r["line"]) for r in aside.collect()] == [("job_b", 500, "too late")] and total == 10
    whole = parts_with_late(stream_, session_blocks_stream, span="1 hour", delay="1 minute")
    assert {r["job_id"]: r["n_lines"] for r in fold_blocks(whole).collect()} == {"job_a": 4, "job_b": 2, "job_z": 4}
    status = fold_status(parts_with_late(stream_, job_status_stream, span="1 hour", delay="1 minute"))
    assert {r["job_id"]: r["last_activity"] for r in status.collect()}["job_b"] == late.first()["ts"]


def test_state_stays_bounded_as_jobs_come_and_go(spark, tmp_path):
    rows = [(f"job_{k}", k * 100 + j, "x") for k in range(12) for j in range(3)]
    df = spark.createDataFrame(rows, "job_id string, pos int, line string").withColumn("ts", F.expr(START))
    frames = [df.where(F.col("job_id") == f"job_{k}") for k in range(12)]
    progress = []
    whole = parts_with_late(ordered(spark, tmp_path, frames), session_blocks_stream, span="1 hour", delay="1 minute", progress=progress)
    assert len({r["job_id"] for r in whole.collect()}) == 12 and len(progress) >= 12
    assert 1 <= state_rows(progress) <= 4  # a job in at most two parts, and those of the batch before


def test_purge(spark, tmp_path):
    gone = spark.createDataFrame([("job_a",)], "job_id string")
    got = drain(purge_archived_stream(stream(spark, tmp_path, 2), gone), "append")
    want = purge_archived_blocks(lines(spark), gone)
    assert sorted(map(str, got.select("job_id", "pos").collect())) == sorted(map(str, want.select("job_id", "pos").collect()))
