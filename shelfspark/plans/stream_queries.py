"""Streams over log lines that Spark writes from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.plans.job_queries import job_files, session_lines
from shelfspark.operators.jobs import archived_ids
from shelfspark.plans.registry import query
from shelfspark.session import scratch_path
from shelfspark.streaming import drain, fold_blocks, fold_status, job_status_stream, parts_with_late, purge_archived_stream, session_blocks_stream

# jobs start 10,000 seconds apart; positions of a job are seconds after its start
_DELAY = "1 hour"
_TS = "timestamp_seconds(1704067200 + cast(substr(job_id, 5) AS BIGINT) * 10000 + pos - cast(substr(job_id, 5) AS BIGINT) * 1000) AS ts"


def line_stream(spark, sf, files_per_batch: int | None = None):
    path = scratch_path(spark, "lines")
    lines = session_lines(spark, sf).selectExpr("job_id", _TS, "line")
    lines.write.parquet(path)
    reader = spark.readStream.schema(lines.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


_JOBS = """j AS (SELECT conv_id, 'job_' || conv_id AS job_id, 1704067200 + conv_id * 10000 AS t0, max(turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id)"""


@query(
    "job_status_stream",
    f"""WITH {_JOBS} SELECT job_id, t0 + last * 2 + CASE WHEN conv_id % 20 = 1 THEN 3 WHEN conv_id % 10 > 0 THEN 1 ELSE 0 END AS last_activity,
      CASE WHEN conv_id % 20 = 1 THEN '9' WHEN conv_id % 10 > 0 THEN (conv_id % 3)::VARCHAR ELSE '-' END AS exit_code, CASE WHEN conv_id % 10 > 0 THEN 'done' ELSE 'running' END AS state FROM j""",
)
def job_status_stream_(spark, sf):
    # the files come in any order; lines behind the watermark are written aside and folded in
    out = fold_status(parts_with_late(line_stream(spark, sf, files_per_batch=4), job_status_stream, delay=_DELAY))
    return out.select("job_id", F.unix_seconds("last_activity").alias("last_activity"), F.coalesce("exit_code", F.lit("-")).alias("exit_code"), "state")


@query(
    "session_blocks_stream",
    f"""WITH {_JOBS} SELECT job_id, t0 - 1 AS started_at, CASE WHEN conv_id % 10 > 0 THEN t0 + last * 2 + 1 ELSE -1 END AS finished_at, CASE WHEN conv_id % 10 > 0 THEN (conv_id % 3)::VARCHAR ELSE '-' END AS code,
      n + 1 + (conv_id % 10 > 0)::INT + (conv_id % 20 = 1)::INT AS n_lines FROM j""",
)
def session_blocks_stream_(spark, sf):
    out = fold_blocks(parts_with_late(line_stream(spark, sf, files_per_batch=4), session_blocks_stream, delay=_DELAY))
    return out.select(
        "job_id",
        F.unix_seconds("started_at").alias("started_at"),
        F.coalesce(F.unix_seconds("finished_at"), F.lit(-1)).alias("finished_at"),
        F.coalesce("code", F.lit("-")).alias("code"),
        "n_lines",
    )


@query(
    "purge_archived_stream",
    "SELECT 'job_' || conv_id AS job_id, md5(text) AS line FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)",
)
def purge_archived_stream_(spark, sf):
    kept = purge_archived_stream(line_stream(spark, sf, files_per_batch=8), archived_ids(job_files(spark, sf)))
    out = drain(kept, "append")
    return out.where(~F.col("line").startswith("======")).select("job_id", F.md5("line").alias("line"))
