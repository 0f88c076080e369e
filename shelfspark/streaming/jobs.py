"""Streams of job log lines ``(job_id, ts, line)``.

Only built-in streaming aggregates are used: they combine on the map side, so a job
with a third of all lines costs one partial row per task and trigger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.jobs import FINISH_MARK, START_MARK
from shelfspark.session import scratch_path


def _finish_ts(ts: str, line: str) -> Column:
    return F.when(F.col(line).rlike(FINISH_MARK), F.col(ts))


def _by_part(lines: DataFrame, job: str, ts: str, span: str, delay: str):
    return lines.withWatermark(ts, delay).groupBy(job, F.window(ts, span).alias("w"))


def job_status_stream(
    lines: DataFrame, job: str = "job_id", ts: str = "ts", line: str = "line", span: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """State of each job by parts of ``span``; run in update mode and read with :func:`fold_status`.

    A part leaves the state once it lies ``delay`` behind the newest line, so the state does not
    grow with the number of jobs; later lines are dropped, :func:`parts_with_late` keeps them. Also works on a batch frame.
    """
    finished = _finish_ts(ts, line)
    state = _by_part(lines, job, ts, span, delay).agg(
        F.max(ts).alias("last_activity"),
        F.max(finished).alias("finished_at"),
        F.max_by(F.regexp_extract(line, FINISH_MARK, 2), finished).alias("exit_code"),
        F.count("*").alias("n_lines"),
    )
    return state.select(job, F.col("w.start").alias("part"), "last_activity", "finished_at", "exit_code", "n_lines")


def fold_status(parts: DataFrame, job: str = "job_id") -> DataFrame:
    """Current state per job from its parts."""
    state = parts.groupBy(job).agg(
        F.max("last_activity").alias("last_activity"),
        F.max("finished_at").alias("finished_at"),
        F.max_by("exit_code", "finished_at").alias("exit_code"),
    )
    return state.withColumn("state", F.when(F.col("finished_at").isNotNull(), "done").otherwise("running"))


def session_blocks_stream(
    lines: DataFrame, job: str = "job_id", ts: str = "ts", line: str = "line", span: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """Start and finish of each job by parts of ``span``; run in update mode and read with :func:`fold_blocks`.

    Open jobs come out too, and a pause of any length does not cut a job. The state is bounded as in
    :func:`job_status_stream`.
    """
    finished = _finish_ts(ts, line)
    marks = _by_part(lines, job, ts, span, delay).agg(
        F.min(F.when(F.col(line).rlike(START_MARK), F.col(ts))).alias("started_at"),
        F.min(finished).alias("finished_at"),
        F.min_by(F.regexp_extract(line, FINISH_MARK, 2), finished).alias("code"),
        F.count("*").alias("n_lines"),
    )
    return marks.select(job, F.col("w.start").alias("part"), "started_at", "finished_at", "code", "n_lines")


def fold_blocks(parts: DataFrame, job: str = "job_id") -> DataFrame:
    """Block per started job from its parts: first start mark to first finish mark, as the batch operator gives it."""
    return (
        parts.groupBy(job)
        .agg(
            F.min("started_at").alias("started_at"),
            F.min("finished_at").alias("finished_at"),
            F.min_by("code", "finished_at").alias("code"),
            F.sum("n_lines").alias("n_lines"),
        )
        .where(F.col("started_at").isNotNull())
    )


def purge_archived_stream(lines: DataFrame, archived: DataFrame, job: str = "job_id") -> DataFrame:
    """Lines of jobs that are not archived (stream-static anti join)."""
    return lines.join(archived.select(job).distinct(), job, "left_anti")


def _run(stream: DataFrame, mode: str, save, state: str):
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return query


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None, progress: list | None = None) -> DataFrame:
    """Run a stream over what is available now and return its result as a table.

    Every batch is written below the shared folder. In update mode a key may be
    written by several batches, the newest one holds its state. ``progress`` receives
    Spark's reports of the batches, rows held in the state among them.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        # overwriting the batch's own folder makes a repeated batch harmless
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = _run(stream, mode, save, state)
    if progress is not None:
        progress.extend(query.recentProgress)
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    if mode != "update" or not keys:
        return written.drop("batch")
    row = F.struct(*[F.col(c) for c in written.columns if c != "batch"])
    return written.groupBy(*keys).agg(F.max_by(row, "batch").alias("r")).select("r.*")


def state_rows(progress: list) -> int:
    """The most rows that any stateful operator of the run held at the end of a batch."""
    return max((op["numRowsTotal"] for p in progress for op in p["stateOperators"]), default=0)


def late_lines(lines: DataFrame, ts: str = "ts", span: str = "1 day", delay: str = "1 day") -> tuple[DataFrame, int]:
    """Rows of a stream that come behind the watermark, as a table, and the number of all rows.

    A second, stateless run over the same source. The watermark of a batch is the newest time of the batches before it less
    ``delay``; a stateful operator drops rows by the watermark of the batch before, if the whole part they belong to lies
    behind it. The newest time of each batch is kept beside the rows, so a repeated batch gives the same.
    """
    spark = lines.sparkSession
    out, marks, state = (scratch_path(spark, n) for n in ("late", "late-marks", "late-state"))
    mark = "batch int, newest timestamp, n long"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        newest = batch.agg(F.max(ts).alias("newest"), F.count("*").alias("n")).select(F.lit(batch_id).alias("batch"), "newest", "n")
        newest.write.mode("overwrite").parquet(f"{marks}/of={batch_id}")
        seen = spark.read.schema(mark).parquet(f"{marks}/of=*").where(F.col("batch") < batch_id - 1).agg(F.max("newest")).first()[0]  # one row a batch
        if seen is not None:
            end = F.window(ts, span)["end"]
            batch.where(end <= F.lit(seen) - F.expr(f"INTERVAL {delay}")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.unpersist()

    spark.createDataFrame([], lines.schema).write.parquet(f"{out}/batch=-1")
    spark.createDataFrame([], mark).write.parquet(f"{marks}/of=-1")
    _run(lines, "append", save, state)
    total = spark.read.schema(mark).parquet(f"{marks}/of=*").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return spark.read.schema(lines.schema).parquet(f"{out}/batch=*"), total


def parts_with_late(lines: DataFrame, parts_of, span: str = "1 day", delay: str = "1 day", job: str = "job_id", ts: str = "ts", progress: list | None = None) -> DataFrame:
    """Parts of a stream (``parts_of`` is :func:`job_status_stream` or :func:`session_blocks_stream`) and those of its late rows.

    No row is lost: what the watermark dropped is written aside and counted as parts of its own, which the fold puts
    together with the others. Both runs read the same batches; if the rows counted by both were not all rows, this would raise.
    """
    main = drain(parts_of(lines, job=job, ts=ts, span=span, delay=delay), "update", [job, "part"], progress)
    late, total = late_lines(lines, ts, span, delay)
    whole = main.unionByName(parts_of(late, job=job, ts=ts, span=span, delay=delay))
    if "n_lines" in whole.columns:
        counted = whole.agg(F.coalesce(F.sum("n_lines"), F.lit(0))).first()[0]
        if counted != total:
            raise RuntimeError(f"{counted} of {total} rows are in the parts: the two runs saw different batches")
    return whole
