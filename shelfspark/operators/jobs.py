"""Job logs, retention and versioned files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.files import summaries_version_label, version_parse
from shelfspark.operators.ranking import distributed_row_number, last_per_key


def _ago(now: str | Column, days: int) -> Column:
    t = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return t - F.make_dt_interval(days=F.lit(days))


def job_rollup(files: DataFrame, job: str = "job_id") -> DataFrame:
    """One row per job: newest mtime of its files, bytes by kind, finished flag."""
    return files.groupBy(job).agg(
        F.max("mtime").alias("mtime"),
        F.coalesce(F.sum(F.when(F.col("kind") == "log", F.col("size"))), F.lit(0)).alias("size_log"),
        F.coalesce(F.sum(F.when(F.col("kind") == "meta", F.col("size"))), F.lit(0)).alias("size_meta"),
        F.max(F.coalesce((F.col("kind") == "meta") & F.col("done"), F.lit(False))).alias("done"),
    )


def archived_ids(files: DataFrame, job: str = "job_id") -> DataFrame:
    """Jobs with a file below an archive partition."""
    return files.where(F.col("archived")).select(job).distinct()


def retention_archive(jobs: DataFrame, now: str | Column, days: int = K.ARCHIVE_DAYS_DEFAULT) -> DataFrame:
    """Jobs to archive: mtime at or before the cutoff."""
    days = min(max(days, K.ARCHIVE_DAYS_MIN), K.ARCHIVE_DAYS_MAX)
    return jobs.where(F.col("mtime") <= _ago(now, days)).withColumn("month", F.date_format("mtime", "yyyy-MM"))


def retention_delete(jobs: DataFrame, now: str | Column, days: int) -> DataFrame:
    """Jobs to delete: mtime strictly before the cutoff."""
    return jobs.where(F.col("mtime") < _ago(now, max(1, days)))


def keep_last_n_jobs(jobs: DataFrame, n: int, job: str = "job_id") -> DataFrame:
    """Every job with ``kept``: true for the ``n`` newest.

    A top-n (no global window) finds the kept ids; the frame is joined back on the id.
    """
    newest = jobs.orderBy(F.desc("mtime"), F.asc(job)).limit(n).select(job, F.lit(True).alias("_k"))
    return jobs.join(newest, job, "left").withColumn("kept", F.coalesce("_k", F.lit(False))).drop("_k")


def retention_keep_last(jobs: DataFrame, n: int, job: str = "job_id") -> DataFrame:
    """How many jobs stay and how many are retired."""
    return keep_last_n_jobs(jobs, n, job).agg(
        F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("retired")
    )


def retention_archive_partitions(files: DataFrame, now: str | Column, days: int) -> DataFrame:
    """Archive months whose newest file is strictly before the cutoff."""
    months = files.groupBy("month").agg(F.max("mtime").alias("mtime"), F.count("*").alias("n_files"))
    return months.where(F.col("mtime") < _ago(now, max(1, days)))


def retired_to_months(jobs: DataFrame) -> DataFrame:
    """Retired jobs with the month they move to."""
    return jobs.withColumn("month", F.date_format("mtime", "yyyy-MM"))


def next_version(versions: DataFrame, date_tag: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Version number the next file gets: largest of the day plus one, 1 for a new day."""
    rows = versions.where(F.col("date_tag") == date_tag) if date_tag else versions
    return rows.groupBy(*by).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def near_version_match(
    latest: DataFrame, versions: DataFrame, topic: str = "topic", millis: int = K.VERSION_MATCH_MILLIS
) -> DataFrame:
    """Newest version of each topic written within ``millis`` of its latest file.

    The range condition becomes an equi join: a version falls in one time bucket of
    ``millis``, the latest file probes its own bucket and both neighbours.
    """
    millis_of = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    bucket = lambda: F.floor(millis_of("mtime") / millis)
    left = latest.select(
        topic,
        F.col("mtime").alias("latest_mtime"),
        F.explode(F.sequence(bucket() - 1, bucket() + 1)).alias("_b"),
    )
    right = versions.select(topic, F.col("name"), F.col("mtime").alias("version_mtime"), bucket().alias("_b"))
    gap = F.abs(millis_of("latest_mtime") - millis_of("version_mtime"))
    return (
        left.join(right, [topic, "_b"])
        .where(gap < millis)
        .groupBy(topic)
        .agg(F.max_by(F.struct("name", "version_mtime"), F.struct("version_mtime", "name")).alias("m"))
        .select(topic, "m.*")
    )


# --- orders: the position is a column, so that it survives a write ----------------------


def stage_file_key(name: str = "name") -> Column:
    v = version_parse(name)
    number = v["version"].cast("string")
    # padded to four digits, never cut
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return (
        F.when(F.contains(F.col(name), F.lit("_latest.")), F.lit("9_latest"))
        .when(v.isNotNull(), F.concat(F.lit("1_"), v["date_tag"], F.lit("_"), padded))
        .otherwise(F.concat(F.lit("2_"), F.col(name)))
    )


def sort_stage_files(files: DataFrame, by: Sequence[str] = ("topic", "stage"), rank: str = "rank") -> DataFrame:
    """Latest file first, then other files, then versions new to old."""
    keyed = files.withColumn("sort_key", stage_file_key())
    return distributed_row_number(keyed, [F.desc("sort_key"), F.asc("name")], list(by), rank)


def sort_versions(files: DataFrame, by: Sequence[str] = ("topic",), rank: str = "rank") -> DataFrame:
    """Current file on top, then versions by date and number, new to old, with labels."""
    v = version_parse("name")
    keyed = (
        files.withColumn("is_latest", v.isNull().cast("int"))
        .withColumn("date_tag", F.coalesce(v["date_tag"], F.lit("")))
        .withColumn("version", F.coalesce(v["version"], F.lit(0)))
        .withColumn("label", summaries_version_label("name"))
    )
    order = [F.desc("is_latest"), F.desc("date_tag"), F.desc("version"), F.asc("name")]
    return distributed_row_number(keyed, order, list(by), rank)


def sort_jobs_recent(jobs: DataFrame, job: str = "job_id", rank: str = "rank") -> DataFrame:
    return distributed_row_number(jobs, [F.desc("mtime"), F.asc(job)], name=rank)


def sort_topics(topics: DataFrame, rank: str = "rank") -> DataFrame:
    return distributed_row_number(topics, [F.asc("topic")], name=rank)


def sort_base_insensitive(df: DataFrame, column: str, tie: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Order that ignores case and accents, then by the raw value."""
    order = [F.collate(F.col(column), "UNICODE_CI_AI").asc(), F.asc(column), *[F.asc(t) for t in tie]]
    return distributed_row_number(df, order, name=rank)


# --- session log -----------------------------------------------------------------------

START_MARK = r"^====== (\S+) started ======$"
FINISH_MARK = r"^====== (\S+) finished (?:code=)?(\S*) ?======$"


def session_blocks(lines: DataFrame, job: str = "job_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """Block of each job in a session log: first start mark to the first finish mark.

    Every line carries its job, so interleaved jobs do not swallow each other. Start
    and finish are combinable aggregates, and a job with very many lines costs one
    row per task.
    """
    finish_pos = F.when(F.col(line).rlike(FINISH_MARK), F.col(pos))
    marks = lines.groupBy(job).agg(
        F.min(F.when(F.col(line).rlike(START_MARK), F.col(pos))).alias("start_pos"),
        F.min(finish_pos).alias("finish_pos"),
        F.min_by(F.regexp_extract(line, FINISH_MARK, 2), finish_pos).alias("code"),
        F.count("*").alias("n_lines"),
        F.max(pos).alias("last_pos"),
    )
    return marks.where(F.col("start_pos").isNotNull()).withColumn("finished", F.col("finish_pos").isNotNull())


def block_lines(lines: DataFrame, blocks: DataFrame, job: str = "job_id", pos: str = "pos") -> DataFrame:
    """Lines inside the finished blocks, in rows; their order is ``pos``."""
    span = blocks.where("finished").select(job, "start_pos", "finish_pos")
    return lines.join(span, job).where(F.col(pos).between(F.col("start_pos"), F.col("finish_pos"))).drop(
        "start_pos", "finish_pos"
    )


def purge_archived_blocks(lines: DataFrame, archived: DataFrame, job: str = "job_id") -> DataFrame:
    """Lines of jobs that are not archived."""
    return lines.join(archived.select(job).distinct(), job, "left_anti")
