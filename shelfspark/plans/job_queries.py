"""Job logs, retention, versions and orders over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import jobs as jb
from shelfspark.plans.catalogue_queries import _VERSIONS_SQL, versions
from shelfspark.plans.registry import query
from shelfspark.plans.roles import table, texts

NOW = "2024-01-25 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"
_TS = "strftime(mtime, '%Y-%m-%d %H:%M:%S.%f')"


def _shown(c="mtime"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def job_files(spark, sf):
    """Events as job files: the user is the job, errors are archived copies, purchases outcomes."""
    return table(spark, sf, "events").selectExpr(
        "concat('job_', user_id) AS job_id",
        "ts AS mtime",
        "CASE WHEN event_type = 'purchase' THEN 'meta' ELSE 'log' END AS kind",
        "cast(value * 100 AS BIGINT) AS size",
        "value > 100 AS done",
        "event_type = 'error' AND value > 150 AS archived",
        "date_format(ts, 'yyyy-MM') AS month",
    )


_FILES = """files AS (SELECT 'job_' || user_id AS job_id, ts AS mtime, CASE WHEN event_type = 'purchase' THEN 'meta' ELSE 'log' END AS kind,
   trunc(value * 100)::BIGINT AS size, value > 100 AS done, (event_type = 'error' AND value > 150) AS archived FROM events)"""
_JOBS = f"""{_FILES}, jobs AS (SELECT job_id, max(mtime) AS mtime, coalesce(sum(size) FILTER (kind = 'log'), 0)::BIGINT AS size_log, coalesce(sum(size) FILTER (kind = 'meta'), 0)::BIGINT AS size_meta,
   max((kind = 'meta' AND done)::INT) AS done FROM files GROUP BY job_id)"""


def jobs(spark, sf):
    return jb.job_rollup(job_files(spark, sf))


@query("job_rollup", f"WITH {_JOBS} SELECT job_id, {_TS} AS mtime, size_log, size_meta, done FROM jobs")
def job_rollup(spark, sf):
    return jobs(spark, sf).select("job_id", _shown(), "size_log", "size_meta", F.col("done").cast("int").alias("done"))


@query("archived_ids", f"WITH {_FILES} SELECT DISTINCT job_id FROM files WHERE archived")
def archived_ids(spark, sf):
    return jb.archived_ids(job_files(spark, sf))


def _single(spark, sf):
    """Every event as a job of its own, so that cutoffs fall among many jobs."""
    return table(spark, sf, "events").selectExpr("event_id AS job_id", "ts AS mtime")


@query("retention_archive", f"SELECT event_id AS job_id, strftime(ts, '%Y-%m') AS month FROM events WHERE ts <= {_NOW} - INTERVAL 3 DAY")
def retention_archive(spark, sf):
    return jb.retention_archive(_single(spark, sf), NOW).select("job_id", "month")


@query("retention_delete", f"SELECT event_id AS job_id FROM events WHERE ts < {_NOW} - INTERVAL 1 DAY")
def retention_delete(spark, sf):
    return jb.retention_delete(_single(spark, sf), NOW, 0).select("job_id")


@query("keep_last_n_jobs", f"WITH {_JOBS} SELECT job_id, (row_number() OVER (ORDER BY mtime DESC, job_id) <= 20)::INT AS kept FROM jobs")
def keep_last_n_jobs(spark, sf):
    return jb.keep_last_n_jobs(jobs(spark, sf), 20).select("job_id", F.col("kept").cast("int").alias("kept"))


@query("retention_keep_last", "SELECT count(*) AS total, 50 AS kept, count(*) - 50 AS retired FROM events")
def retention_keep_last(spark, sf):
    return jb.retention_keep_last(_single(spark, sf), 50)


@query(
    "retention_archive_partitions",
    f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_files FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1999-06-01' - INTERVAL 30 DAY""",
)
def retention_archive_partitions(spark, sf):
    files = table(spark, sf, "orders").selectExpr("date_format(o_orderdate, 'yyyy-MM') AS month", "o_orderdate AS mtime")
    return jb.retention_archive_partitions(files, "1999-06-01 00:00:00", 30).select("month", "n_files")


@query("retired_to_months", "SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def retired_to_months(spark, sf):
    files = table(spark, sf, "orders").selectExpr("o_orderkey AS job_id", "o_orderdate AS mtime")
    return jb.retired_to_months(files).select("job_id", "month")


# --- versions and orders -----------------------------------------------------------------


@query("next_version", f"WITH {_VERSIONS_SQL} SELECT prefix, max(version) + 1 AS next_version FROM versions WHERE date_tag = '20240115' GROUP BY prefix")
def next_version(spark, sf):
    return jb.next_version(versions(spark, sf), "20240115", by=["prefix"])


@query(
    "near_version_match",
    """WITH l AS (SELECT user_id AS topic, max(ts) + CASE WHEN user_id % 2 = 0 THEN INTERVAL 1500 MILLISECOND ELSE INTERVAL 2500 MILLISECOND END AS m FROM events GROUP BY user_id),
     v AS (SELECT user_id AS topic, event_id, ts FROM events)
     SELECT topic, 'v' || arg_max(event_id, ts) AS name FROM l JOIN v USING (topic) WHERE abs(epoch_ms(m) - epoch_ms(ts)) < 2000 GROUP BY topic""",
)
def near_version_match(spark, sf):
    e = table(spark, sf, "events")
    shift = F.when(F.col("topic") % 2 == 0, F.expr("INTERVAL 1.5 SECONDS")).otherwise(F.expr("INTERVAL 2.5 SECONDS"))
    latest = e.groupBy(F.col("user_id").alias("topic")).agg(F.max("ts").alias("m")).select("topic", (F.col("m") + shift).alias("mtime"))
    vs = e.selectExpr("user_id AS topic", "concat('v', event_id) AS name", "ts AS mtime")
    return jb.near_version_match(latest, vs).select("topic", "name")


_STAGE = "CASE event_id % 6 WHEN 0 THEN '01_raw' WHEN 1 THEN '02_clean' WHEN 2 THEN '03_summaries' WHEN 3 THEN '04_meta' WHEN 4 THEN '05_report' ELSE '06_review' END"
_STAGE_NAME = "CASE event_id % 7 WHEN 0 THEN concat('p', event_id, '_latest.md') WHEN 1 THEN concat('notes-', event_id, '.md') ELSE concat('papers', event_id % 3, '_', date_format(ts, 'yyyyMMdd'), '_v', event_id + 5000, '.md') END"
_STAGE_NAME_SQL = _STAGE_NAME.replace("date_format(ts, 'yyyyMMdd')", "strftime(ts, '%Y%m%d')")


def stage_files(spark, sf):
    return table(spark, sf, "events").selectExpr("event_type AS topic", f"{_STAGE} AS stage", f"{_STAGE_NAME} AS name")


@query(
    "sort_stage_files",
    f"""WITH f AS (SELECT event_type AS topic, {_STAGE} AS stage, {_STAGE_NAME_SQL} AS name, CASE event_id % 7 WHEN 0 THEN '9_latest' WHEN 1 THEN '2_notes-' || event_id || '.md' ELSE '1_' || strftime(ts, '%Y%m%d') || '_' || repeat('0', greatest(0, 4 - length((event_id + 5000)::VARCHAR))) || (event_id + 5000)::VARCHAR END AS sort_key FROM events)
     SELECT topic, stage, name, row_number() OVER (PARTITION BY topic, stage ORDER BY sort_key DESC, name) AS rank FROM f""",
)
def sort_stage_files(spark, sf):
    return jb.sort_stage_files(stage_files(spark, sf)).select("topic", "stage", "name", "rank")


@query(
    "sort_versions",
    """WITH f AS (SELECT event_type AS topic, CASE WHEN event_id % 50 = 0 THEN 'summaries_latest.md' ELSE 'summaries_' || strftime(ts, '%Y%m%d') || '_v' || event_id || '.md' END AS name, event_id, event_id % 50 = 0 AS l, strftime(ts, '%Y%m%d') AS d, strftime(ts, '%Y-%m-%d') AS dd FROM events),
      g AS (SELECT DISTINCT topic, name, l, CASE WHEN l THEN '' ELSE d END AS d, CASE WHEN l THEN 0 ELSE event_id END AS v, CASE WHEN l THEN '当前使用 (summaries_latest)' ELSE dd || ' v' || event_id END AS label FROM f)
     SELECT topic, name, label, row_number() OVER (PARTITION BY topic ORDER BY l DESC, d DESC, v DESC, name) AS rank FROM g""",
)
def sort_versions(spark, sf):
    f = table(spark, sf, "events").selectExpr(
        "event_type AS topic",
        "CASE WHEN event_id % 50 = 0 THEN 'summaries_latest.md' ELSE concat('summaries_', date_format(ts, 'yyyyMMdd'), '_v', event_id, '.md') END AS name",
    ).distinct()
    return jb.sort_versions(f).select("topic", "name", "label", "rank")


@query("sort_jobs_recent", "SELECT event_id AS job_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rank FROM events")
def sort_jobs_recent(spark, sf):
    return jb.sort_jobs_recent(_single(spark, sf)).select("job_id", "rank")


@query("sort_topics", "SELECT topic, row_number() OVER (ORDER BY topic) AS rank FROM (SELECT DISTINCT lang || '/' || source AS topic FROM documents)")
def sort_topics(spark, sf):
    topics = texts(spark, sf, "documents").selectExpr("concat(lang, '/', source) AS topic").distinct()
    return jb.sort_topics(topics)


_MIXED = "CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') WHEN 2 THEN initcap(p_name) ELSE p_name END"


@query(
    "sort_base_insensitive",
    """WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') WHEN 2 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS name FROM part)
     SELECT p_partkey, name, row_number() OVER (ORDER BY lower(strip_accents(name)), name, p_partkey) AS rank FROM n""",
)
def sort_base_insensitive(spark, sf):
    named = table(spark, sf, "part").selectExpr("p_partkey", f"{_MIXED} AS name")
    return jb.sort_base_insensitive(named, "name", ["p_partkey"])


# --- session log --------------------------------------------------------------------------------



def session_lines(spark, sf):
    """Turns as log lines between a start and a finish mark per conversation; every tenth never finishes."""
    turns = texts(spark, sf, "conversations")
    per = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    starts = per.selectExpr("concat('job_', conv_id) AS job_id", "conv_id * 1000 - 1 AS pos", "concat('====== job_', conv_id, ' started ======') AS line")
    finish = per.where("conv_id % 10 > 0").selectExpr(
        "concat('job_', conv_id) AS job_id", "conv_id * 1000 + last * 2 + 1 AS pos", "concat('====== job_', conv_id, ' finished code=', conv_id % 3, ' ======') AS line"
    )
    again = per.where("conv_id % 20 = 1").selectExpr(
        "concat('job_', conv_id) AS job_id", "conv_id * 1000 + last * 2 + 3 AS pos", "concat('====== job_', conv_id, ' finished code=9 ======') AS line"
    )
    return turns.selectExpr("concat('job_', conv_id) AS job_id", "conv_id * 1000 + turn * 2 AS pos", "text AS line").unionByName(starts).unionByName(finish).unionByName(again)


_BLOCKS = """blocks AS (SELECT 'job_' || conv_id AS job_id, conv_id, conv_id * 1000 - 1 AS start_pos, CASE WHEN conv_id % 10 > 0 THEN conv_id * 1000 + max(turn) * 2 + 1 END AS finish_pos,
   CASE WHEN conv_id % 10 > 0 THEN (conv_id % 3)::VARCHAR END AS code, count(*) + 1 + (conv_id % 10 > 0)::INT + (conv_id % 20 = 1)::INT AS n_lines FROM conversations GROUP BY conv_id)"""


@query(
    "session_blocks",
    f"WITH {_BLOCKS} SELECT job_id, start_pos, coalesce(finish_pos, -1) AS finish_pos, coalesce(code, '-') AS code, n_lines, (finish_pos IS NOT NULL)::INT AS finished FROM blocks",
)
def session_blocks(spark, sf):
    b = jb.session_blocks(session_lines(spark, sf))
    return b.select(
        "job_id",
        "start_pos",
        F.coalesce("finish_pos", F.lit(-1)).alias("finish_pos"),
        F.coalesce("code", F.lit("-")).alias("code"),
        "n_lines",
        F.col("finished").cast("int").alias("finished"),
    )


@query(
    "session_block_lines",
    f"""WITH {_BLOCKS} SELECT job_id, conv_id * 1000 + turn * 2 AS pos, md5(text) AS line FROM conversations JOIN blocks USING (conv_id) WHERE finish_pos IS NOT NULL
     UNION ALL SELECT job_id, start_pos, md5('====== ' || job_id || ' started ======') FROM blocks WHERE finish_pos IS NOT NULL
     UNION ALL SELECT job_id, finish_pos, md5('====== ' || job_id || ' finished code=' || code || ' ======') FROM blocks WHERE finish_pos IS NOT NULL""",
)
def session_block_lines(spark, sf):
    lines = session_lines(spark, sf)
    return jb.block_lines(lines, jb.session_blocks(lines)).select("job_id", "pos", F.md5("line").alias("line"))


@query(
    "purge_archived_blocks",
    "SELECT 'job_' || conv_id AS job_id, conv_id * 1000 + turn * 2 AS pos FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)",
)
def purge_archived_blocks(spark, sf):
    archived = jb.archived_ids(job_files(spark, sf))
    kept = jb.purge_archived_blocks(session_lines(spark, sf), archived)
    return kept.where(~F.col("line").startswith("======")).select("job_id", "pos")
