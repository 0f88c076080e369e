"""Writers: versioned tables, per-job subsets, monthly archives."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.jobs import retired_to_months


_CLAIMED, _COMMITTED = "_claimed", "_committed"  # names that readers of the data pass over


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file if it does not exist; whether this call created it.

    Atomic where the file system's create without overwrite is, as on HDFS. The local one looks first and creates then, so
    there the file is created by the operating system's own call.
    """
    p, fs = _file_system(spark, path)
    try:
        if str(fs.getScheme()) == "file":
            fs.mkdirs(p.getParent())
            none = spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)
            spark._jvm.java.nio.file.Files.createFile(spark._jvm.java.nio.file.Path.of(fs.makeQualified(p).toUri()), none)
        else:
            fs.create(p, False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass()):
            raise
        return False


def _marked(spark: SparkSession, path: str, kind: str) -> list[tuple[str, int]]:
    """(date_tag, version) of the markers of one kind; one small file a version, listed and not read."""
    p, fs = _file_system(spark, f"{path}/{kind}")
    if not fs.exists(p):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(p)]
    found = [re.fullmatch(r"(\d+)_v(\d+)", n) for n in names]
    return [(m[1], int(m[2])) for m in found if m]


def sink_versioned(df: DataFrame, path: str, date_tag: str) -> int:
    """Write ``df`` as the next version of the day and return its number.

    A number is claimed by creating its marker, which one writer only can do; the others go on to the next number. The data
    are written to a partition of that number, and a second marker commits it: readers see whole versions only, whatever
    becomes of a writer on its way. "Latest" is one partition (:func:`read_latest`), not a second copy.
    """
    spark = df.sparkSession
    n = 1 + max((v for tag, v in _marked(spark, path, _CLAIMED) if tag == date_tag), default=0)
    while not _create(spark, f"{path}/{_CLAIMED}/{date_tag}_v{n}"):
        n += 1
    df.write.mode("errorifexists").parquet(f"{path}/date_tag={date_tag}/version={n}")
    _create(spark, f"{path}/{_COMMITTED}/{date_tag}_v{n}")
    return n


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Newest committed version of a versioned table, with ``date_tag`` and ``version``; no other partition is listed."""
    versions = _marked(spark, path, _COMMITTED)
    if not versions:
        raise ValueError(f"no committed version in {path}")
    tag, n = max(versions)
    return spark.read.option("basePath", path).parquet(f"{path}/date_tag={tag}/version={n}")


def sink_job_subset(journals: DataFrame, path: str, job_id: str) -> None:
    """Journals of one search run, in their own partition; a rerun replaces it."""
    journals.withColumn("job_id", F.lit(job_id)).write.partitionBy("job_id").option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").parquet(path)


def sink_archive_by_month(jobs: DataFrame, path: str) -> None:
    """Append jobs to ``month=YYYY-MM`` partitions (month of mtime in the session zone, UTC).

    Jobs that are in their month already are left out, so a rerun adds nothing.
    """
    spark = jobs.sparkSession
    months = retired_to_months(jobs)
    try:
        held = spark.read.parquet(path).select(F.col("month").cast("string").alias("month"), "job_id")
        months = months.join(held, ["month", "job_id"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    # rows of one month may fill many files; the extra key keeps a hot month off a single task
    spread = months.repartition("month", F.pmod(F.xxhash64("job_id"), F.lit(32)))
    spread.write.partitionBy("month").mode("append").parquet(path)


__all__ = ["read_latest", "sink_archive_by_month", "sink_job_subset", "sink_versioned"]
