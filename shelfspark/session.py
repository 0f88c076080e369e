"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "shelfspark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (AQE, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and Spark runs in local mode (tests, laptops) is a temporary folder used.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not named:
        active = spark.sparkContext.getCheckpointDir()
        if active:
            return active
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; never reused between runs, removed by :func:`clear_scratch`."""
    path = f"{work_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove what this process wrote below the shared folder. Call it once the results that read it are written.

    Goes through Spark's file system, so it works on any store. Returns the number of paths removed.
    """
    conf, removed = spark._jsc.hadoopConfiguration(), 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Input with fewer splits than the cluster has slots, dealt out to all of them.

    For work that is heavy per row (text parsing) over a small or unsplittable file.
    Input of many splits, the normal case at scale, passes without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once into the shared folder and read back.

    For aggregates that are much smaller than their input: later joins plan with the
    true size, so Spark broadcasts the table only while it is below its threshold and
    shuffles otherwise, and a lost executor does not repeat the aggregation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: So many buckets at most, or four for each core of a larger cluster.
BUCKETS = 64


@contextlib.contextmanager
def bucketed(df: DataFrame, label: str, key: str) -> Iterator[DataFrame]:
    """``df`` written once in buckets of ``key``; a join by ``key`` moves the other side only. A table of the session inside the block.

    The number of buckets divides that of the shuffle partitions, so that a task that has its rows by ``key`` writes one bucket.
    """
    spark = df.sparkSession
    most, parts = max(BUCKETS, 4 * spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(d for d in range(1, min(most, parts) + 1) if parts % d == 0)
    if n < min(parts, most // 4):
        n = min(parts, most)
        df = df.repartition(n, key)
    path = scratch_path(spark, label)
    name = "shelfspark_" + uuid.uuid4().hex
    df.write.bucketBy(n, key).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
