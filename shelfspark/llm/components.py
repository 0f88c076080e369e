"""Connected components of a link table, by alternating large and small stars.

Every round is two group minima with map-side combine and two equi joins, so a node with any number of
neighbours never meets in one task as a list; AQE splits the join of a hot node. Each round's links
are written to the shared folder, so a lost executor repeats one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import written

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(rest).where("a <> b").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b: long); component is the smallest node reachable.

    Links of a node with itself are ignored; no links give no rows.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(now, label)
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        now = written(_small_star(_large_star(now)), label)
        last, state = state, _state(now)
        if state == last:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
