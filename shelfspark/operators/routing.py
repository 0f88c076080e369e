"""Rows that pass a set of checks, and the others with the reason, so that a caller learns what was left out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.text import col


def route(df: DataFrame, checks: Mapping[str, Column], reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)``: rows that pass all checks, and the others with the name of the first one that they fail.

    A check that is null has failed. Together the two frames hold every row once; both are lazy and need no shuffle, so any
    reader's output can be routed before it is used.
    """
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    marked = df.withColumn(reason, F.coalesce(*failed) if len(failed) > 1 else failed[0] if failed else F.lit(None).cast("string"))
    return marked.where(F.col(reason).isNull()).drop(reason), marked.where(F.col(reason).isNotNull())


def topic_checks(topic: Column | str) -> dict[str, Column]:
    """What makes a topic slug valid (:func:`shelfspark.functions.predicates.topic_valid`), one check a reason."""
    t = col(topic)
    return {"missing": t.isNotNull(), "empty": F.length(t) > 0, "too long": F.length(t) <= 120, "bad characters": t.rlike(K.TOPIC)}


def path_checks(path: Column | str) -> dict[str, Column]:
    """What makes a path safe below a folder: relative, of plain characters, and never above the folder on its way."""
    p = col(path)
    step = lambda v: F.when(v == "..", -1).when(v.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    walk = lambda acc, v: F.struct((acc["depth"] + step(v)).alias("depth"), F.least(acc["least"], acc["depth"] + step(v)).alias("least"))
    return {
        "missing": p.isNotNull() & (p != ""),
        "absolute": ~F.startswith(p, F.lit("/")),
        "bad characters": p.rlike(K.PLAIN_PATH),
        "leaves the folder": F.aggregate(F.split(p, "/"), start, walk)["least"] >= 0,
    }
