"""Column functions for file names, versions and job logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.text import blank_to_null, col, lookup, trim_all

_VERSIONED = r"^(.+?)_(\d{8})_v(\d+)(?:\.[A-Za-z]+)?\z"


def version_parse(name: Column | str) -> Column:
    """``prefix_YYYYMMDD_vN.ext`` to ``struct(prefix, date_tag, version)``, else NULL."""
    n = col(name)
    return F.when(
        n.rlike(_VERSIONED),
        F.struct(
            F.regexp_extract(n, _VERSIONED, 1).alias("prefix"),
            F.regexp_extract(n, _VERSIONED, 2).alias("date_tag"),
            F.regexp_extract(n, _VERSIONED, 3).try_cast("int").alias("version"),
        ),
    )


def _dashed(date_tag: Column) -> Column:
    return F.concat_ws("-", F.substring(date_tag, 1, 4), F.substring(date_tag, 5, 2), F.substring(date_tag, 7, 2))


def version_label(name: Column | str) -> Column:
    """Label shown for a versioned, latest or other file name."""
    base = trim_all(F.regexp_replace(col(name), r"(?i)\.md$", ""))
    v = version_parse(base)
    stem = F.regexp_replace(base, "_latest$", "")
    spaced = lambda c: F.translate(c, "_", " ")
    prefix_label = lambda c: F.coalesce(lookup(K.VERSIONED_FILE_LABELS, c), spaced(c))
    return (
        F.when(
            v.isNotNull(),
            F.concat(
                prefix_label(v["prefix"]),
                F.lit(" "),
                _dashed(v["date_tag"]),
                F.lit(" v"),
                F.regexp_extract(base, _VERSIONED, 3),
            ),
        )
        .when(lookup(K.LATEST_FILE_LABELS, base).isNotNull(), lookup(K.LATEST_FILE_LABELS, base))
        .when(base.endswith("_latest"), F.concat(prefix_label(stem), F.lit(K.LATEST_SUFFIX_LABEL)))
        .otherwise(spaced(base))
    )


def summaries_version_label(name: Column | str) -> Column:
    v = version_parse(name)
    return F.when(v.isNull(), F.lit(K.CURRENT_VERSION_LABEL)).otherwise(
        F.concat(_dashed(v["date_tag"]), F.lit(" v"), v["version"].cast("string"))
    )


def beijing_minute(ts: Column | str) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), "Asia/Shanghai"), "yyyy/MM/dd HH:mm")


def failure_reason(log: Column | str) -> Column:
    """Text after the first failure mark, or the default message."""
    found = F.regexp_extract(col(log), K.FAILURE_MARK, 1)
    return F.coalesce(blank_to_null(found), F.lit(K.FAILURE_DEFAULT))


def line_count(log: Column | str) -> Column:
    content = F.coalesce(col(log), F.lit(""))
    return F.when(content == "", 0).otherwise(F.size(F.split(trim_all(content), "\n")))


def qa_counts_parse(text: Column | str) -> Column:
    """Counts of a QA report as ``struct(total, out_of_scope, in_scope)``; a line not there counts 0."""

    def number(label: str) -> Column:
        return F.coalesce(
            F.regexp_extract(col(text), rf"(?m)^-[ \t]*{label}:[ \t]*(\d+)", 1).try_cast("int"), F.lit(0)
        )

    total, out = number("total"), number("out_of_scope_candidates")
    return F.struct(
        total.alias("total"), out.alias("out_of_scope"), F.greatest(F.lit(0), total - out).alias("in_scope")
    )
