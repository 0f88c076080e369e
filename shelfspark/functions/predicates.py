"""Boolean column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.text import col, strip_links_basic, strip_links_strict, trim_all


def _see_reference(t: Column) -> Column:
    return reduce(lambda a, b: a | b, [t.rlike(p) for p in K.SEE_PATTERNS])


def abstract_missing_raw(c: Column | str) -> Column:
    """A raw-table abstract that is a placeholder, a pointer, or too short without its links."""
    t = trim_all(F.coalesce(col(c), F.lit("")))
    return (
        (t == "")
        | t.rlike(K.RAW_PLACEHOLDER)
        | _see_reference(t)
        | (F.length(strip_links_basic(t)) < K.RAW_MIN_CHARS)
    )


def abstract_missing_summary(c: Column | str) -> Column:
    """Stricter rule for the key-findings text of a structured summary."""
    t = trim_all(F.coalesce(col(c), F.lit("")))
    return (
        (t == "")
        | t.rlike(K.SUMMARY_PLACEHOLDER)
        | (F.length(t) < K.SUMMARY_MIN_CHARS)
        | _see_reference(t)
        | (F.length(strip_links_strict(t)) < K.SUMMARY_MIN_CORE_CHARS)
    )


def manual_flag(block: Column | str) -> Column:
    return F.contains(F.upper(col(block)), F.lit(K.MANUAL_MARK))


def drop_manual_mark(c: Column | str) -> Column:
    return trim_all(F.regexp_replace(col(c), K.MANUAL_TAIL, ""))


def topic_valid(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(K.TOPIC) & F.length(col(c)).between(1, 120), F.lit(False))


def term_non_english(c: Column | str) -> Column:
    return (trim_all(c) != "") & col(c).rlike(K.NON_ENGLISH)
