"""Column functions for journal records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.text import (
    SPACE,
    blank_to_null,
    capitalise_words,
    col,
    let,
    lookup,
    replace_all,
    squeeze,
    title_case,
    trim_all,
)


def issn_norm(c: Column | str, strict_x: bool = True) -> Column:
    """Key form of an ISSN. ``strict_x`` keeps an ``X`` check digit."""
    if strict_x:
        return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^0-9X]", "")
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9]", "")


def issn_key(c: Column | str, strict_x: bool = True) -> Column:
    """``issn_norm`` with the empty key as NULL, so that it never joins."""
    return F.nullif(issn_norm(c, strict_x), F.lit(""))


def issn_hyphen(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.length(c) == 8, F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 4))).otherwise(c)


def publisher_from_notes(c: Column | str) -> Column:
    parts = F.filter(F.transform(F.split(col(c), ";"), trim_all), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def has_jcr_flag(c: Column | str) -> Column:
    return F.coalesce(F.contains(F.upper(col(c)), F.lit("WOS/JCR")), F.lit(False))


def display_fallback(*cols: Column | str) -> Column:
    """First non-empty of display name, name, short, title."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def discipline_canonical(c: Column | str) -> Column:
    """Spelling variant to canonical name, case-insensitive; unknown names pass."""
    name = trim_all(c)
    canon = {d.lower(): d for d in K.CANONICAL_DISCIPLINES}
    table = {**canon, **{alias.lower(): to for alias, to in K.DISCIPLINE_ALIASES.items()}}
    return F.coalesce(lookup(table, F.lower(name)), name)


def strip_quartile_suffix(c: Column | str) -> Column:
    return discipline_canonical(F.regexp_replace(trim_all(c), K.QUARTILE_SUFFIX, ""))


def discipline_compare_key(c: Column | str) -> Column:
    return trim_all(
        replace_all(
            c,
            (f"(?i){SPACE}+and{SPACE}+", " "),
            (SPACE + "+", " "),
            (K.WOMEN_STUDIES, "$1Women Studies"),
        )
    )


def discipline_slug(c: Column | str, default: str = K.FALLBACK_DISCIPLINE_SLUG) -> Column:
    slug = replace_all(
        trim_all(c),
        (r"\s*[|,]\s*", "_"),
        (SPACE + "+", "_"),
        (r"[^a-zA-Z0-9_]", ""),
        (r"_+", "_"),
        (r"^_|_$", ""),
    )
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def slug_to_display(c: Column | str) -> Column:
    """List-file prefix or slug to a display name."""
    return trim_all(
        capitalise_words(replace_all(c, (K.LIST_PREFIX, ""), (K.LIST_SUFFIX, ""), (r"_", " ")))
    )


def topic_slug(c: Column | str, keep_hyphen: bool = False, default: str = K.FALLBACK_TOPIC_SLUG) -> Column:
    base = F.regexp_replace(F.lower(trim_all(c)), SPACE + "+", "_")
    if keep_hyphen:
        return F.regexp_replace(base, r"[^a-z0-9_-]", "")
    slug = F.translate(F.regexp_replace(base, r"[^a-z0-9_/-]", ""), "-", "_")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def name_norm(c: Column | str) -> Column:
    return squeeze(F.lower(col(c)))


def name_key(c: Column | str) -> Column:
    return F.nullif(name_norm(c), F.lit(""))


def quartile_clean(c: Column | str) -> Column:
    q = F.upper(trim_all(c))
    return F.when(q.isin("Q1", "Q2", "Q3", "Q4"), q)


def index_letter(c: Column | str) -> Column:
    """Letter A to Z that a text begins with, in capitals, else ``#``."""
    # capitals of several characters (ß, ŉ, ǰ, ligatures) are no letter of the index
    return let(
        F.upper(F.lower(F.substring(col(c), 1, 1))),
        lambda first: F.when(first.rlike(r"^[A-Z]\z"), first).otherwise("#"),
    )


def category_match_key(c: Column) -> Column:
    """Category in the form compared with a discipline: lower case, no quartile suffix."""
    return trim_all(F.regexp_replace(F.lower(trim_all(c)), K.QUARTILE_SUFFIX, ""))


def discipline_match_set(discipline: str) -> list[str]:
    """Lower-case spellings that count as the requested discipline."""
    wanted = discipline.strip().lower()
    by_lower = {name.lower(): aliases for name, aliases in K.DISCIPLINE_MATCHES.items()}
    return sorted({wanted, *(a.lower() for a in by_lower.get(wanted, []))})


__all__ = [
    "blank_to_null",
    "category_match_key",
    "discipline_canonical",
    "discipline_compare_key",
    "discipline_match_set",
    "discipline_slug",
    "display_fallback",
    "has_jcr_flag",
    "index_letter",
    "issn_hyphen",
    "issn_key",
    "issn_norm",
    "name_key",
    "name_norm",
    "publisher_from_notes",
    "quartile_clean",
    "slug_to_display",
    "strip_quartile_suffix",
    "title_case",
    "topic_slug",
]
