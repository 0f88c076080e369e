"""Column helpers for Unicode text: trimming, link removal, Markdown to plain text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import constants as K

SPACE = K.SPACE
_SPACE_CHARS = " \t\n\x0b\f\r" + "".join(
    map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, keep: Sequence[str], items: Column, value: str, pos: str = "_pos") -> DataFrame:
    """One row per array item with its position, for arrays that are costly to build.

    An inner ``explode`` makes the optimizer filter on the size of the array first,
    which builds it twice. The outer form does not; its row for an empty array is
    dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, value)).where(F.col(pos).isNotNull())
    return rows.drop(pos) if pos == "_pos" else rows


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of a small constant map, NULL when the key is absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def trim_all(c: Column | str) -> Column:
    """Trim every Unicode space from both ends (no regex)."""
    return F.trim(col(c), F.lit(_SPACE_CHARS))


def squeeze(c: Column | str) -> Column:
    """Collapse runs of Unicode space to one blank, then trim."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def replace_all(c: Column | str, *steps: tuple[str, str]) -> Column:
    out = col(c)
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return out


def _upper_first(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return F.when(first.between("a", "z"), F.concat(F.upper(first), F.substring(word, 2, 2**30))).otherwise(word)


def title_case(c: Column | str) -> Column:
    """Lower-case, then upper-case the first ASCII letter of each ASCII word."""
    # a piece ends behind every character that cannot be part of an ASCII word
    return F.array_join(F.transform(F.split(F.lower(col(c)), r"(?<=[^a-z0-9_])"), _upper_first), "")


def capitalise_words(c: Column | str) -> Column:
    """Upper-case the first ASCII letter of each ASCII word, leave the rest as it is."""
    return F.array_join(F.transform(F.split(col(c), r"(?<=[^A-Za-z0-9_])"), _upper_first), "")


def strip_links_basic(c: Column | str) -> Column:
    """Keep link texts, drop URLs and DOIs."""
    return squeeze(
        replace_all(
            squeeze(c),
            (K.LINK_ANY, "$1"),
            (K.URL, " "),
            (K.DOI, " "),
        )
    )


def strip_links_strict(c: Column | str) -> Column:
    """Drop URLs, DOIs, ``doi: x`` style pairs and ISSN/ISBN/PMID tokens."""
    return squeeze(
        replace_all(
            c,
            (K.URL, " "),
            (K.DOI, " "),
            (K.ID_PAIR, " "),
            (K.ID_TOKEN, " "),
        )
    )


_EMPHASIS = (K.EMPHASIS, "$1")
_CODE = (K.INLINE_CODE, "$1")


def md_cell_plain(c: Column | str) -> Column:
    """Table cell to plain text: links become ``text (url)``, marks go away."""
    one_line = trim_all(F.regexp_replace(col(c), r"\r?\n", " "))
    return replace_all(
        one_line,
        (K.LINK_NO_TEXT, "$1 ($1)"),
        (K.LINK_FULL, "$1 ($2)"),
        _EMPHASIS,
        _CODE,
    )


def md_paragraph_plain(c: Column | str) -> Column:
    """Paragraph to plain text: no heading marks, bullets as a dot."""
    return trim_all(
        replace_all(
            c,
            (K.HEADING_MARK, ""),
            (K.LINK_FULL, "$1 ($2)"),
            _EMPHASIS,
            _CODE,
            (K.BULLET_MARK, "• "),
        )
    )


def unwrap_leading_fence(c: Column | str) -> Column:
    """Content of a code fence that opens the text, followed by what comes after it."""

    def unwrap(raw: Column, parts: Column) -> Column:
        inner, after = trim_all(F.element_at(parts, 1)), trim_all(F.element_at(parts, 2))
        return (
            F.when(F.size(parts) < 2, raw)
            .when(after != "", F.concat(inner, F.lit("\n\n"), after))
            .when(inner != "", inner)
            .otherwise(raw)
        )

    raw = col(c)
    text = trim_all(raw)
    newline = F.instr(text, "\n")
    rest = F.when(newline > 0, F.substring(text, newline + F.lit(1), F.length(text))).otherwise("")
    return F.when(text.startswith("```"), let(F.split(rest, "```", 2), lambda p: unwrap(raw, p))).otherwise(raw)


def md_display_clean(c: Column | str) -> Column:
    """Text as shown to a reader."""
    out = unwrap_leading_fence(c)
    for hint in K.HEADING_HINTS:
        out = F.replace(out, F.lit(hint), F.lit(""))
    return replace_all(
        out,
        (K.HEADING_HINT_PATTERN, ""),
        (K.NUMBER_AFTER_PAREN, "）\n\n$1、"),
        (K.NUMBER_AFTER_BREAK, "$1\n\n$2、"),
        (K.PARENS_ROUND_LINK, "$1"),
    )


def summary_fence(c: Column | str) -> Column:
    """First fenced block as ``struct(summary, before, after)``; NULL without one."""

    def cut(parts: Column) -> Column:
        body = F.element_at(parts, 2)
        newline = F.instr(body, "\n")
        # without a line break after the opening mark the fence text itself is the block
        block = F.when(newline > 0, F.substring(body, newline + F.lit(1), F.length(body))).otherwise(body)
        return F.when(
            F.size(parts) == 3,
            F.struct(
                trim_all(block).alias("summary"),
                trim_all(F.element_at(parts, 1)).alias("before"),
                trim_all(F.element_at(parts, 3)).alias("after"),
            ),
        )

    return let(F.split(col(c), "```", 3), cut)
