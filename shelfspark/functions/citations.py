"""Authors, in-text citations and reference strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.text import SPACE, col, let, trim_all


def _words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def surnames(authors: Column | str) -> Column:
    """Author string to a list of surnames.

    With separators each segment gives its last word. Without any, the words
    are read as names of two words; three words are one name, and an odd count
    ends with a name of three words.
    """
    raw = trim_all(F.coalesce(col(authors), F.lit("")))
    segments = F.filter(
        F.transform(
            F.split(raw, K.AUTHOR_SEPARATOR),
            lambda s: trim_all(F.regexp_replace(s, K.ET_AL, " ")),
        ),
        lambda s: s != "",
    )

    def from_words(words: Column) -> Column:
        n = F.size(words)
        pairs = F.filter(words, lambda w, i: (i % 2 == 1) & (i < n - 3))
        return (
            F.when(n == 0, words)
            .when(n <= 3, F.slice(words, -1, 1))
            .when(n % 2 == 0, F.filter(words, lambda w, i: i % 2 == 1))
            .otherwise(F.concat(pairs, F.slice(words, -1, 1)))
        )

    return let(
        segments,
        lambda segs: F.when(
            F.size(segs) > 1,
            F.transform(segs, lambda s: F.coalesce(F.try_element_at(_words(s), F.lit(-1)), s)),
        ).otherwise(let(_words(raw), from_words)),
    )


def in_text_citation(authors: Column | str, year: Column | str) -> Column:
    y = F.coalesce(col(year).cast("string"), F.lit("?"))

    def build(names: Column) -> Column:
        n, first = F.size(names), F.element_at(names, 1)
        return (
            F.when(n == 0, F.concat(F.lit("(Unknown, "), y, F.lit(")")))
            .when(n == 1, F.concat(F.lit("("), first, F.lit(", "), y, F.lit(")")))
            .when(n == 2, F.concat(F.lit("("), first, F.lit(" & "), F.element_at(names, 2), F.lit(", "), y, F.lit(")")))
            .otherwise(F.concat(F.lit("("), first, F.lit(" et al., "), y, F.lit(")")))
        )

    return let(surnames(authors), build)


def ref_url(doi: Column | str, openalex: Column | str) -> Column:
    d, o = trim_all(F.coalesce(col(doi), F.lit(""))), trim_all(F.coalesce(col(openalex), F.lit("")))
    return F.when(d.startswith("http"), d).when(d != "", F.concat(F.lit("https://doi.org/"), d)).otherwise(o)


def _parts(p: dict[str, Column]) -> dict[str, Column]:
    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.nullif(trim_all(p[name]), F.lit("")), F.lit(default))

    url = ref_url(p["doi"], p["openalex"])
    return {
        "authors": text("authors", "Unknown"),
        "year": F.coalesce(p["year"].cast("string"), F.lit("n.d.")),
        "title": text("title", K.NO_TITLE),
        "journal": text("journal"),
        "tail": F.when(url != "", F.concat(F.lit(" "), url)).otherwise(""),
    }


def _fields(**names: Column | str) -> dict[str, Column]:
    keys = ("authors", "year", "title", "journal", "doi", "openalex")
    return _parts({k: col(names.get(k, k)) for k in keys})


def ref_apa(**names: Column | str) -> Column:
    p = _fields(**names)
    journal = F.when(p["journal"] != "", F.format_string(" *%s*.", p["journal"])).otherwise("")
    return F.concat(p["authors"], F.lit(" ("), p["year"], F.lit("). "), p["title"], F.lit("."), journal, p["tail"])


def ref_chicago(**names: Column | str) -> Column:
    p = _fields(**names)
    journal = F.when(p["journal"] != "", F.format_string(". *%s*", p["journal"])).otherwise("")
    return F.concat(
        p["authors"], F.lit('. "'), p["title"], F.lit('"'), journal, F.lit(" ("), p["year"], F.lit(")."), p["tail"]
    )


def _surname_first(name: Column) -> Column:
    def flip(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 2, name).otherwise(
            F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, 1, n - 1), " "))
        )

    return let(_words(name), flip)


def sociological_authors(authors: Column) -> Column:
    """First author surname first, the others as written, ``&`` before the last."""
    no_blank = lambda c: F.filter(F.transform(c, trim_all), lambda s: s != "")

    def assemble(blocks: Column) -> Column:
        first_block = F.coalesce(F.try_element_at(blocks, F.lit(1)), F.lit(""))

        def people(tokens: Column) -> Column:
            n = F.size(tokens)
            head = F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit(""))
            spaced = F.contains(head, F.lit(" "))
            surname_given = (n >= 2) & ~spaced
            first = (
                F.when(surname_given, F.concat(head, F.lit(", "), F.try_element_at(tokens, F.lit(2))))
                .when(spaced, _surname_first(head))
                .otherwise(head)
            )
            rest = F.when(surname_given, F.slice(tokens, 3, F.greatest(n, F.lit(1)))).otherwise(
                F.slice(tokens, 2, F.greatest(n, F.lit(1)))
            )
            last = F.when(F.size(blocks) > 1, F.array(F.element_at(blocks, -1))).otherwise(
                F.array().cast("array<string>")
            )
            return F.concat(F.array(first), rest, last)

        return let(
            let(no_blank(F.split(first_block, r"\s*,\s*")), people),
            lambda all_: F.when(
                F.size(all_) == 1,
                F.coalesce(F.nullif(F.element_at(all_, 1), F.lit("")), authors),
            ).otherwise(
                F.concat(
                    F.array_join(F.slice(all_, 1, F.size(all_) - 1), ", "), F.lit(" & "), F.element_at(all_, -1)
                )
            ),
        )

    return let(no_blank(F.split(authors, r"\s*&\s*")), assemble)


def ref_sociological(**names: Column | str) -> Column:
    p = _fields(**names)
    latin = p["authors"].rlike("[a-zA-Z]") & p["authors"].rlike(K.LATIN_AUTHORS)
    western = F.concat(
        sociological_authors(p["authors"]),
        F.lit(". "),
        p["year"],
        F.lit('. "'),
        p["title"],
        F.lit('".'),
        F.when(p["journal"] != "", F.format_string(" *%s*.", p["journal"])).otherwise("."),
        p["tail"],
    )
    cjk = F.concat(
        p["authors"],
        F.lit("，"),
        p["year"],
        F.lit("，《"),
        p["title"],
        F.lit("》"),
        F.when(p["journal"] != "", F.concat(F.lit("，《"), p["journal"], F.lit("》"))).otherwise(""),
        F.lit("。"),
        p["tail"],
    )
    return F.when(latin, western).otherwise(cjk)
