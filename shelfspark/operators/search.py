"""Boolean literature search and corpus cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.catalogue import name_norm
from shelfspark.functions.text import blank_to_null, col, squeeze
from shelfspark.operators.ranking import first_by_rank, packed_rank


def term_hit(term: str, mode: str = "relaxed", title="title", abstract="abstract", keywords="keywords") -> Column:
    """Strict: abstract and keywords hold the term. Relaxed: any of title, abstract, keywords."""
    has = lambda c: F.contains(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(term.strip().lower()))
    if mode == "strict":
        return has(abstract) & has(keywords)
    return has(title) | has(abstract) | has(keywords)


def search_condition(
    terms: Sequence[str], logic: Sequence[str] | None = None, mode: str = "relaxed", **columns: str
) -> Column:
    """Terms joined from left to right; ``logic[i]`` links term i and i+1.

    A logic list of the wrong length is dropped, and terms are then joined by OR.
    """
    terms = [t for t in terms if t.strip()]
    links = list(logic) if logic and len(logic) == len(terms) - 1 else ["or"] * (len(terms) - 1)
    cond = F.lit(True)
    for i, term in enumerate(terms):
        hit = term_hit(term, mode, **columns)
        cond = hit if i == 0 else (cond & hit if links[i - 1].lower() == "and" else cond | hit)
    return cond


def year_range(df: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    if year_from is not None:
        df = df.where(F.col("year") >= year_from)
    if year_to is not None:
        df = df.where(F.col("year") <= year_to)
    return df


def journal_scope(papers: DataFrame, journals: DataFrame, key: str = "source_id") -> DataFrame:
    """Papers of the chosen journals."""
    return papers.join(journals.select(key), key, "left_semi")


def literature_search(
    papers: DataFrame,
    terms: Sequence[str],
    logic: Sequence[str] | None = None,
    mode: str = "relaxed",
    year_from: int | None = None,
    year_to: int | None = None,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Year range and journal scope first, since they prune without reading text; then the terms."""
    df = year_range(papers, year_from, year_to)
    if scope is not None:
        df = journal_scope(df, scope)
    return df.where(search_condition(terms, logic, mode))


def paper_key(doi="doi", openalex="openalex", title="title", year="year") -> Column:
    """Identity of a paper: DOI, else OpenAlex id, else normalised title and year."""
    bare_doi = F.regexp_replace(F.lower(blank_to_null(doi)), r"^https?://(dx\.)?doi\.org/", "")
    return F.coalesce(
        F.concat(F.lit("doi:"), bare_doi),
        F.concat(F.lit("oa:"), blank_to_null(openalex)),
        # titles can be whole texts, so their digest is the key
        F.concat(F.lit("t:"), F.sha2(name_norm(title), 256), F.lit("|"), F.coalesce(col(year).cast("string"), F.lit(""))),
    )


def clean_corpus(raw: DataFrame, order: Sequence[str] = ("row_no",), by: Sequence[str] = ()) -> DataFrame:
    """Collapse white space and keep the first row of every paper.

    ``order`` names whole numbers from 0 that no two rows share. Only digests of the keys and row numbers are aggregated;
    texts are cleaned behind that, for the rows that stay.
    """
    text = {c: squeeze(c) for c in ("title", "journal", "authors", "doi", "openalex", "abstract") if c in raw.columns}
    of = lambda c: text.get(c, F.col(c))
    key = paper_key(of("doi"), of("openalex"), of("title"), of("year"))
    bits = min(62, 120 // max(len(order), 1))
    kept = first_by_rank(raw, [*by, key], packed_rank(*[(o, bits) for o in order]))
    return kept.select(*[text[c].alias(c) if c in text else F.col(c) for c in raw.columns])
