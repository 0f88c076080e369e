"""Catalogue flows: the faceted journal query, and the journal list of disciplines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import catalogue as fc
from shelfspark.operators import catalogue as cat


def journal_catalogue(
    journals: DataFrame,
    index: DataFrame,
    registry: DataFrame | None = None,
    discipline: str | None = None,
    quartile: str | None = None,
    publisher: str | None = None,
    metrics: DataFrame | None = None,
) -> DataFrame:
    """Journals with metrics, filtered by discipline, quartile and publisher.

    Publisher and (without a registry) discipline only look at journal columns, so
    they run before the lookups and fewer rows are joined. With ``metrics`` (rows of
    the metric files) a discipline without any journal takes the rows of its file.
    """
    df = cat.filter_publisher(journals, publisher)
    if registry is not None:
        df = cat.category_override(df, registry)
    if discipline:
        df = cat.filter_discipline(df, discipline)
        if metrics is not None:
            df = cat.source_fallback(df, metric_journals(metrics, discipline, df))
    return cat.filter_quartile(cat.enrich_two_key(df, index), quartile)


def metric_journals(metrics: DataFrame, discipline: str, like: DataFrame) -> DataFrame:
    """Journals named in the metric file of a discipline, with the columns of ``like``; what a file lacks is NULL."""
    own = metrics.where(F.lower(fc.discipline_compare_key("file_discipline")) == F.lower(fc.discipline_compare_key(F.lit(discipline))))
    known = {
        "title": F.col("journal_name"),
        "issn": F.col("issn_print"),
        "eissn": F.col("issn_e"),
        "publisher": F.col("publisher"),
        "categories": F.array("file_discipline"),
    }
    columns = [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema]
    return own.select(*columns).distinct()


def journals_of_disciplines(entries: DataFrame, registry: DataFrame, index: DataFrame, requested: Sequence[str]) -> DataFrame:
    """List entries of the requested disciplines, resolved, without repeats, with metrics laid over.

    ``entries`` carries ``entry_id, disc_pos, row_pos`` and the list fields.
    """
    resolved = cat.resolve_record(entries, registry)
    rec = F.col("resolved")
    use = lambda c: F.when(rec.isNotNull(), rec[c]).otherwise(F.col(c))
    rows = resolved.select(
        "entry_id",
        "disc_pos",
        "row_pos",
        use("name").alias("name"),
        use("issn").alias("issn"),
        use("eissn").alias("eissn"),
        F.coalesce(rec["openalex_source_id"], F.lit("")).alias("openalex_source_id"),
        rec["source_categories"].alias("categories"),
    )
    unique = cat.dedupe_catalogue(rows, ["disc_pos", "row_pos"])
    return cat.overlay_nonnull(unique, index, requested)
