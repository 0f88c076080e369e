"""Report flow: summaries to papers, citations, links and sections, for all topics at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import md_display_clean
from shelfspark.operators import markdown as md
from shelfspark.operators import papers as pp
from shelfspark.session import written


def linked_report_sections(summaries: DataFrame, reports: DataFrame) -> DataFrame:
    """Sections of every report with its citations linked.

    ``summaries`` is ``(topic, body)``, ``reports`` is ``(doc, topic, body)``.
    """
    papers = md.explode_paper_blocks(summaries, "topic")
    # used twice below; the citation table is tiny beside the summaries it is parsed from
    cites = written(pp.citations(papers).withColumn("pos", F.col("id")), "citations")
    clean = reports.withColumn("body", md_display_clean(md.drop_md_column("body")))
    linked = pp.link_mentions(clean, cites)
    return md.sections_nonempty(md.explode_report_sections(linked))
