"""Papers, citations and corpus profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.citations import in_text_citation
from shelfspark.functions.predicates import abstract_missing_raw
from shelfspark.functions.text import blank_to_null, trim_all, unnest
from shelfspark.operators.ranking import distributed_row_number, first_per_key
from shelfspark.session import written


def citations(papers: DataFrame, topic: str = "topic") -> DataFrame:
    """In-text form of every paper with a year: ``(topic, id, in_text)``."""
    return papers.where(F.col("year").isNotNull() & (F.col("id") >= 1)).select(
        topic, "id", in_text_citation("authors", "year").alias("in_text")
    )


_YEAR = r", (?:\d{4}|\?)\z"
#: Characters before the year that make an anchor; a text has the anchor of the longest size that it fills.
ANCHORS = (1, 2, 3, 4, 6, 8, 10, 12, 16, 20)


def _anchor(text: Column, size: int) -> Column:
    """Size, last characters of the name and year of a text that ends with its year; null if the name is shorter."""
    year = F.regexp_extract(text, _YEAR, 0)
    name = F.left(text, F.length(text) - F.length(year))
    return F.when((year != "") & (F.length(name) >= size), F.concat(F.lit(f"{size}:"), F.right(name, F.lit(size)), year))


def _escape_pattern(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _escape_replacement(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def link_mentions(
    bodies: DataFrame,
    cites: DataFrame,
    doc: str = "doc",
    topic: str = "topic",
    body: str = "body",
) -> DataFrame:
    """Turn each known citation text of a body into ``[(text)](#paper-id)``, longest first.

    Bodies and citations meet in an equi join on (topic, anchor): the body is cut behind each ``, YYYY``, and every piece
    is probed with the few characters before its year, once for each size in :data:`ANCHORS` that a citation has. Whether the piece ends with the
    whole citation is verified behind the join, so a citation is also found inside a word. Only these short ends are
    shuffled; the links found are written, so a body moves only if they are too many to be sent to it. Of several papers with
    one text the first by ``pos`` gets the link.
    """
    first = first_per_key(
        cites.select(F.col(topic).alias("_t"), "id", "in_text", "pos", F.regexp_replace("in_text", r"^\((.*)\)$", "$1").alias("key")),
        ["_t", "in_text"],
        ["pos"],
    ).withColumn("anchor", F.coalesce(*[_anchor(F.col("key"), size) for size in reversed(ANCHORS)]))
    known = written(first.where(F.col("anchor").isNotNull()), "citations")
    used = known.select(F.substring_index("anchor", ":", 1).cast("int").alias("size")).distinct()
    sizes = sorted(r["size"] for r in used.collect()) or [ANCHORS[0]]  # one row a size
    longest = known.agg(F.coalesce(F.max(F.length("in_text")), F.lit(0))).scalar()
    with_max = bodies.select(F.col(doc), F.col(topic).alias("_t"), F.col(body)).withColumn("_max", longest)
    # each piece ends behind a year but the last, which has no anchor
    ends = F.array_distinct(F.transform(F.split(body, r"(?<=, (?:\d{4}|\?))"), lambda p: F.right(p, F.col("_max"))))
    dated = F.transform(ends, lambda e: F.struct(e.alias("end"), F.length(F.regexp_extract(e, _YEAR, 0)).alias("year")))

    def probes(e: Column) -> Column:
        fits = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: F.length(e["end"]) - e["year"] >= n)
        return F.transform(fits, lambda n: F.struct(F.concat(n.cast("string"), F.lit(":"), F.right(e["end"], n + e["year"])).alias("anchor"), e["end"].alias("end")))

    found = (
        unnest(with_max, [doc, "_t"], F.flatten(F.transform(F.filter(dated, lambda e: e["year"] > 0), probes)), "e")
        .select(doc, "_t", "e.*")
        .join(known, ["_t", "anchor"])
        .where(F.endswith("end", "key"))
        .groupBy(doc, "_t")
        .agg(F.array_sort(F.collect_set(F.struct((-F.length("in_text")).alias("l"), F.col("pos"), F.col("id"), F.col("in_text"), F.col("key")))).alias("_links"))
        .withColumnRenamed("_t", topic)
    )
    found = written(found, "links")

    def apply(acc: Column, link: Column) -> Column:
        target = F.concat(
            F.lit("$1"),
            _escape_replacement(F.concat(F.lit("["), link["in_text"], F.lit("](#paper-"), link["id"].cast("string"), F.lit(")"))),
        )
        with_parens = F.concat(F.lit(r"(^|[^\[])("), _escape_pattern(link["in_text"]), F.lit(")"))
        without = F.concat(F.lit(r"(^|[^\[（(])("), _escape_pattern(link["key"]), F.lit(")"))
        return F.regexp_replace(F.regexp_replace(acc, with_parens, target), without, target)

    linked = F.aggregate("_links", F.col(body), apply)
    return (
        bodies.join(found, [doc, topic], "left")
        .withColumn(body, F.when(F.col("_links").isNotNull(), linked).otherwise(F.col(body)))
        .withColumn("n_links", F.when(F.col("_links").isNotNull(), F.size("_links")).otherwise(0))
        .drop("_links")
    )


def paper_lookup(papers: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("topic", "id")) -> DataFrame:
    """Papers whose (topic, id) was requested."""
    return papers.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def fill_from_fallback(papers: DataFrame, pages: DataFrame, missing: Column, key: str | Sequence[str] = "url") -> DataFrame:
    """Fill missing abstracts with the text of the page of the same key; of several keys (URL, DOI) the first that has text.

    Only papers that lack an abstract carry a key into the join, so the text of the
    others is never matched; their missing keys are spread.
    """
    keys = [key] if isinstance(key, str) else list(key)
    df = papers.withColumn("filled", F.lit(False)).withColumn("_wanted", F.coalesce(missing, F.lit(False)))
    for k in keys:
        text = pages.where(F.col(k).isNotNull()).groupBy(k).agg(F.max("page_text").alias("_text")).withColumnRenamed(k, "_key")
        wanted = F.col("_wanted") & ~F.col("filled")
        salt = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("id"), F.lit(1024)).cast("string"))
        joined = df.withColumn("_key", F.coalesce(F.when(wanted, F.col(k)), salt)).join(text, "_key", "left")
        found = wanted & blank_to_null("_text").isNotNull()
        df = joined.select(
            *[F.col(c) for c in papers.columns if c != "abstract"],
            F.when(found, blank_to_null("_text")).otherwise(F.col("abstract")).alias("abstract"),
            (F.col("filled") | found).alias("filled"),
            "_wanted",
        )
    return df.drop("_wanted")


def merge_section_titles(rows: DataFrame, sections: DataFrame, doc: str = "doc") -> DataFrame:
    """Theme cells of numbered overview rows become ``section title（theme）``.

    ``rows`` is ``(doc, number, theme)``; row n belongs to section n.
    """
    titles = sections.where(F.col("pos") > 0).select(doc, F.col("pos").alias("number"), F.col("title").alias("_title"))
    merged = F.when(
        F.col("_title").isNotNull() & (F.col("theme") != ""),
        F.concat("_title", F.lit("（"), "theme", F.lit("）")),
    ).otherwise(F.col("theme"))
    return rows.join(titles, [doc, "number"], "left").withColumn("theme", merged).drop("_title")


def positional_join(rows: DataFrame, sections: DataFrame, doc: str = "doc") -> DataFrame:
    """Table row n with section n of the same document."""
    return rows.join(
        sections.where(F.col("pos") > 0).select(doc, F.col("pos").alias("number"), "title", "body"), [doc, "number"]
    )


# --- counts and profiles ----------------------------------------------------------


def raw_paper_stats(papers: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    return papers.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(abstract_missing_raw("abstract")).alias("missing_abstract")
    )


def audit_partition(audit: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Total, missing and filled papers; the rows themselves stay in ``audit`` under the ``missing`` flag."""
    return audit.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("missing").alias("n_missing"),
        F.count_if(~F.col("missing")).alias("n_filled"),
        F.count_if("is_manual").alias("n_manual"),
    )


def corpus_profile(papers: DataFrame, by: Sequence[str] = ("topic",), top: int = 3) -> DataFrame:
    """Paper count, year span and leading journals.

    One pass over the papers counts them per journal; the windows then see one row
    per journal of a topic.
    """
    counts = papers.groupBy(*by, "journal").agg(
        F.count("*").alias("n"), F.min("year").alias("y0"), F.max("year").alias("y1")
    )
    topic = Window.partitionBy(*by)
    ranked = counts.select(
        *by,
        "journal",
        F.row_number().over(topic.orderBy(F.desc("n"), "journal")).alias("r"),
        F.sum("n").over(topic).alias("papers"),
        F.min("y0").over(topic).alias("year_from"),
        F.max("y1").over(topic).alias("year_to"),
    ).where(F.col("r") <= top)
    names = F.transform(F.array_sort(F.collect_list(F.struct("r", "journal"))), lambda s: s["journal"])
    return ranked.groupBy(*by).agg(
        F.first("papers").alias("papers"),
        F.first("year_from").alias("year_from"),
        F.first("year_to").alias("year_to"),
        F.array_join(names, "、").alias("leading"),
    )


def cluster_share(assignments: DataFrame, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """Papers per cluster and percent of all, one decimal."""
    counts = assignments.groupBy(*by, cluster).agg(F.count("*").alias("n"))
    # the window runs over one row per cluster
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 1))


def facet_frequency(papers: DataFrame, column: str, top: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """How many papers name each value of a ``;`` separated field."""
    values = F.array_distinct(F.filter(F.transform(F.split(column, ";"), trim_all), lambda v: v != ""))
    counts = unnest(papers, by, values, "value").groupBy(*by, "value").agg(F.count("*").alias("n"))
    if top is None:
        return counts
    if not by:
        return counts.orderBy(F.desc("n"), "value").limit(top)
    rank = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    return counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top).drop("_r")


def qa_scope_counts(flags: DataFrame, by: Sequence[str] = (), flag: str = "out_of_scope") -> DataFrame:
    """Total, out-of-scope and in-scope papers, and whether the exclusion gate opens."""
    c = flags.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(flag).alias("out_of_scope"))
    return c.withColumn("in_scope", F.greatest(F.lit(0), F.col("total") - F.col("out_of_scope"))).withColumn(
        "gate", (F.col("total") >= K.QA_GATE_TOTAL) & (F.col("out_of_scope") > 0)
    )


def papers_per_cluster_batches(
    assignments: DataFrame,
    size: int = K.BATCH_DEFAULT,
    cluster: str = "cluster",
    order: Sequence[str] = ("id",),
) -> DataFrame:
    """Batches of at most ``size`` papers per cluster; a hot cluster is ranked by many tasks."""
    size = min(max(size, K.BATCH_MIN), K.BATCH_MAX)
    ranked = distributed_row_number(assignments, [F.col(o).asc() for o in order], [cluster], "_rn")
    return ranked.withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("int")).drop("_rn")


def sort_citations_longest(cites: DataFrame, name: str = "rank") -> DataFrame:
    return distributed_row_number(
        cites, [F.length("in_text").desc(), F.col("pos").asc(), F.col("id").asc()], name=name
    )

