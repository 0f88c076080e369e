"""Markdown documents to rows and back.

A document is one row. Its lines, tables and blocks are built inside that row
with array functions, so parsing needs no shuffle; only the final ``explode``
changes the row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import constants as K
from shelfspark.functions.predicates import abstract_missing_summary, drop_manual_mark, manual_flag
from shelfspark.functions.text import (
    blank_to_null,
    col,
    let,
    md_cell_plain,
    md_paragraph_plain,
    trim_all,
    unnest,
)


def strip_bom(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\x{FEFF}", "")


def md_lines(body: Column | str) -> Column:
    return F.split(col(body), r"\r?\n")


def table_cells(line: Column) -> Column:
    """Cells of one pipe-table line, trimmed, without the outer empties."""

    def inner(parts: Column) -> Column:
        return F.when((F.element_at(parts, 1) == "") & (F.size(parts) > 1), F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(parts)

    return let(F.transform(F.split(line, r"\|"), trim_all), inner)


def render_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def md_segments(body: Column | str) -> Column:
    """Runs of table lines and other lines: ``array<struct<is_table, start, lines>>``."""

    def runs(lines: Column) -> Column:
        flags = F.transform(lines, lambda s: trim_all(s).startswith("|"))

        def with_flags(fl: Column) -> Column:
            n = F.size(fl)
            starts = F.filter(
                F.sequence(F.lit(0), n - 1),
                lambda i: (i == 0) | (F.get(fl, i) != F.get(fl, F.greatest(i - 1, F.lit(0)))),
            )
            return let(
                starts,
                lambda st: F.transform(
                    st,
                    lambda s, k: F.struct(
                        F.get(fl, s).alias("is_table"),
                        s.alias("start"),
                        F.slice(lines, s + 1, F.coalesce(F.get(st, k + 1), n) - s).alias("lines"),
                    ),
                ),
            )

        return let(flags, with_flags)

    return let(md_lines(body), runs)


def _is_rule(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.rlike(r"^[-:]+$"))


def explode_md_tables(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """One row per table row: ``doc, table_no, row_no, cells``; the rule row is dropped, row 0 is the header."""
    tables = F.filter(md_segments(body), lambda s: s["is_table"] & (F.size(s["lines"]) >= 2))
    rows = lambda t: F.transform(t["lines"], table_cells)
    kept = F.filter(
        F.transform(rows(F.col("t")), lambda c, i: F.struct(i.alias("i"), c.alias("cells"))),
        lambda r: ~((r["i"] == 1) & _is_rule(r["cells"])),
    )
    found = unnest(docs, [doc], tables, "t", "table_no")
    return unnest(found, [doc, "table_no"], kept, "r", "row_no").select(
        doc, "table_no", "row_no", F.col("r.cells").alias("cells")
    )


def explode_raw_papers(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Rows of the raw paper table: journal, year, title, [authors], doi, openalex, abstract.

    All pipe lines of a document form one table. An abstract that holds `` | ``
    is joined again; a row with too few cells is skipped.
    """

    def data_rows(lines: Column) -> Column:
        core = lambda s: F.regexp_replace(trim_all(s), r"^\||\|$", "")
        header = F.transform(F.split(core(F.get(lines, F.lit(0))), r" \| "), lambda h: F.lower(trim_all(h)))
        has_authors = F.exists(header, lambda h: F.contains(h, F.lit("author")) | (h == "作者"))
        return F.when(
            F.size(lines) >= 3,
            let(
                F.when(has_authors, 6).otherwise(5),
                lambda at: F.filter(
                    F.transform(
                        F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))),
                        lambda s: F.struct(at.alias("abstract_at"), F.split(core(s), r" \| ").alias("cells")),
                    ),
                    lambda r: F.size(r["cells"]) > r["abstract_at"],
                ),
            ),
        )

    lines = F.filter(md_lines(strip_bom(body)), lambda s: trim_all(s).startswith("|"))
    cell = lambda i: trim_all(F.get(F.col("r.cells"), F.lit(i) if isinstance(i, int) else i))
    at = F.col("r.abstract_at")
    return unnest(docs, [doc], let(lines, data_rows), "r", "row_no").select(
        doc,
        "row_no",
        cell(0).alias("journal"),
        cell(1).try_cast("int").alias("year"),
        cell(2).alias("title"),
        F.when(at == 6, cell(3)).alias("authors"),
        cell(at - 2).alias("doi"),
        cell(at - 1).alias("openalex"),
        trim_all(
            F.array_join(F.slice("r.cells", at + 1, F.greatest(F.size("r.cells") - at, F.lit(0))), " | ")
        ).alias("abstract"),
    )


# --- paper blocks ----------------------------------------------------------------

BLOCK_SEPARATOR = r"\r?\n---\s*\n"
_NUMBER = r"(?m)^##[ \t]+(\d+)\."
_HEADING = r"(?m)^##[ \t]+(\d+)\.[ \t]+(.*?)[ \t]*\((\d{4}|NA)\)[ \t]*$"
_FIELD_END = r"(?=\r?\n\*\*|\r?\n---|\z)"


def _bullet(block: Column, label: str) -> Column:
    return blank_to_null(F.regexp_extract(block, rf"(?m)^-[ \t]*{label}:[ \t]*(.*)$", 1))


def _section(block: Column, label: str) -> Column:
    """Text of a ``**Label**:`` field up to the next field; an empty field stays empty."""
    return blank_to_null(F.regexp_extract(block, rf"(?s)\*\*{label}\*\*:[ \t]*(.*?){_FIELD_END}", 1))


def paper_fields(block: Column) -> dict[str, Column]:
    heading = lambda i: F.regexp_extract(block, _HEADING, i)
    return {
        "id": F.regexp_extract(block, _NUMBER, 1).try_cast("int"),
        "title": blank_to_null(heading(2)),
        "year": heading(3).try_cast("int"),
        "journal": _bullet(block, "Journal"),
        "doi": _bullet(block, "DOI"),
        "openalex": _bullet(block, "OpenAlex"),
        "authors": F.coalesce(_bullet(block, r"Author\(s\)"), _bullet(block, "Authors?")),
        "abstract": _section(block, "Abstract"),
        "rq": _section(block, "Research question"),
        "data": _section(block, "Data / material"),
        "method": _section(block, "Method"),
        "findings": _section(block, r"Key findings[^*\n]*"),
        "contribution": _section(block, "Contribution"),
    }


def document_blocks(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """All blocks of documents as ``(doc, pos, block, separator)``; :func:`join_blocks` gives the same text again.

    The separator is the one that follows the block, empty behind the last.
    """
    text = F.col(body)
    ends = F.regexp_extract_all(text, F.lit(f"({BLOCK_SEPARATOR})"), F.lit(1))
    parts = F.zip_with(F.split(text, BLOCK_SEPARATOR), ends, lambda b, s: F.struct(b.alias("block"), F.coalesce(s, F.lit("")).alias("separator")))
    rows = unnest(docs, [doc], parts, "part", "pos")
    return rows.select(doc, "pos", "part.block", "part.separator")


def paper_blocks(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Blocks of summary documents that carry a paper number, also behind other lines of the block."""
    blocks = F.split(strip_bom(body), BLOCK_SEPARATOR)
    return unnest(docs, [doc], blocks, "block", "pos").where(F.col("block").rlike(_NUMBER))


def explode_paper_blocks(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Summary documents to one row per numbered paper."""
    return paper_blocks(docs, doc, body).select(
        doc, *[c.alias(n) for n, c in paper_fields(F.col("block")).items()]
    )


def audit_blocks(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Abstract audit of summary documents: key findings, manual mark and missing flag per paper."""
    findings = drop_manual_mark(F.coalesce(F.col("raw_findings"), F.lit("")))
    fields = paper_fields(F.col("block"))
    keep = ["id", "title", "year", "authors", "doi", "openalex"]
    return (
        paper_blocks(docs, doc, body)
        .select(
            doc,
            *[fields[k].alias(k) for k in keep],
            fields["findings"].alias("raw_findings"),
            manual_flag("block").alias("is_manual"),
        )
        .withColumn("key_findings", findings)
        .drop("raw_findings")
        .withColumn("missing", abstract_missing_summary("key_findings"))
    )


def render_paper_block(
    id: Column, title: Column, year: Column, fields: dict[str, Column], bullets: dict[str, Column]
) -> Column:
    """Markdown block of one paper; the inverse of :func:`paper_fields`."""
    head = F.concat(F.lit("## "), id.cast("string"), F.lit(". "), title, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("NA")), F.lit(")"))
    lines = [F.concat(F.lit(f"- {k}: "), F.coalesce(v, F.lit(""))) for k, v in bullets.items()]
    body = [F.concat(F.lit(f"**{k}**: "), F.coalesce(v, F.lit(""))) for k, v in fields.items()]
    return F.concat(head, F.lit("\n\n"), F.concat_ws("\n", *lines), F.lit("\n\n"), F.concat_ws("\n\n", *body), F.lit("\n"))


def patch_blocks(blocks: DataFrame, patches: DataFrame, doc: str = "doc") -> DataFrame:
    """Replace the key findings of patched papers and mark them as manual.

    ``blocks`` is ``(doc, pos, block)`` with or without ``separator``, ``patches`` is
    ``(doc, idx, abstract, seq)``; the last patch of an index wins. Blocks without a
    patch or a number are unchanged. Rows stay one per block, so no document has to be
    assembled in one task.
    """
    last = (
        patches.groupBy(doc, F.col("idx").alias("_idx"))
        .agg(F.max_by("abstract", "seq").alias("_patch"))
    )
    idx = F.regexp_extract("block", _NUMBER, 1).try_cast("int")
    # anchored at the start, so only the first field of a block is replaced
    pattern = rf"(?is)\A(.*?\*\*Key findings \(from abstract\)\*\*:\s*)(.*?){_FIELD_END}"
    escaped = F.regexp_replace(trim_all("_patch"), r"([\\$])", r"\\$1")
    replacement = F.concat(F.lit("$1"), escaped, F.lit(" " + K.MANUAL_MARK + "\n\n"))
    patched = F.regexp_replace(F.col("block"), F.lit(pattern), replacement)
    return (
        blocks.withColumn("_idx", idx)
        .join(last, [doc, "_idx"], "left")
        .withColumn("block", F.when(F.col("_patch").isNotNull(), patched).otherwise(F.col("block")))
        .drop("_idx", "_patch")
    )


def join_blocks(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """Blocks back to one document per key. Use only where a document fits one row, as its source did.

    With a ``separator`` column each block is followed by its own, else blocks are set apart in one way.
    """
    if "separator" in blocks.columns:
        ordered = F.array_sort(F.collect_list(F.struct("pos", F.concat("block", "separator").alias("block"))))
        between = ""
    else:
        ordered = F.array_sort(F.collect_list(F.struct("pos", "block")))
        between = "\n---\n\n"
    return blocks.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda b: b["block"]), between).alias("body"))


# --- reports ---------------------------------------------------------------------

_SECTION_SPLIT = rf"\n(?=##\s+[{K.SECTION_NUMERALS}]+、)"
_SUB_SPLIT = rf"\n(?=\*\*（[{K.SECTION_NUMERALS}]+）)"


def _first_line(part: Column) -> Column:
    return F.substring_index(part, "\n", 1)


def _after_first_line(part: Column) -> Column:
    at = F.instr(part, "\n")
    return F.when(at > 0, trim_all(F.substring(part, at + F.lit(1), F.length(part)))).otherwise("")


def explode_report_sections(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Reports to ``(doc, pos, title, body)``; the text before the first heading is position 0."""
    line = _first_line(F.col("part"))
    title = F.when(
        F.col("pos") > 0,
        F.coalesce(
            F.nullif(F.regexp_replace(F.regexp_extract(line, rf"^##\s+([{K.SECTION_NUMERALS}]+、.+)$", 1), r"、\s+", "、"), F.lit("")),
            trim_all(F.regexp_replace(line, r"^##\s+", "")),
        ),
    ).otherwise("")
    return unnest(docs, [doc], F.split(trim_all(body), _SECTION_SPLIT), "part", "pos").select(
        doc,
        "pos",
        trim_all(title).alias("title"),
        F.when(F.col("pos") == 0, trim_all("part")).otherwise(_after_first_line(F.col("part"))).alias("body"),
    )


def explode_subsections(sections: DataFrame, keys: tuple[str, ...] = ("doc", "pos"), body: str = "body") -> DataFrame:
    parts = F.filter(F.split(trim_all(body), _SUB_SPLIT), lambda p: trim_all(p) != "")
    return unnest(sections, keys, parts, "part", "sub_pos").select(
        *keys,
        "sub_pos",
        trim_all(F.replace(_first_line(F.col("part")), F.lit("**"), F.lit(""))).alias("sub_title"),
        _after_first_line(F.col("part")).alias("sub_body"),
    )


def sections_nonempty(sections: DataFrame, body: str = "body") -> DataFrame:
    return sections.where(trim_all(body) != "")


def drop_md_column(body: Column | str, pattern: str = "(?i)openalex") -> Column:
    """Document text without the first table column whose header matches ``pattern``."""

    def cut(seg: Column) -> Column:
        header = table_cells(F.get(seg["lines"], F.lit(0)))
        hit = lambda cells: F.filter(
            F.transform(cells, lambda c, i: F.when(c.rlike(pattern), i)), lambda i: i.isNotNull()
        )

        def rows(at: Column) -> Column:
            def row(line: Column) -> Column:
                return let(
                    table_cells(line),
                    lambda cells: F.when(
                        F.size(cells) > at, render_row(F.filter(cells, lambda c, i: i != at))
                    ).otherwise(line),
                )

            return F.when(at.isNull(), seg["lines"]).otherwise(F.transform(seg["lines"], row))

        return F.when(
            seg["is_table"] & (F.size(seg["lines"]) >= 2), let(F.get(hit(header), F.lit(0)), rows)
        ).otherwise(seg["lines"])

    return F.array_join(F.flatten(F.transform(md_segments(body), cut)), "\n")


def explode_content_blocks(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """Document to ordered ``(doc, pos, type, text, rows)`` blocks of plain text."""

    def block(seg: Column) -> Column:
        rows = F.transform(
            F.filter(
                F.transform(F.transform(seg["lines"], table_cells), lambda c, i: F.struct(i.alias("i"), c.alias("c"))),
                lambda r: ~((r["i"] == 1) & _is_rule(r["c"])),
            ),
            lambda r: F.transform(r["c"], md_cell_plain),
        )
        return F.when(
            seg["is_table"],
            F.struct(F.lit("table").alias("type"), F.lit("").alias("text"), rows.alias("rows")),
        ).otherwise(
            F.struct(
                F.lit("paragraph").alias("type"),
                md_paragraph_plain(F.array_join(seg["lines"], "\n")).alias("text"),
                F.array().cast("array<array<string>>").alias("rows"),
            )
        )

    segments = F.filter(
        md_segments(drop_md_column(F.replace(col(body), F.lit("\r\n"), F.lit("\n")))),
        lambda s: ~s["is_table"] | (F.size(s["lines"]) >= 2),
    )
    blocks = F.filter(F.transform(segments, block), lambda b: (b["type"] == "table") | (b["text"] != ""))
    return unnest(docs, [doc], blocks, "b", "pos").select(doc, "pos", "b.type", "b.text", "b.rows")


def render_md_table(cells: Column | str) -> Column:
    """Rows (``array<array<string>>``, header first) to pipe-table text."""
    rows = col(cells)
    rule = lambda h: render_row(F.transform(h, lambda _: F.lit("---")))
    return let(
        rows,
        lambda r: F.array_join(
            F.concat(
                F.array(render_row(F.element_at(r, 1)), rule(F.element_at(r, 1))),
                F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), render_row),
            ),
            "\n",
        ),
    )


def chunk_report(
    docs: DataFrame,
    cap: int = K.CHUNK_DEFAULT,
    doc: str = "doc",
    body: str = "body",
) -> DataFrame:
    """Cut each report into chunks of whole sections, greedily filled up to ``cap`` characters.

    A section longer than the cap makes a chunk of its own and is kept whole.
    """
    cap = min(max(cap, K.CHUNK_MIN), K.CHUNK_MAX)
    parts = F.split(trim_all(body), _SECTION_SPLIT)
    first = F.struct(
        F.array().cast("array<int>").alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("i")
    )

    def step(acc: Column, part: Column) -> Column:
        size = F.length(part)
        new = (acc["i"] == 0) | (acc["used"] + size + 1 > cap)
        return F.struct(
            F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(new, size).otherwise(acc["used"] + size + 1).alias("used"),
            (acc["i"] + 1).alias("i"),
        )

    def chunks(ps: Column) -> Column:
        return let(
            F.aggregate(ps, first, step)["starts"],
            lambda st: F.transform(
                st,
                lambda s, k: F.array_join(F.slice(ps, s + 1, F.coalesce(F.get(st, k + 1), F.size(ps)) - s), "\n"),
            ),
        )

    return unnest(docs, [doc], let(parts, chunks), "chunk", "chunk_no")


def page_text(html: Column | str) -> Column:
    """Visible text of a web page: scripts, styles, comments and tags removed, entities decoded."""
    # &amp; last, so that an escaped entity is not decoded twice
    out = F.regexp_replace(
        col(html), r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>", " "
    )
    entities = [
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&nbsp;", " "),
        ("&middot;", "·"),
        ("&copy;", "©"),
        ("&amp;", "&"),
    ]
    for entity, char in entities:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s\x{A0}]+", " "))
