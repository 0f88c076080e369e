"""Readers. Each returns a lazy DataFrame; headers and listings are the only things read early."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import constants as K
from shelfspark.functions.files import version_parse
from shelfspark.functions.text import blank_to_null, trim_all
from shelfspark.operators.catalogue import latest_per_prefix, repair_shifted_rows
from shelfspark.operators.ranking import distributed_row_number, first_by_rank, ordinals, packed_rank
from shelfspark.session import written
from shelfspark.sources.records import record

INDEX_COLUMNS = {
    "title": r"journal title",
    "issn": r"^issn$",
    "eissn": r"^eissn$",
    "publisher": r"publisher name",
    "categories": r"web of science categories",
}

METRIC_COLUMNS = [
    "category",
    "edition",
    "journal_name",
    "issn_print",
    "issn_e",
    "publisher",
    "quartile",
    "jif",
    "jci",
    "oa_citable_pct",
    "total_citations",
    "jcr_abbrev",
]


# a file or folder name anywhere in a path
METRIC_SEGMENT = r"(?i)/(WOS_JCR_\d{6}_[^/]+_\d{6}_normalized\.csv)(?:/|$)"
LIST_SEGMENT = r"(?i)^(.*/([^/]+_\d{8}_v\d+\.ya?ml))(?:/[^/]*)?$"


def file_position() -> list[Column]:
    """Order of rows inside one file: start of the split, then the row number in it.

    A split is read by one task, so the task's own row count (the lower 33 bits of the id) orders its rows.
    """
    return [
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row_in_block"),
    ]


def resolve_header(header: Sequence[str], patterns: Mapping[str, str]) -> dict[str, str]:
    """Header name per wanted column: an exact name first, then a pattern; two hits raise."""
    out = {}
    for want, pattern in patterns.items():
        exact = [h for h in header if h.strip().lower() == want]
        hits = exact or [h for h in header if re.search(pattern, h.strip(), re.I)]
        if len(hits) != 1:
            raise ValueError(f"column {want!r}: {len(hits)} of the headers {list(header)} match")
        out[want] = hits[0]
    return out


def scan_journal_index(spark: SparkSession, path: str) -> DataFrame:
    """Journal index CSV to ``title, issn, eissn, publisher, categories``; rows without a title are dropped."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    at = resolve_header(raw.columns, INDEX_COLUMNS)
    text = {c: F.coalesce(trim_all(F.col(f"`{h}`")), F.lit("")) for c, h in at.items()}
    cats = F.filter(F.transform(F.split(text["categories"], r"\|"), trim_all), lambda c: c != "")
    return raw.select(
        *[text[c].alias(c) for c in ("title", "issn", "eissn", "publisher")], cats.alias("categories")
    ).where(F.col("title") != "")


# one short row per file may be broadcast up to this many files, some 20 MB
BROADCAST_FILES = 50_000
FILE_SALTS = 64


def _join_by_file(rows: DataFrame, per_file: DataFrame, n_files: int) -> DataFrame:
    """Rows with the facts of their file; one file may hold most of the rows."""
    if n_files <= BROADCAST_FILES:
        return rows.join(F.broadcast(per_file), "file_path")
    salted = per_file.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(FILE_SALTS - 1))))
    salt = F.pmod(F.xxhash64("row_in_block"), F.lit(FILE_SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(salted, ["file_path", "_salt"]).drop("_salt")


_CELL = r",(\"[^\"]*+(?:\"\"[^\"]*+)*+\"(?=,|$)|[^,]*)"


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line, whatever their number; a quoted cell may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))
    quoted = lambda c: F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1)
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(quoted(c), inner(c)).otherwise(c))


def _is_header(line: Column) -> Column:
    """Whether a cell of the line names the journal column; the cheap test on the line is nearly always false and runs first."""
    return F.contains(F.lower(line), F.lit("journal_name")) & F.exists(csv_cells(line), lambda c: F.lower(trim_all(c)) == "journal_name")


def _metric_headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Lower-case header cells ``h`` of every metric file, by ``file_name``: its first line that names the journal column."""
    cells = F.transform(csv_cells(F.col("value")), lambda c: F.lower(trim_all(c)))
    first = F.min_by("h", F.struct("file_path", "block_start", "row_in_block"))
    found = lines.where(_is_header(F.col("value"))).withColumn("h", cells).join(files, "file_path")
    return found.groupBy("file_name").agg(first.alias("h"))


def scan_metric_files(spark: SparkSession, path: str) -> DataFrame:
    """Metric CSVs to named columns, with discipline and date from each file name.

    A metric file may be one CSV or a folder of that name with part files. Files may
    order their columns differently: the facts of each file (its name parts, the
    position of every column) are one row of a small frame, joined back by file. Rows
    shifted by an unquoted comma are repaired. ``part_no``, ``block_start`` and
    ``row_in_block`` order the rows of a file. A file without a header that names the
    journal column gives no rows. Files may be of any width and number: lines are cut into arrays of cells, so the width of
    a file is that of its header, and the headers are found by a scan that only looks for the journal column's name.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .text(path)
        .where(F.trim("value") != "")
        .select("value", _file_path(), *file_position())
    )
    files = (
        scan_file_inventory(spark, path, "*.csv")
        .select(F.col("uri").alias("file_path"), F.regexp_extract("uri", METRIC_SEGMENT, 1).alias("file_name"))
        .where(F.col("file_name") != "")
    )
    part = lambda i: F.regexp_extract("file_name", K.METRIC_FILE_PATTERN, i)
    per_file = files.join(_metric_headers(files, lines), "file_name").select(
        "file_path",
        "file_name",
        part(2).alias("slug"),
        F.translate(part(2), "_", " ").alias("file_discipline"),
        part(3).alias("file_date"),
        F.coalesce(F.regexp_extract("file_path", r"/part-(\d+)[^/]*$", 1).try_cast("int"), F.lit(0)).alias("part_no"),
        *[(F.array_position("h", F.lit(c)).cast("int") - 1).alias(f"at_{c}") for c in METRIC_COLUMNS],
    )
    per_file = written(per_file, "metric-headers")  # one row a file; the data are then read once
    body = _join_by_file(lines.where(~_is_header(F.col("value"))), per_file, per_file.count())
    body = body.withColumn("cells", csv_cells(F.col("value"))).drop("value")
    name_at, cat_at = F.col("at_journal_name"), F.col("at_category")
    body = body.withColumn(
        "was_shifted", trim_all(F.get("cells", name_at)).isin(K.EDITION_CODES) & (F.size("cells") > name_at + 1)
    )
    shifted = F.col("was_shifted")

    def cell(c: str) -> Column:
        at = F.col(f"at_{c}")
        if c == "category":
            whole = F.concat_ws(", ", trim_all(F.get("cells", at)), trim_all(F.get("cells", at + 1)))
            value = F.when(shifted, whole).otherwise(F.get("cells", at))
        else:
            value = F.get("cells", at + F.when(shifted & (at > cat_at), 1).otherwise(0))
        # a column the file does not have is NULL
        return F.when(at >= 0, value)

    fixed = {c: cell(c) for c in METRIC_COLUMNS}
    return body.select(
        "file_name",
        "slug",
        "file_discipline",
        "file_date",
        "part_no",
        "block_start",
        "row_in_block",
        *[trim_all(c).alias(n) for n, c in fixed.items()],
        "was_shifted",
    )


REGISTRY_FIELDS = [
    "name",
    "short",
    "issn",
    "eissn",
    "openalex_source_id",
    "openalex_source_display_name",
    "notes",
    "quartile",
    "jif",
    "jci",
    "oa_citable_pct",
    "total_citations",
]
REGISTRY_SCHEMA = T.StructType(
    [*[T.StructField(f, T.StringType()) for f in REGISTRY_FIELDS], T.StructField("source_categories", T.ArrayType(T.StringType()))]
)


def scan_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """Registry as JSON lines with a fixed schema; splittable, the form to keep at scale."""
    df = spark.read.schema(REGISTRY_SCHEMA).json(path)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), *file_position())


#: First keys a registry record may have.
_RECORD_KEYS = "|".join([*REGISTRY_FIELDS, "title", "source_categories"])


_RECORD_START = rf"^(?:\x{{FEFF}})?( *)- *[\"']?(?:{_RECORD_KEYS})[\"']?[ \t]*:"


def _registry_indents(lines: DataFrame) -> DataFrame:
    """``(file_path, indent)``: blanks before the records, the least before a list item that begins with a registry field.

    A small written table, one row a file; ``lines`` is ``(file_path, value)``.
    """
    blank = F.when(F.col("value").rlike(_RECORD_START), F.length(F.regexp_extract("value", _RECORD_START, 1)))
    return written(lines.groupBy("file_path").agg(F.min(blank).alias("indent")), "registry-indents")


def _file_path() -> Column:
    return F.col("_metadata.file_path").alias("file_path")


def scan_registry(spark: SparkSession, path: str | list[str], item: str = "- ", indent: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Registry or source list in YAML, ``{journals: [...]}`` or a bare list.

    A file is split at its list items (``lineSep``), so it is read by many tasks, and a record is parsed by column
    expressions (:func:`shelfspark.sources.records.record`). ``indent``, the blank before an item, is read from each file
    where it is not given; files are read once for every indent that occurs, and a file without a record is an error.
    ``only`` is a frame of the ``file_path`` that count, where ``path`` is a folder with others in it.
    """
    reader = spark.read if only is None else spark.read.option("recursiveFileLookup", "true")
    chosen = lambda df: df if only is None else df.join(only, "file_path", "left_semi")
    if indent is not None:
        return _records(chosen(_pieces(reader, path, item, len(indent))), len(indent), item)
    files = _registry_indents(chosen(reader.text(path).select(_file_path(), "value")))
    empty = [r["file_path"] for r in files.where("indent IS NULL").limit(3).collect()]
    depths = [r["indent"] for r in files.where("indent IS NOT NULL").select("indent").distinct().collect()]  # a few small numbers
    if empty or not depths:
        raise ValueError(f"no registry record in {empty or path}")
    parts = [_records(_pieces(reader, path, item, n).join(files.where(F.col("indent") == n), "file_path", "left_semi"), n, item) for n in sorted(depths)]
    return reduce(DataFrame.unionByName, parts)


def _pieces(reader, path: str | list[str], item: str, indent: int) -> DataFrame:
    raw = reader.option("lineSep", "\n" + " " * indent + item).text(path)
    return raw.select("value", _file_path(), F.col("_metadata.file_name").alias("file_name"), *file_position())


def _records(pieces: DataFrame, indent: int, item: str) -> DataFrame:
    # the first piece of a file is its head (meta, ``journals:``); in a bare list it is the first item
    piece = F.regexp_replace("value", rf"^(?:\x{{FEFF}})?{' ' * indent}{item}", "")
    rows = pieces.withColumn("value", piece).where(
        F.col("value").rlike(rf"(?m)^\s*[\"']?(?:{_RECORD_KEYS})[\"']?[ \t]*:") & ~F.col("value").rlike(r"(?m)^(meta|journals):")
    )
    fields = record(F.col("value"), indent, REGISTRY_FIELDS, ["source_categories"])
    return rows.select(fields.alias("r"), "file_path", "file_name", "block_start", "row_in_block").select("r.*", "file_path", "file_name", "block_start", "row_in_block")


def scan_registry_inputs(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """``meta.inputs`` of registries as rows ``folder, file_name, pos, label, file, count``, by lines; the records are not parsed.

    With ``packed`` the files hold many registries each, as JSON lines of ``registry, content``, so their number follows the
    size of the registries; ``folder`` is then the registry's name, and a record is cut into its lines inside its row.
    """
    line = r"^\s*(-\s+)?(label|file|count):\s*(.*?)\s*$"
    part = lambda i: F.regexp_extract("value", line, i)
    place = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), *file_position()]
    if packed:
        packs = spark.read.schema("registry string, content string").json(path).select(F.col("registry").alias("folder"), "content", *place)
        lines = packs.select("folder", "file_path", "file_name", "block_start", "row_in_block", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("at", "value"))
        own, order = ["folder", "file_path", "file_name", "block_start", "row_in_block"], ["at"]
    else:
        lines = spark.read.text(path).select("value", *place).withColumn("folder", F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1))
        own, order = ["folder", "file_path", "file_name"], ["block_start", "row_in_block"]
    keys = list(dict.fromkeys([*own, *order]))
    rows = lines.where(F.col("value").rlike(line)).select(*keys, (part(1) != "").cast("int").alias("first"), part(2).alias("key"), F.trim(part(3), F.lit("'\"")).alias("v"))
    # only the few input lines of a registry reach the window
    numbered = rows.withColumn("pos", F.sum("first").over(Window.partitionBy(*own).orderBy(*order)) - 1)
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("v")))
    inputs = numbered.groupBy(*own, "pos").agg(value("label").alias("label"), value("file").alias("file"), value("count").try_cast("int").alias("count"))
    return inputs.select("folder", "file_name", "pos", "label", "file", "count")


def scan_file_inventory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below ``path``: ``path, name, size, mtime`` and the ``uri`` other readers report.

    The content column is never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.col("_metadata.file_path").alias("uri"),
    )


def scan_source_lists(spark: SparkSession, path: str, **yaml_layout: str) -> DataFrame:
    """Newest source list of every prefix, in rows.

    The newest files (one list per prefix, maybe in parts) are found from the listing; lines of older versions are dropped
    by their path before anything is parsed.
    """
    files = scan_file_inventory(spark, path).select(
        F.col("uri").alias("file_path"), F.regexp_extract("path", LIST_SEGMENT, 1).alias("list_path"), F.regexp_extract("path", LIST_SEGMENT, 2).alias("list_name")
    )
    lists = files.where(F.col("list_name") != "")
    versions = lists.select("list_path", "list_name").distinct().select("list_path", version_parse("list_name").alias("v"))
    newest = latest_per_prefix(versions.select("list_path", "v.*")).select("list_path")
    only = written(lists.join(newest, "list_path", "left_semi").select("file_path"), "newest-lists")
    rows = scan_registry(spark, path, only=only, **yaml_layout)
    v = version_parse(F.regexp_extract("file_path", LIST_SEGMENT, 2))
    return rows.select("*", v["prefix"].alias("prefix"), v["date_tag"].alias("date_tag"), v["version"].alias("version"))


def _topic_stage(path: Column) -> tuple[Column, Column]:
    stage = "|".join(K.STAGES)
    pattern = rf"(?:topic=)?([^/=]+)/(?:stage=)?({stage})/[^/]+$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def scan_markdown_corpus(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Markdown files as whole documents: ``topic, stage, file, body``, BOM removed. One file is one row."""
    p = F.col("_metadata.file_path")
    topic, stage = _topic_stage(p)
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(
        topic.alias("topic"),
        stage.alias("stage"),
        F.col("_metadata.file_name").alias("file"),
        F.regexp_replace("value", r"^\x{FEFF}", "").alias("body"),
    )


def scan_summary_blocks(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Summary files cut at their ``---`` lines while reading: ``topic, file, block``.

    For files too large for one row: the text source splits at the separator, so one
    file is read by many tasks. Feed ``block`` to ``paper_fields``. Here any
    line that begins with ``---`` ends a block, whatever follows in it; read files where
    such lines are text by :func:`scan_markdown_corpus`.
    """
    p = F.col("_metadata.file_path")
    topic, _ = _topic_stage(p)
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n---")
        .text(path)
    )
    return raw.select(
        topic.alias("topic"),
        F.col("_metadata.file_name").alias("file"),
        F.regexp_replace("value", r"^\x{FEFF}", "").alias("block"),
    ).where(F.col("block").rlike(r"(?m)^##[ \t]+\d+\."))


def scan_topic_index(spark: SparkSession, path: str, glob: str = "index.json") -> DataFrame:
    """Topics found as folders, with the label of their index file or the slug."""
    stage = "|".join(K.STAGES)
    topic_of = lambda p: F.regexp_extract(p, rf"(?:topic=)?([^/=]+)/(?:(?:stage=)?(?:{stage})/)?[^/]+$", 1)
    topics = scan_file_inventory(spark, path).select(topic_of("path").alias("topic")).distinct()
    labels = (
        spark.read.schema("label string")
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .json(path)
        .select(topic_of(F.col("_metadata.file_path")).alias("topic"), blank_to_null("label").alias("label"))
        .groupBy("topic")
        .agg(F.max("label").alias("label"))
    )
    return topics.join(labels, "topic", "left").withColumn("label", F.coalesce("label", "topic"))


# a file named after its job, or any file in the partition of its job
JOB_FILE = r"/(?:job_id=)?(job_[A-Za-z0-9_]+)(?:\.log|\.meta\.json)$|/job_id=(job_[A-Za-z0-9_]+)/[^/]+$"


def _chosen_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``(uri, job_id)``: one file per job, a live one before archived ones, then by path; found from the listing alone."""
    uri = F.col("uri")
    job = F.concat(F.regexp_extract(uri, JOB_FILE, 1), F.regexp_extract(uri, JOB_FILE, 2))
    files = scan_file_inventory(spark, path, glob).select("uri", job.alias("job_id"), F.contains(uri, F.lit("/archive/")).cast("int").alias("archived"))
    ranked = distributed_row_number(files, [F.col("archived").asc(), uri.asc()], ["job_id"], name="rn")
    return written(ranked.where("rn = 1").select("uri", "job_id"), "job-files")


def _first_records(spark: SparkSession, path: str, glob: str, fields: str) -> DataFrame:
    """Record of every job in packs of JSON lines: a live one before archived ones, then by path and place in the file."""
    files = ordinals(scan_file_inventory(spark, path, glob), "uri", "_file")
    packs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).schema(f"job_id string, {fields}").json(path)
    rows = packs.where(F.col("job_id").isNotNull()).select("*", F.col("_metadata.file_path").alias("uri"), *file_position()).join(files, "uri")
    archived = F.contains("uri", F.lit("/archive/")).cast("int")
    rank = packed_rank((archived, 2), ("_file", 24), ("block_start", 46), ("row_in_block", 34))
    return first_by_rank(rows, ["job_id"], rank).select(*packs.columns)


def scan_job_logs(
    spark: SparkSession, path: str, log_glob: str = "job_*.log", meta_glob: str = "job_*.meta.json", packed: bool = False
) -> DataFrame:
    """Logs and outcomes of jobs; a live file wins over its archived copies.

    ``job_id, content, done, exit_code``. One log is one row. The file of each job is chosen from the listing; texts meet no
    aggregate, they are only joined with the chosen paths.

    A file system spends some ten milliseconds on a file of its own for every job. With ``packed`` the files hold many jobs
    each, as JSON lines of ``job_id, content`` and ``job_id, exitCode, done``, so their number follows the size of the logs.
    """
    if packed:
        logs = _first_records(spark, path, log_glob, "content string")
        metas = _first_records(spark, path, meta_glob, "exitCode int, done boolean")
    else:
        reader = lambda glob: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        uri = F.col("_metadata.file_path").alias("uri")
        logs = reader(log_glob).text(path, wholetext=True).select(uri, F.col("value").alias("content"))
        logs = logs.join(_chosen_files(spark, path, log_glob), "uri").select("job_id", "content")
        metas = reader(meta_glob).schema("exitCode int, signal string, done boolean").option("multiLine", "true").json(path)
        metas = metas.select(uri, "exitCode", "done").join(_chosen_files(spark, path, meta_glob), "uri").drop("uri")
    return logs.join(metas, "job_id", "left").select(
        "job_id",
        "content",
        F.coalesce("done", F.lit(False)).alias("done"),
        F.col("exitCode").alias("exit_code"),
    )


__all__ = [
    "INDEX_COLUMNS",
    "METRIC_COLUMNS",
    "REGISTRY_FIELDS",
    "REGISTRY_SCHEMA",
    "csv_cells",
    "file_position",
    "repair_shifted_rows",
    "resolve_header",
    "scan_file_inventory",
    "scan_job_logs",
    "scan_journal_index",
    "scan_markdown_corpus",
    "scan_metric_files",
    "scan_registry_inputs",
    "scan_registry",
    "scan_registry_json",
    "scan_source_lists",
    "scan_summary_blocks",
    "scan_topic_index",
]
