"""The given tables in the roles of the library: journals, metrics, registry, papers, files, logs.

Each role has a DataFrame and, below it, the same rows as a SQL common table
expression for the twin queries. All roles keep every row of their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are parsed as text; a single-split file is dealt out first."""
    return spread(table(spark, sf_dir, name))


# part type -> discipline spelling of a journal
TYPE_CATEGORY = {
    "ECONOMY": "Economics",
    "SMALL": "Psychology, Social",
    "MEDIUM": "Women Studies",
    "LARGE": "Area Studies",
    "PROMO": "Industrial Relations & Labor",
    "STANDARD": "Sociology Q2",
}
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_CATEGORY.items())


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as journals: print ISSN from the part key, one of 150 e-ISSNs, one or two categories."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS entry_id",
        "p_name AS title",
        "concat_ws('-', substr(lpad(p_partkey, 8, '0'), 1, 4), substr(lpad(p_partkey, 8, '0'), 5, 4)) AS issn",
        "concat('9', lpad(p_partkey % 150, 7, '0')) AS eissn",
        "p_brand AS publisher",
        f"CASE WHEN p_size > 25 THEN array(CASE p_type {_CASE} END, 'Management Q1') ELSE array(CASE p_type {_CASE} END) END AS categories",
        "concat('added; ', CASE WHEN p_size > 10 THEN 'wos/jcr' ELSE 'manual' END, '; ', p_brand, ' ;') AS notes",
        "p_size AS size",
    )


JOURNALS = f"""journals AS (
  SELECT p_partkey AS entry_id, p_name AS title,
    substr(lpad(p_partkey::VARCHAR, 8, '0'), 1, 4) || '-' || substr(lpad(p_partkey::VARCHAR, 8, '0'), 5, 4) AS issn,
    '9' || lpad((p_partkey % 150)::VARCHAR, 7, '0') AS eissn,
    lpad(p_partkey::VARCHAR, 8, '0') AS pkey,
    p_brand AS publisher,
    CASE WHEN p_size > 25 THEN [CASE p_type {_CASE} END, 'Management Q1'] ELSE [CASE p_type {_CASE} END] END AS categories,
    'added; ' || CASE WHEN p_size > 10 THEN 'wos/jcr' ELSE 'manual' END || '; ' || p_brand || ' ;' AS notes,
    p_size AS size
  FROM part)"""


#: What orders the lines of a metric file, and the bits it takes.
LINE_WIDTHS = {"l_orderkey": 36, "l_linenumber": 4, "l_partkey": 32, "l_suppkey": 28}
LINE_COLS = list(LINE_WIDTHS)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as metric rows; the return flag plays the file, a few percent of the rows lack an ISSN."""
    return texts(spark, sf_dir, "lineitem").selectExpr(
        "concat('metrics_', l_returnflag) AS file_name",
        *LINE_COLS,
        "CASE WHEN l_linestatus = 'O' THEN 'SSCI' ELSE 'SCIE' END AS edition",
        "CASE WHEN l_quantity >= 2 THEN lpad(l_partkey, 8, '0') ELSE '' END AS issn_print",
        "CASE WHEN l_tax > 0.005 THEN concat('9', lpad(l_suppkey, 7, '0')) ELSE '' END AS issn_e",
        "CASE WHEN l_linenumber <= 4 THEN concat('q', l_linenumber, ' ') ELSE 'N/A' END AS quartile",
        "CASE WHEN l_discount > 0.005 THEN cast(cast(round(l_discount * 100) AS INT) AS STRING) ELSE '' END AS jif",
        "cast(cast(l_quantity AS INT) AS STRING) AS jci",
        "l_returnflag AS oa_citable_pct",
        "cast(l_orderkey AS STRING) AS total_citations",
        "concat(l_linestatus, l_linenumber) AS jcr_abbrev",
    )


METRICS = f"""jcr AS (
  SELECT 'metrics_' || l_returnflag AS file_name, {", ".join(LINE_COLS)},
    CASE WHEN l_linestatus = 'O' THEN 'SSCI' ELSE 'SCIE' END AS edition,
    CASE WHEN l_quantity >= 2 THEN lpad(l_partkey::VARCHAR, 8, '0') ELSE '' END AS issn_print,
    CASE WHEN l_tax > 0.005 THEN '9' || lpad(l_suppkey::VARCHAR, 7, '0') ELSE '' END AS issn_e,
    CASE WHEN l_linenumber <= 4 THEN 'Q' || l_linenumber ELSE 'N/A' END AS quartile,
    CASE WHEN l_discount > 0.005 THEN (round(l_discount * 100)::INT)::VARCHAR END AS jif,
    (l_quantity::INT)::VARCHAR AS jci,
    l_returnflag AS oa_citable_pct,
    l_orderkey::VARCHAR AS total_citations,
    l_linestatus || l_linenumber AS jcr_abbrev
  FROM lineitem)"""

_DESC = ", ".join(f"{c} DESC" for c in LINE_COLS)


def metric_index_sql(source: str = "jcr") -> str:
    """CTEs ending in ``idx(issn_key, quartile, quartile_raw, jif, ...)``."""
    return f"""keyed AS (
  SELECT issn_print AS issn_key, * FROM {source} WHERE issn_print <> ''
  UNION ALL SELECT issn_e AS issn_key, * FROM {source} WHERE issn_e <> ''),
det AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issn_key ORDER BY file_name, {_DESC}) AS rn FROM keyed) WHERE rn = 1),
qua AS (SELECT issn_key, quartile FROM (SELECT *, row_number() OVER (PARTITION BY issn_key ORDER BY file_name, {_DESC}) AS rn
  FROM keyed WHERE quartile IN ('Q1','Q2','Q3','Q4')) WHERE rn = 1),
idx AS (SELECT d.issn_key, q.quartile, CASE WHEN d.quartile LIKE 'Q%' THEN lower(d.quartile) ELSE d.quartile END AS quartile_raw,
  d.jif, d.jci, d.oa_citable_pct, d.total_citations, d.jcr_abbrev
  FROM det d LEFT JOIN qua q USING (issn_key))"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the journal registry; source ids repeat, some records lack one."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS row_pos",
        "s_name AS name",
        "concat('S', s_suppkey) AS short",
        "lpad(s_suppkey * 3, 8, '0') AS issn",
        "concat('9', lpad(s_suppkey + 50, 7, '0')) AS eissn",
        "CASE WHEN s_acctbal > 2000 THEN concat('W', s_nationkey, '-', s_suppkey % 7) ELSE '' END AS openalex_source_id",
        "CASE WHEN s_nationkey < 12 THEN array('Sociology Q1', 'Economics') ELSE cast(array() AS array<string>) END AS source_categories",
    )


REGISTRY = """registry AS (
  SELECT s_suppkey AS row_pos, s_name AS name, 'S' || s_suppkey AS short,
    lpad((s_suppkey * 3)::VARCHAR, 8, '0') AS issn,
    '9' || lpad((s_suppkey + 50)::VARCHAR, 7, '0') AS eissn,
    CASE WHEN s_acctbal > 2000 THEN 'W' || s_nationkey || '-' || (s_suppkey % 7) ELSE '' END AS openalex_source_id,
    CASE WHEN s_nationkey < 12 THEN ['Sociology Q1', 'Economics'] ELSE [] END AS source_categories
  FROM supplier)"""


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of source lists, with names that hit the registry through case and blanks."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS entry_id",
        "concat('  SUPPLIER#', lpad(p_partkey % 400, 9, '0'), ' ') AS name",
        "CASE WHEN p_size > 25 THEN lpad(p_partkey, 8, '0') ELSE '' END AS issn",
        "CASE WHEN p_size BETWEEN 15 AND 35 THEN concat('9', lpad(p_partkey % 150, 7, '0')) ELSE '' END AS eissn",
        "p_type AS discipline",
        "p_size AS size",
    )


ENTRIES = """entries AS (
  SELECT p_partkey AS entry_id, 'supplier#' || lpad((p_partkey % 400)::VARCHAR, 9, '0') AS name_key,
    '  SUPPLIER#' || lpad((p_partkey % 400)::VARCHAR, 9, '0') || ' ' AS name,
    CASE WHEN p_size > 25 THEN lpad(p_partkey::VARCHAR, 8, '0') ELSE '' END AS issn,
    CASE WHEN p_size BETWEEN 15 AND 35 THEN '9' || lpad((p_partkey % 150)::VARCHAR, 7, '0') ELSE '' END AS eissn,
    p_type AS discipline, p_size AS size
  FROM part)"""

_PAPER_COLS = [
    "lang AS topic",
    "doc_id + 1 AS id",
    "doc_id AS pos",
    "source AS journal",
    "cast(2000 + doc_id % 25 AS INT) AS year",
    """CASE doc_id % 5 WHEN 0 THEN concat('Ann Lee', doc_id) WHEN 1 THEN concat('Ann Lee', doc_id, ' and Bo Chan', doc_id)
       WHEN 2 THEN concat('A B', doc_id, ', C D; E F et al.') WHEN 3 THEN concat('First Middle Last', doc_id) ELSE '' END AS authors""",
    "CASE doc_id % 3 WHEN 0 THEN concat('10.1000/d', doc_id) WHEN 1 THEN concat('https://doi.org/10.1000/d', doc_id) ELSE '' END AS doi",
    "CASE WHEN doc_id % 4 > 0 THEN concat('https://openalex.org/W', doc_id) ELSE '' END AS openalex",
    "text AS abstract",
]


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: language is the topic, source the journal, the first line the title."""
    return texts(spark, sf_dir, "documents").selectExpr(*_PAPER_COLS, "trim(split_part(text, '\n', 1)) AS title")


PAPERS = f"""papers AS (SELECT {", ".join(_PAPER_COLS)}, trim(split_part(text, chr(10), 1)) AS title FROM documents)"""

# white space classes of the twin queries
WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_steps(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x
