"""Paper, Markdown and citation operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.predicates import abstract_missing_raw
from shelfspark.operators import markdown as md
from shelfspark.operators import papers as pp
from shelfspark.plans import reports
from shelfspark.plans import roles as r
from shelfspark.plans.registry import query
from shelfspark.plans.roles import sql_steps, sql_trim, table, texts
from shelfspark.plans.scalars import _ABSTRACT, _IN_TEXT_SQL, _MD_STEPS, missing_sql, overview_docs, overview_rows

_ONE_LINE = sql_trim("replace(text, chr(10), ' ')")

# --- tables in Markdown ------------------------------------------------------------------

_TABLE_DOC = r"concat(text, '\n| Name | OpenAlex ID | Lang |\n| :-- | --- | --: |\n| **', source, '** | W', doc_id, ' | ', lang, ' |\n| short |\nbetween\n|only|\n\n|x|y|\n|1|', doc_id, '|\n')"


@query(
    "explode_md_tables",
    """SELECT doc_id AS doc, 0 AS table_no, 0 AS row_no, 'Name/OpenAlex ID/Lang' AS cells FROM documents
     UNION ALL SELECT doc_id, 0, 1, '**' || source || '**/W' || doc_id || '/' || lang FROM documents UNION ALL SELECT doc_id, 0, 2, 'short' FROM documents
     UNION ALL SELECT doc_id, 1, 0, 'x/y' FROM documents UNION ALL SELECT doc_id, 1, 1, '1/' || doc_id FROM documents""",
)
def explode_md_tables(spark, sf):
    docs = texts(spark, sf, "documents").selectExpr("doc_id AS doc", f"{_TABLE_DOC} AS body")
    return md.explode_md_tables(docs).select("doc", "table_no", "row_no", F.array_join("cells", "/").alias("cells"))


@query(
    "drop_md_column",
    """SELECT doc_id AS doc, md5(text || chr(10) || '| Name | Lang |' || chr(10) || '| :-- | --: |' || chr(10) || '| **' || source || '** | ' || lang || ' |' || chr(10) || '| short |'
       || chr(10) || 'between' || chr(10) || '|only|' || chr(10) || chr(10) || '|x|y|' || chr(10) || '|1|' || doc_id || '|' || chr(10)) AS body FROM documents""",
)
def drop_md_column(spark, sf):
    docs = texts(spark, sf, "documents").selectExpr("doc_id AS doc", f"{_TABLE_DOC} AS body")
    return docs.select("doc", F.md5(md.drop_md_column("body")).alias("body"))


_PLAIN_TEXT = sql_trim(
    sql_steps("text", (r"(?m)^#{1,6}\s+", ""), (r"\[([^\]]+)\]\(([^)]+)\)", r"\1 (\2)"), *_MD_STEPS, (r"(?m)^\s*[-*+]\s+", "• "))
)


@query(
    "explode_content_blocks",
    f"""WITH d AS (SELECT doc_id, source, lang, {_PLAIN_TEXT} AS t FROM documents), b AS (
      SELECT doc_id AS doc, 0 AS k, 'paragraph' AS type, md5(t) AS content FROM d WHERE t <> ''
      UNION ALL SELECT doc_id, 1, 'table', md5('Name/Lang;' || source || '/' || lang || ';short') FROM d
      UNION ALL SELECT doc_id, 2, 'paragraph', md5('between') FROM d
      UNION ALL SELECT doc_id, 3, 'table', md5('x/y;1/' || doc_id) FROM d)
    SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY k) - 1)::INT AS pos, type, content FROM b""",
)
def explode_content_blocks(spark, sf):
    docs = texts(spark, sf, "documents").selectExpr("doc_id AS doc", f"{_TABLE_DOC} AS body")
    rows = F.array_join(F.transform("rows", lambda c: F.array_join(c, "/")), ";")
    content = F.when(F.col("type") == "table", rows).otherwise(F.col("text"))
    return md.explode_content_blocks(docs).select("doc", "pos", "type", F.md5(content).alias("content"))


@query(
    "render_md_table",
    """SELECT c_custkey, '| id | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ' |' || chr(10) || '| ' || c_nationkey || ' | ' || c_mktsegment || ' |' AS body FROM customer""",
)
def render_md_table(spark, sf):
    rows = F.expr(
        "array(array('id', 'name'), array(cast(c_custkey AS STRING), c_name), array(cast(c_nationkey AS STRING), c_mktsegment))"
    )
    return table(spark, sf, "customer").select("c_custkey", md.render_md_table(rows).alias("body"))


_RAW = r"concat('# raw\n\n| Journal | Year | Title | Authors | DOI | OpenAlex | Abstract |\n|---|---|---|---|---|---|---|\n| ', source, ' | ', 2000 + doc_id % 25, ' | T', doc_id, ' | A B | 10.1/', doc_id, ' | W', doc_id, ' | left | ', replace(text, '\n', ' '), ' |\n| too | short |\n| ', lang, ' | NA | U | C D |  |  | n/a |\n')"


@query(
    "raw_papers_table",
    f"""SELECT doc_id AS doc, source AS journal, 2000 + doc_id % 25 AS year, 'T' || doc_id AS title, '10.1/' || doc_id AS doi, md5('left | ' || {_ONE_LINE}) AS abstract, {missing_sql("('left | ' || " + _ONE_LINE + ")", True)}::INT AS missing FROM documents
     UNION ALL SELECT doc_id, lang, 0, 'U', '', md5('n/a'), 1 FROM documents""",
)
def raw_papers_table(spark, sf):
    docs = texts(spark, sf, "documents").selectExpr("doc_id AS doc", f"{_RAW} AS body")
    rows = md.explode_raw_papers(docs)
    return rows.select(
        "doc",
        "journal",
        F.coalesce("year", F.lit(0)).alias("year"),
        "title",
        "doi",
        F.md5("abstract").alias("abstract"),
        abstract_missing_raw("abstract").cast("int").alias("missing"),
    )


# --- paper blocks ---------------------------------------------------------------------------


def summary_docs(spark, sf):
    """One summary document per text: a full paper, a block without a year, and one without a year number."""
    one_line = F.translate("text", "\n", " ")
    full = md.render_paper_block(
        F.col("doc_id") + 1,
        F.concat(F.lit("Paper (draft) "), F.col("doc_id").cast("string")),
        F.expr("2000 + doc_id % 25"),
        {
            "Abstract": one_line,
            "Research question": F.when(F.col("doc_id") % 2 == 0, F.lit("why")),
            "Data / material": F.col("source"),
            "Method": F.lit("line one\nline two"),
            "Key findings (from abstract)": F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(one_line),
            "Contribution": F.col("lang"),
        },
        {"Journal": F.col("source"), "Author(s)": F.concat(F.lit("Ann Lee"), F.col("doc_id").cast("string")), "DOI": F.lit(""), "OpenAlex": F.concat(F.lit("W"), F.col("doc_id").cast("string"))},
    )
    other = F.concat(F.lit("## "), (F.col("doc_id") + 1_000_000).cast("string"), F.lit(". more to come\n\n- Journal: X\n"))
    na = md.render_paper_block(
        F.col("doc_id") + 2_000_000, F.lit("No year"), F.lit(None).cast("int"), {"Key findings (from abstract)": F.lit("typed in by hand, and long enough [MANUAL]")}, {"Journal": F.col("lang"), "Authors": F.lit("C D")}
    )
    head = F.concat(F.lit(chr(0xFEFF) + "# Summaries for "), F.col("lang"))
    body = F.concat(head, F.lit("\n\n---\n\n"), full, F.lit("\n---  \n"), other, F.lit("\n---\n\n"), na)
    return texts(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("topic"), body.alias("body"))


_BLOCKS = f"""blocks AS (
  SELECT doc_id AS doc, lang AS topic, doc_id + 1 AS id, 'Paper (draft) ' || doc_id AS title, 2000 + doc_id % 25 AS year, source AS journal, 'Ann Lee' || doc_id AS authors,
    'W' || doc_id AS openalex, {_ONE_LINE} AS abstract, CASE WHEN doc_id % 2 = 0 THEN 'why' END AS rq, source AS data, 'line one' || chr(10) || 'line two' AS method,
    CASE WHEN doc_id % 4 > 0 THEN {_ONE_LINE} END AS findings, lang AS contribution FROM documents
  UNION ALL SELECT doc_id, lang, doc_id + 1000000, NULL, NULL, 'X', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM documents
  UNION ALL SELECT doc_id, lang, doc_id + 2000000, 'No year', NULL, lang, 'C D', NULL, NULL, NULL, NULL, NULL, 'typed in by hand, and long enough [MANUAL]', NULL FROM documents)"""


@query(
    "explode_paper_blocks",
    f"""WITH {_BLOCKS} SELECT doc, id, coalesce(title, '-') AS title, coalesce(year, 0) AS year, coalesce(journal, '-') AS journal, coalesce(authors, '-') AS authors, coalesce(openalex, '-') AS openalex,
      coalesce(md5(nullif(abstract, '')), '-') AS abstract, coalesce(rq, '-') AS rq, coalesce(data, '-') AS data, coalesce(method, '-') AS method, coalesce(md5(nullif(findings, '')), '-') AS findings, coalesce(contribution, '-') AS contribution FROM blocks""",
)
def explode_paper_blocks(spark, sf):
    p = md.explode_paper_blocks(summary_docs(spark, sf))
    text = ["title", "journal", "authors", "openalex", "rq", "data", "method", "contribution"]
    return p.select(
        "doc",
        F.col("id").cast("bigint").alias("id"),
        F.coalesce(F.col("year").cast("bigint"), F.lit(0)).alias("year"),
        *[F.coalesce(c, F.lit("-")).alias(c) for c in text],
        *[F.coalesce(F.md5(c), F.lit("-")).alias(c) for c in ("abstract", "findings")],
    )


_AUDIT_SQL = f"""audit AS (SELECT *, coalesce(regexp_replace(findings, '(?i)\\s*\\[MANUAL\\]\\s*$', ''), '') AS kf, (findings IS NOT NULL AND findings LIKE '%[MANUAL]%') AS is_manual FROM blocks)"""


@query(
    "audit_partition",
    f"""WITH {_BLOCKS}, {_AUDIT_SQL} SELECT topic, count(*) AS total, sum({missing_sql("kf", False)}::INT)::BIGINT AS n_missing, sum((NOT {missing_sql("kf", False)})::INT)::BIGINT AS n_filled, sum(is_manual::INT)::BIGINT AS n_manual FROM audit GROUP BY topic""",
)
def audit_partition(spark, sf):
    return pp.audit_partition(md.audit_blocks(summary_docs(spark, sf), doc="topic"))


@query(
    "patch_blocks",
    f"""WITH p AS (SELECT doc_id AS doc, 'Better $1 text ' || quality || toxic AS patch FROM labels), e AS (
      SELECT d.doc_id AS doc, d.doc_id + 1 AS id, CASE WHEN p.doc IS NOT NULL THEN patch ELSE CASE WHEN d.doc_id % 4 > 0 THEN {_ONE_LINE} ELSE '' END END AS kf, (p.doc IS NOT NULL)::INT AS is_manual FROM documents d LEFT JOIN p ON p.doc = d.doc_id
      UNION ALL SELECT doc_id, doc_id + 1000000, '', 0 FROM documents UNION ALL SELECT doc_id, doc_id + 2000000, 'typed in by hand, and long enough', 1 FROM documents)
    SELECT doc, id, md5(kf) AS findings, is_manual, {missing_sql("kf", False)}::INT AS missing FROM e""",
)
def patch_blocks(spark, sf):
    labels = table(spark, sf, "labels")
    patches = labels.selectExpr("doc_id AS doc", "cast(doc_id + 1 AS INT) AS idx", "'older' AS abstract", "0 AS seq").union(
        labels.selectExpr("doc_id", "cast(doc_id + 1 AS INT)", "concat('Better $1 text ', quality, toxic, ' ')", "1")
    )
    blocks = md.patch_blocks(md.document_blocks(summary_docs(spark, sf)), patches)
    # whole documents written back and read again, as the next stage does
    again = md.audit_blocks(md.join_blocks(blocks))
    return again.select(
        "doc",
        F.col("id").cast("bigint").alias("id"),
        F.md5("key_findings").alias("findings"),
        F.col("is_manual").cast("int").alias("is_manual"),
        F.col("missing").cast("int").alias("missing"),
    )


# --- reports ------------------------------------------------------------------------------

_REPORT = r"concat(text, '\n## 一、 First ', source, ' \nlead\n**（一）Main** \n', lang, '\n**（二）Method**\nsurveys', '\n## 二、Second\n', '\n## 十一、Third ', lang, '\n', text)"


def report_docs(spark, sf):
    return texts(spark, sf, "documents").selectExpr("doc_id AS doc", f"{_REPORT} AS body")


_SECTIONS = f"""sections AS (SELECT doc_id AS doc, 0 AS pos, '' AS title, {sql_trim("text")} AS body FROM documents
  UNION ALL SELECT doc_id, 1, '一、First ' || source, 'lead' || chr(10) || '**（一）Main** ' || chr(10) || lang || chr(10) || '**（二）Method**' || chr(10) || 'surveys' FROM documents
  UNION ALL SELECT doc_id, 2, '二、Second', '' FROM documents UNION ALL SELECT doc_id, 3, '十一、Third ' || lang, {sql_trim("text")} FROM documents)"""


@query("explode_report_sections", f"WITH {_SECTIONS} SELECT doc, pos, title, md5(body) AS body FROM sections")
def explode_report_sections(spark, sf):
    return md.explode_report_sections(report_docs(spark, sf)).select("doc", "pos", "title", F.md5("body").alias("body"))


@query("sections_nonempty", f"WITH {_SECTIONS} SELECT doc, pos FROM sections WHERE {sql_trim('body')} <> ''")
def sections_nonempty(spark, sf):
    return md.sections_nonempty(md.explode_report_sections(report_docs(spark, sf))).select("doc", "pos")


@query(
    "explode_subsections",
    f"""WITH {_SECTIONS}, s AS (SELECT doc, pos, body FROM sections WHERE pos <> 1), n AS (
       SELECT doc, pos, 0 AS sub_pos, {sql_trim("replace(split_part(body, chr(10), 1), '**', '')")} AS sub_title, CASE WHEN contains(body, chr(10)) THEN {sql_trim("substr(body, instr(body, chr(10)) + 1)")} ELSE '' END AS sub_body FROM s WHERE body <> ''
       UNION ALL SELECT doc_id, 1, 0, 'lead', '' FROM documents UNION ALL SELECT doc_id, 1, 1, '（一）Main', lang FROM documents UNION ALL SELECT doc_id, 1, 2, '（二）Method', 'surveys' FROM documents)
     SELECT doc, pos, sub_pos, md5(sub_title) AS sub_title, md5(sub_body) AS sub_body FROM n""",
)
def explode_subsections(spark, sf):
    subs = md.explode_subsections(md.explode_report_sections(report_docs(spark, sf)))
    return subs.select("doc", "pos", "sub_pos", F.md5("sub_title").alias("sub_title"), F.md5("sub_body").alias("sub_body"))


_CAP = 2000


@query(
    "chunk_report",
    f"""WITH p AS (SELECT doc_id, {sql_trim("text || chr(10) || '.'")} AS p0, '## 一、 First' || chr(10) || text AS p1, '## 二、Second' || chr(10) || source AS p2, {sql_trim("'## 三、 Third' || chr(10) || text")} AS p3 FROM documents),
     l AS (SELECT *, length(p0) AS l0, length(p1) AS l1, length(p2) AS l2, length(p3) AS l3 FROM p),
     a AS (SELECT *, l0 + l1 + 1 > {_CAP} AS n1, CASE WHEN l0 + l1 + 1 > {_CAP} THEN l1 ELSE l0 + l1 + 1 END AS u1 FROM l),
     b AS (SELECT *, u1 + l2 + 1 > {_CAP} AS n2, CASE WHEN u1 + l2 + 1 > {_CAP} THEN l2 ELSE u1 + l2 + 1 END AS u2 FROM a),
     c AS (SELECT *, u2 + l3 + 1 > {_CAP} AS n3 FROM b),
     s AS (SELECT doc_id, 0 AS chunk_no, 0 AS part, p0 AS t FROM c UNION ALL SELECT doc_id, n1::INT, 1, p1 FROM c UNION ALL SELECT doc_id, n1::INT + n2::INT, 2, p2 FROM c UNION ALL SELECT doc_id, n1::INT + n2::INT + n3::INT, 3, p3 FROM c)
     SELECT doc_id AS doc, chunk_no, md5(string_agg(t, chr(10) ORDER BY part)) AS chunk FROM s GROUP BY 1, 2""",
)
def chunk_report(spark, sf):
    docs = texts(spark, sf, "documents").selectExpr(
        "doc_id AS doc",
        r"concat(text, '\n.\n## 一、 First\n', text, '\n## 二、Second\n', source, '\n## 三、 Third\n', text) AS body",
    )
    return md.chunk_report(docs, _CAP).select("doc", "chunk_no", F.md5("chunk").alias("chunk"))


_PAGE_SQL = "trim(regexp_replace({x}, '[\\s\\x0b\\x{{a0}}]+', ' ', 'g'))"


def page_text_sql() -> str:
    x = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>', ' ', 'g')"
    for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{e}', '{c}')"
    return _PAGE_SQL.format(x=x)


@query("page_text", f"SELECT page_id, md5({page_text_sql()}) AS body FROM pages")
def page_text(spark, sf):
    return texts(spark, sf, "pages").select("page_id", F.md5(md.page_text("html")).alias("body"))


# --- citations and joins -----------------------------------------------------------------------


@query("sort_citations_longest", f"WITH {r.PAPERS}, c AS (SELECT id, pos, {_IN_TEXT_SQL} AS in_text FROM papers) SELECT id, in_text, row_number() OVER (ORDER BY length(in_text) DESC, pos, id) AS rank FROM c")
def sort_citations_longest(spark, sf):
    p = r.papers(spark, sf)
    cites = pp.citations(p).join(p.select("id", "pos"), "id")
    return pp.sort_citations_longest(cites).select("id", "in_text", "rank")


def _cited(spark, sf):
    """Customers as papers; names repeat, so that several papers share one citation text."""
    papers = table(spark, sf, "customer").selectExpr(
        "c_mktsegment AS topic",
        "c_custkey + 1 AS id",
        "c_custkey AS pos",
        "CASE c_custkey % 3 WHEN 0 THEN concat('Ann C', c_custkey % 300) WHEN 1 THEN concat('Ann C', c_custkey % 300, ' and Bo D', c_custkey % 300) ELSE concat('A C', c_custkey % 300, ', B E, C F') END AS authors",
        "1990 + c_nationkey AS year",
    )
    return pp.citations(papers).withColumn("pos", F.col("id"))


_BODY = """concat('Order ', o_orderkey, ' follows C', o_custkey % 300, ', ', 1990 + o_orderkey % 25, ' and (C', o_orderkey % 300, ' & D', o_orderkey % 300, ', ', 1990 + o_custkey % 25, '); McC', o_custkey % 300, ' et al., ', 1990 + o_orderkey % 25, ' and [(C1, 1990)](#paper-9).')"""
_TOPIC = "CASE o_orderkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'MACHINERY' WHEN 3 THEN 'HOUSEHOLD' ELSE 'FURNITURE' END"


@query(
    "link_mentions",
    f"""WITH cites AS (SELECT topic, in_text, min(id) AS id FROM (SELECT c_mktsegment AS topic, c_custkey + 1 AS id, '(C' || (c_custkey % 300) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' & D' || (c_custkey % 300) ELSE ' et al.' END || ', ' || (1990 + c_nationkey) || ')' AS in_text FROM customer) GROUP BY ALL),
    b AS (SELECT o_orderkey, {_TOPIC} AS topic, '(C' || (o_custkey % 300) || ', ' || (1990 + o_orderkey % 25) || ')' AS k1, '(C' || (o_orderkey % 300) || ' & D' || (o_orderkey % 300) || ', ' || (1990 + o_custkey % 25) || ')' AS k2,
       '(C' || (o_custkey % 300) || ' et al., ' || (1990 + o_orderkey % 25) || ')' AS k3 FROM orders)
    SELECT o_orderkey AS doc, 'Order ' || o_orderkey || ' follows ' || CASE WHEN c1.id IS NULL THEN k1[2:-2] ELSE '[' || k1 || '](#paper-' || c1.id || ')' END || ' and ' || CASE WHEN c2.id IS NULL THEN k2 ELSE '[' || k2 || '](#paper-' || c2.id || ')' END
      || '; Mc' || CASE WHEN c3.id IS NULL THEN k3[2:-2] ELSE '[' || k3 || '](#paper-' || c3.id || ')' END || ' and [(C1, 1990)](#paper-9).' AS body
    FROM b LEFT JOIN cites c1 ON c1.topic = b.topic AND c1.in_text = k1 LEFT JOIN cites c2 ON c2.topic = b.topic AND c2.in_text = k2 LEFT JOIN cites c3 ON c3.topic = b.topic AND c3.in_text = k3""",
)
def link_mentions(spark, sf):
    bodies = texts(spark, sf, "orders").selectExpr("o_orderkey AS doc", f"{_TOPIC} AS topic", f"{_BODY} AS body")
    return pp.link_mentions(bodies, _cited(spark, sf)).select("doc", "body")


@query(
    "report_flow",
    """WITH s AS (SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id) THEN '[(Lee' || doc_id || ', ' || (2000 + doc_id % 25) || ')](#paper-' || (doc_id + 1) || ')' END AS link FROM documents d)
     SELECT doc_id AS doc, 0 AS pos, '' AS title, 'as ' || link || ' shows' AS body FROM s UNION ALL SELECT doc_id, 1, '一、Next', 'again ' || link FROM s""",
)
def report_flow(spark, sf):
    reports_ = texts(spark, sf, "documents").selectExpr(
        "doc_id AS doc",
        "lang AS topic",
        r"concat('as Lee', doc_id, ', ', 2000 + doc_id % 25, ' shows\n## 一、Next\nagain (Lee', doc_id, ', ', 2000 + doc_id % 25, ')\n## 二、Empty\n') AS body",
    )
    summaries = summary_docs(spark, sf).select("topic", "body")
    return reports.linked_report_sections(summaries, reports_).select("doc", "pos", "title", "body")


@query(
    "paper_lookup",
    f"WITH {r.PAPERS} SELECT topic, id FROM papers WHERE id IN (SELECT doc_id + 1 FROM labels WHERE toxic = 1)",
)
def paper_lookup(spark, sf):
    p = r.papers(spark, sf)
    docs = texts(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"))
    wanted = table(spark, sf, "labels").where("toxic = 1").join(docs, "doc_id").selectExpr("topic", "doc_id + 1 AS id")
    return pp.paper_lookup(p, wanted).select("topic", "id")


@query(
    "fill_from_fallback",
    f"""WITH t AS (SELECT 'p' || (page_id * 3) AS url, {page_text_sql()} AS body FROM pages), m AS (SELECT doc_id, text, 'p' || doc_id AS url, {_ABSTRACT} AS abstract FROM documents), f AS (SELECT *, {missing_sql("abstract", True)} AS missing FROM m)
     SELECT doc_id AS id, md5(CASE WHEN missing AND nullif(body, '') IS NOT NULL THEN body ELSE abstract END) AS abstract, (missing AND nullif(body, '') IS NOT NULL)::INT AS filled FROM f LEFT JOIN t USING (url)""",
)
def fill_from_fallback(spark, sf):
    papers = texts(spark, sf, "documents").selectExpr("doc_id AS id", "concat('p', doc_id) AS url", f"{_ABSTRACT} AS abstract")
    pages = texts(spark, sf, "pages").select(
        F.concat(F.lit("p"), (F.col("page_id") * 3).cast("string")).alias("url"), md.page_text("html").alias("page_text")
    )
    out = pp.fill_from_fallback(papers, pages, abstract_missing_raw("abstract"))
    return out.select("id", F.md5("abstract").alias("abstract"), F.col("filled").cast("int").alias("filled"))


@query(
    "positional_join",
    """SELECT o_orderkey AS doc, 1 AS number, o_orderpriority AS theme, '一、Customers ' || o_custkey AS title, 'first body' AS body FROM orders UNION ALL SELECT o_orderkey, 2, o_orderstatus, '二、Status', o_orderstatus FROM orders""",
)
def positional_join(spark, sf):
    sections = md.explode_report_sections(overview_docs(spark, sf))
    return pp.positional_join(overview_rows(spark, sf).drop("mark"), sections)


# --- counts and profiles ---------------------------------------------------------------------------


@query(
    "raw_paper_stats",
    f"SELECT lang AS topic, count(*) AS total, sum({missing_sql(_ABSTRACT, True)}::INT)::BIGINT AS missing_abstract FROM documents GROUP BY lang",
)
def raw_paper_stats(spark, sf):
    return pp.raw_paper_stats(texts(spark, sf, "documents").selectExpr("lang AS topic", f"{_ABSTRACT} AS abstract"))


@query(
    "corpus_profile",
    f"""WITH {r.PAPERS}, c AS (SELECT topic, journal, count(*) AS n FROM papers GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, journal) AS rn FROM c)
     SELECT p.topic, count(*) AS papers, min(year) AS year_from, max(year) AS year_to, any_value(l.leading) AS leading FROM papers p JOIN (SELECT topic, string_agg(journal, '、' ORDER BY rn) AS leading FROM k WHERE rn <= 3 GROUP BY topic) l USING (topic) GROUP BY p.topic""",
)
def corpus_profile(spark, sf):
    return pp.corpus_profile(r.papers(spark, sf))


@query("cluster_share", "SELECT label AS cluster, count(*) AS n, round(100.0 * count(*) / (sum(count(*)) OVER ())::DOUBLE, 1) AS pct FROM embeddings GROUP BY label")
def cluster_share(spark, sf):
    return pp.cluster_share(table(spark, sf, "embeddings").select(F.col("label").alias("cluster")))


@query(
    "facet_frequency",
    "SELECT value, count(*) AS n FROM (SELECT unnest(list_distinct([lang, source, 'mixed methods'])) AS value FROM documents) GROUP BY value ORDER BY n DESC, value LIMIT 10",
)
def facet_frequency(spark, sf):
    p = texts(spark, sf, "documents").selectExpr("concat(lang, '; ', source, ' ;; mixed methods;', lang) AS method")
    return pp.facet_frequency(p, "method", top=10)


@query(
    "qa_scope_counts",
    """SELECT lang AS topic, count(*) AS total, sum((quality = 0)::INT)::BIGINT AS out_of_scope, (count(*) - sum((quality = 0)::INT))::BIGINT AS in_scope, (count(*) >= 100 AND sum((quality = 0)::INT) > 0)::INT AS gate
       FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
)
def qa_scope_counts(spark, sf):
    flags = (
        table(spark, sf, "labels")
        .join(texts(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
        .select(F.col("lang").alias("topic"), (F.col("quality") == 0).alias("out_of_scope"))
    )
    return pp.qa_scope_counts(flags, ["topic"]).withColumn("gate", F.col("gate").cast("int"))


@query(
    "papers_per_cluster_batches",
    "SELECT vec_id AS id, label AS cluster, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 12)::INT AS batch FROM embeddings",
)
def papers_per_cluster_batches(spark, sf):
    a = table(spark, sf, "embeddings").selectExpr("vec_id AS id", "label AS cluster")
    return pp.papers_per_cluster_batches(a)
