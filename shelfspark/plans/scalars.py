"""Column functions (P1-P34) and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark import functions as fn
from shelfspark.operators import markdown as md
from shelfspark.operators.papers import merge_section_titles
from shelfspark.plans import roles as r
from shelfspark.operators.routing import route, topic_checks
from shelfspark.plans.registry import query
from shelfspark.plans.roles import WS, sql_squeeze, sql_steps, sql_trim, table, texts

# --- catalogue fields ---------------------------------------------------------------

_RAW_ISSN = "concat(' ', lpad(p_partkey, 4, '0'), '-', lpad(p_size, 3, '0'), CASE WHEN p_size % 11 = 10 THEN 'x' ELSE '7' END, ' ')"
_RAW_ISSN_SQL = "(' ' || lpad(p_partkey::VARCHAR, 4, '0') || '-' || lpad(p_size::VARCHAR, 3, '0') || CASE WHEN p_size % 11 = 10 THEN 'x' ELSE '7' END || ' ')"


@query(
    "issn_norm",
    f"""SELECT p_partkey, regexp_replace(upper({_RAW_ISSN_SQL}), '[^0-9X]', '', 'g') AS key,
      regexp_replace({_RAW_ISSN_SQL}, '[^0-9]', '', 'g') AS digits FROM part""",
)
def issn_norm(spark, sf):
    raw = F.expr(_RAW_ISSN)
    return table(spark, sf, "part").select(
        "p_partkey", fn.issn_norm(raw).alias("key"), fn.issn_norm(raw, strict_x=False).alias("digits")
    )


@query(
    "issn_hyphen",
    """SELECT o_orderkey, CASE WHEN length(k) = 8 THEN substr(k, 1, 4) || '-' || substr(k, 5, 4) ELSE k END AS issn
       FROM (SELECT o_orderkey, (o_orderkey * 6367)::VARCHAR AS k FROM orders)""",
)
def issn_hyphen(spark, sf):
    k = (F.col("o_orderkey") * 6367).cast("string")
    return table(spark, sf, "orders").select("o_orderkey", fn.issn_hyphen(k).alias("issn"))


@query(
    "publisher_from_notes",
    f"""WITH {r.JOURNALS} SELECT entry_id, coalesce(list_filter(list_transform(string_split(notes, ';'), lambda s: trim(s)), lambda s: s <> '')[-1], '') AS publisher FROM journals""",
)
def publisher_from_notes(spark, sf):
    return r.journals(spark, sf).select("entry_id", fn.publisher_from_notes("notes").alias("publisher"))


@query("has_jcr_flag", f"WITH {r.JOURNALS} SELECT entry_id, contains(upper(notes), 'WOS/JCR')::INT AS has_jcr FROM journals")
def has_jcr_flag(spark, sf):
    return r.journals(spark, sf).select("entry_id", fn.has_jcr_flag("notes").cast("int").alias("has_jcr"))


@query(
    "display_fallback",
    f"""WITH {r.REGISTRY} SELECT row_pos, coalesce(nullif(openalex_source_id, ''), nullif(name, ''), short, '') AS shown FROM registry""",
)
def display_fallback(spark, sf):
    return r.registry(spark, sf).select(
        "row_pos", fn.display_fallback("openalex_source_id", "name", "short").alias("shown")
    )


_DISC = "CASE p_size % 8 WHEN 0 THEN 'Women''S Studies' WHEN 1 THEN ' area studies' WHEN 2 THEN 'Industrial Relations & Labor' WHEN 3 THEN 'SOCIOLOGY' WHEN 4 THEN 'Asian Studies' WHEN 5 THEN p_type WHEN 6 THEN 'Industrial Relations And Labor' ELSE p_name END"
_CANON = """CASE lower(trim({x})) WHEN 'women''s studies' THEN 'Women''s Studies' WHEN 'women studies' THEN 'Women''s Studies' WHEN 'area studies' THEN 'Area and Asian Studies'
  WHEN 'asian studies' THEN 'Area and Asian Studies' WHEN 'industrial relations & labor' THEN 'Industrial Relations and Labor'
  WHEN 'industrial relations and labor' THEN 'Industrial Relations and Labor' WHEN 'sociology' THEN 'Sociology' WHEN 'economics' THEN 'Economics'
  WHEN 'management' THEN 'Management' ELSE trim({x}) END"""


def canonical_sql(x: str) -> str:
    return _CANON.format(x=x)


@query("discipline_canonical", f"SELECT p_partkey, {canonical_sql(_DISC)} AS discipline FROM part")
def discipline_canonical(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.discipline_canonical(F.expr(_DISC)).alias("discipline"))


_DISC_Q = f"(({_DISC}) || ' ' || CASE WHEN p_size % 3 = 0 THEN 'q' ELSE 'Q' END || (1 + p_size % 5))"


@query(
    "strip_quartile_suffix",
    f"""SELECT p_partkey, {canonical_sql(f"regexp_replace(trim({_DISC_Q}), '(?i)[ ]+q[1-4]$', '')")} AS discipline FROM part""",
)
def strip_quartile_suffix(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.strip_quartile_suffix(F.expr(_DISC_Q)).alias("discipline"))


_COMPARE = "CASE WHEN p_size % 4 = 0 THEN 'Womens  studies' WHEN p_size % 4 = 1 THEN 'Area  AND Asian Studies ' ELSE concat(p_name, ' and ', p_type, ' and more') END"


@query(
    "discipline_compare_key",
    f"""SELECT p_partkey, trim(regexp_replace({sql_steps(_COMPARE, (r"(?i)\s+and\s+", " "), (r"\s+", " "))}, '(?i)women''?s?\\s*studies', 'Women Studies')) AS key FROM part""",
)
def discipline_compare_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.discipline_compare_key(F.expr(_COMPARE)).alias("key"))


_SLUGGED = "CASE WHEN p_size > 40 THEN '?!' ELSE concat(p_name, ' | ', p_type, ', & ', p_brand) END"


@query(
    "discipline_slug",
    f"""SELECT p_partkey, coalesce(nullif({sql_steps(_SLUGGED, (r"\s*[|,]\s*", "_"), (r"\s+", "_"), ("[^a-zA-Z0-9_]", ""), ("_+", "_"), ("^_|_$", ""))}, ''), 'Sociology') AS slug FROM part""",
)
def discipline_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.discipline_slug(F.expr(_SLUGGED)).alias("slug"))


_PREFIX = "concat('journals_ssci_', translate(p_name, ' ', '_'), '_', p_type, CASE WHEN p_size > 20 THEN '_Q1' ELSE '' END)"
_PREFIX_SQL = _PREFIX.replace("translate(p_name, ' ', '_')", "replace(p_name, ' ', '_')")
_WORDS = "array_to_string(list_transform(regexp_extract_all({x}, '[^A-Za-z0-9_]|[A-Za-z0-9_]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1]) || w[2:] ELSE w END), '')"


@query(
    "slug_to_display",
    "SELECT p_partkey, trim("
    + _WORDS.format(
        x=f"replace(regexp_replace(regexp_replace({_PREFIX_SQL}, '^journals_ssci_', ''), '(?i)_q1$', ''), '_', ' ')"
    )
    + ") AS name FROM part",
)
def slug_to_display(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.slug_to_display(F.expr(_PREFIX)).alias("name"))


_TOPIC = "CASE WHEN p_size = 13 THEN '??' ELSE concat(' ', p_name, '  ', p_type, '-', p_brand, '/x ') END"


@query(
    "topic_slug",
    f"""SELECT p_partkey, coalesce(nullif(replace({sql_steps(f"lower(trim({_TOPIC}))", (r"\s+", "_"), ("[^a-z0-9_/-]", ""))}, '-', '_'), ''), 'digital_labor') AS slug,
      {sql_steps(f"lower(trim({_TOPIC}))", (r"\s+", "_"), ("[^a-z0-9_-]", ""))} AS slug_hyphen FROM part""",
)
def topic_slug(spark, sf):
    t = F.expr(_TOPIC)
    return table(spark, sf, "part").select(
        "p_partkey", fn.topic_slug(t).alias("slug"), fn.topic_slug(t, keep_hyphen=True).alias("slug_hyphen")
    )


@query("name_norm", f"SELECT doc_id, md5({sql_squeeze('lower(text)')}) AS norm FROM documents")
def name_norm(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(fn.name_norm("text")).alias("norm"))


@query(
    "quartile_clean",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce(CASE WHEN l_linenumber BETWEEN 1 AND 4 THEN 'Q' || l_linenumber END, '-') AS q FROM lineitem""",
)
def quartile_clean(spark, sf):
    raw = F.concat(F.lit(" q"), F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        F.coalesce(fn.quartile_clean(raw), F.lit("-")).alias("q"),
    )


@query("title_case", "SELECT doc_id, md5(" + _WORDS.format(x="lower(text)") + ") AS title FROM documents")
def title_case(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(fn.title_case("text")).alias("title"))


@query(
    "index_letter",
    "SELECT doc_id, CASE WHEN regexp_matches(upper(text[1]), '[A-Z]') THEN upper(text[1]) ELSE '#' END AS letter FROM documents",
)
def index_letter(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", fn.index_letter("text").alias("letter"))


# --- files -------------------------------------------------------------------------

_FILE = "CASE event_id % 4 WHEN 0 THEN concat(event_type, '_latest.md') WHEN 1 THEN concat('note_', event_id, '.md') ELSE concat('papers_', event_type, '_', date_format(ts, 'yyyyMMdd'), '_v', 1 + event_id % 12, '.md') END"
_FILE_SQL = "CASE event_id % 4 WHEN 0 THEN event_type || '_latest.md' WHEN 1 THEN 'note_' || event_id || '.md' ELSE 'papers_' || event_type || '_' || strftime(ts, '%Y%m%d') || '_v' || (1 + event_id % 12) || '.md' END"


@query(
    "version_parse",
    f"""WITH f AS (SELECT event_id, {_FILE_SQL} AS n FROM events), p AS (SELECT event_id, regexp_extract(n, '^(.+?)_(\\d{{8}})_v(\\d+)\\.md$', ['p', 'd', 'v']) AS m FROM f)
    SELECT event_id, m.p AS prefix, m.d AS date_tag, coalesce(try_cast(m.v AS INT), 0) AS version FROM p""",
)
def version_parse(spark, sf):
    v = fn.version_parse(F.expr(_FILE))
    return table(spark, sf, "events").select(
        "event_id",
        F.coalesce(v["prefix"], F.lit("")).alias("prefix"),
        F.coalesce(v["date_tag"], F.lit("")).alias("date_tag"),
        F.coalesce(v["version"], F.lit(0)).alias("version"),
    )


_LABELLED = "CASE event_id % 6 WHEN 0 THEN 'papers_latest.md' WHEN 1 THEN concat(event_type, '_list_latest.md') WHEN 2 THEN concat('k_scan_', date_format(ts, 'yyyyMMdd'), '_v', event_id % 5, '.MD') WHEN 3 THEN concat(event_type, '_x_', date_format(ts, 'yyyyMMdd'), '_v', event_id % 5) WHEN 4 THEN 'meta_table_latest.md' ELSE concat('some_', event_type, '.md') END"


@query(
    "version_label",
    """WITH f AS (SELECT event_id, event_type, event_id % 6 AS c, strftime(ts, '%Y-%m-%d') AS d, event_id % 5 AS v FROM events)
    SELECT event_id, CASE c WHEN 0 THEN '论文列表（最新）' WHEN 1 THEN event_type || ' list（最新）' WHEN 2 THEN '聚类扫描 ' || d || ' v' || v
      WHEN 3 THEN event_type || ' x ' || d || ' v' || v WHEN 4 THEN '元数据表（最新）' ELSE 'some ' || event_type END AS label FROM f""",
)
def version_label(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.version_label(F.expr(_LABELLED)).alias("label"))


# --- link removal and Markdown to text ------------------------------------------------

_LINKED = "concat('[', source, '](http://e.org/', doc_id, ') doi: 10.1234/ab', doc_id, ' **bold** `code` ', text, ' https://x.org/', doc_id, '?q=1 ISSN 1234-5678 end')"


@query(
    "strip_links_basic",
    f"""SELECT doc_id, md5({sql_squeeze(sql_steps(sql_squeeze(_LINKED), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?i)https?://\S+", " "), (r"(?i)\b10\.\d{4,9}/\S+", " ")))}) AS core FROM documents""",
)
def strip_links_basic(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(fn.strip_links_basic(F.expr(_LINKED))).alias("core"))


_STRICT_SQL = sql_squeeze(
    sql_steps(
        "{x}",
        (r"(?i)https?://\S+", " "),
        (r"(?i)\b10\.\d{{4,9}}/\S+", " "),
        (r"(?i)\b(?:doi|openalex|link|url)\s*[:：]\s*\S+", " "),
        (r"(?i)\b(?:ISSN|ISBN|PMID)\s*\S*", " "),
    ).replace("{x}", "@X@")
).replace("{{", "{").replace("}}", "}")


def strict_sql(x: str) -> str:
    return _STRICT_SQL.replace("@X@", x)


@query("strip_links_strict", f"SELECT doc_id, md5({strict_sql(_LINKED)}) AS core FROM documents")
def strip_links_strict(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(fn.strip_links_strict(F.expr(_LINKED))).alias("core"))


_MD_STEPS = (
    (r"[*_]{1,3}([^*_]+)[*_]{1,3}", r"\1"),
    (r"`([^`]+)`", r"\1"),
)


@query(
    "md_cell_plain",
    f"""SELECT doc_id, md5({sql_steps(sql_trim(sql_steps(_LINKED, (r"\r?\n", " "))), (r"\[\]\(([^)]+)\)", r"\1 (\1)"), (r"\[([^\]]+)\]\(([^)]+)\)", r"\1 (\2)"), *_MD_STEPS)}) AS plain FROM documents""",
)
def md_cell_plain(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(fn.md_cell_plain(F.expr(_LINKED))).alias("plain"))


_PARA = "concat('## Head ', doc_id, '\\n- one [', source, '](u', doc_id, ')\\n  * two\\n', text)"
_PARA_SQL = "('## Head ' || doc_id || chr(10) || '- one [' || source || '](u' || doc_id || ')' || chr(10) || '  * two' || chr(10) || text)"


@query(
    "md_paragraph_plain",
    f"""SELECT doc_id, md5({sql_trim(sql_steps(_PARA_SQL, (r"(?m)^#{1,6}\s+", ""), (r"\[([^\]]+)\]\(([^)]+)\)", r"\1 (\2)"), *_MD_STEPS, (r"(?m)^\s*[-*+]\s+", "• ")))}) AS plain FROM documents""",
)
def md_paragraph_plain(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(fn.md_paragraph_plain(F.expr(_PARA))).alias("plain"))


_SHOWN = "concat(CASE WHEN doc_id % 2 = 0 THEN concat('```md\\n', source, '\\n```\\n') ELSE '' END, '**（一）主题（2-4句话）** 内容）1、', text, '（ [(Lee, 2020)](#paper-', doc_id, ')）')"


@query(
    "md_display_clean",
    """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) ELSE '' END || '**（一）主题** 内容）' || chr(10) || chr(10) || '1、' || text || '[(Lee, 2020)](#paper-' || doc_id || ')') AS shown FROM documents""",
)
def md_display_clean(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.md5(fn.md_display_clean(F.expr(_SHOWN))).alias("shown"))


_FENCED = "concat(source, CASE WHEN doc_id % 3 > 0 THEN concat('\\n```text\\n', text, CASE WHEN doc_id % 3 = 1 THEN '\\n``` tail' ELSE '' END) ELSE '' END)"


@query(
    "summary_fence",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN md5({sql_trim("text")}) ELSE '' END AS summary, CASE WHEN doc_id % 3 = 1 THEN source ELSE '' END AS head,
      CASE WHEN doc_id % 3 = 1 THEN 'tail' ELSE '' END AS rest FROM documents""",
)
def summary_fence(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", fn.summary_fence(F.expr(_FENCED)).alias("f"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return docs.select(
        "doc_id",
        F.when(F.col("f").isNotNull(), F.md5("f.summary")).otherwise("").alias("summary"),
        blank(F.col("f.before")).alias("head"),
        blank(F.col("f.after")).alias("rest"),
    )


# --- authors and references -------------------------------------------------------------


@query(
    "surnames",
    f"""WITH {r.PAPERS} SELECT id, CASE pos % 5 WHEN 0 THEN 'Lee' || pos WHEN 1 THEN 'Lee' || pos || '|Chan' || pos WHEN 2 THEN 'B' || pos || '|D|F' WHEN 3 THEN 'Last' || pos ELSE '' END AS names FROM papers""",
)
def surnames(spark, sf):
    return r.papers(spark, sf).select("id", F.array_join(fn.surnames("authors"), "|").alias("names"))


_IN_TEXT_SQL = """CASE pos % 5 WHEN 0 THEN '(Lee' || pos || ', ' || year || ')' WHEN 1 THEN '(Lee' || pos || ' & Chan' || pos || ', ' || year || ')'
  WHEN 2 THEN '(B' || pos || ' et al., ' || year || ')' WHEN 3 THEN '(Last' || pos || ', ' || year || ')' ELSE '(Unknown, ' || year || ')' END"""


@query("in_text_citation", f"WITH {r.PAPERS} SELECT id, {_IN_TEXT_SQL} AS in_text FROM papers")
def in_text_citation(spark, sf):
    return r.papers(spark, sf).select("id", fn.in_text_citation("authors", "year").alias("in_text"))


_URL_SQL = "CASE WHEN doi LIKE 'http%' THEN doi WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE openalex END"


@query("ref_url", f"WITH {r.PAPERS} SELECT id, {_URL_SQL} AS url FROM papers")
def ref_url(spark, sf):
    return r.papers(spark, sf).select("id", fn.ref_url("doi", "openalex").alias("url"))


_REF_CTE = f"""{r.PAPERS}, ref AS (SELECT *, coalesce(nullif(trim(authors), ''), 'Unknown') AS a, coalesce(nullif({sql_trim("title")}, ''), '（无标题）') AS t,
  CASE WHEN {_URL_SQL} <> '' THEN ' ' || {_URL_SQL} ELSE '' END AS tail FROM papers)"""


@query("ref_apa", f"WITH {_REF_CTE} SELECT id, md5(a || ' (' || year || '). ' || t || '. *' || journal || '*.' || tail) AS ref FROM ref")
def ref_apa(spark, sf):
    return r.papers(spark, sf).select("id", F.md5(fn.ref_apa()).alias("ref"))


@query(
    "ref_chicago",
    f"WITH {_REF_CTE} SELECT id, md5(a || '. \"' || t || '\". *' || journal || '* (' || year || ').' || tail) AS ref FROM ref",
)
def ref_chicago(spark, sf):
    return r.papers(spark, sf).select("id", F.md5(fn.ref_chicago()).alias("ref"))


_SOC_AUTHORS = "CASE doc_id % 5 WHEN 0 THEN concat('George Ritzer', doc_id, ' & Nathan Jurgenson') WHEN 1 THEN concat('Zhao', doc_id, ', Yizhang, Tianyu Qiao & Weidong Wang') WHEN 2 THEN concat('赵', doc_id) WHEN 3 THEN concat('Plato', doc_id) ELSE concat('Ann Lee', doc_id, ', Bo Chan') END"


@query(
    "ref_sociological",
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Ritzer' || doc_id || ', George & Nathan Jurgenson' WHEN 1 THEN 'Zhao' || doc_id || ', Yizhang, Tianyu Qiao & Weidong Wang'
       WHEN 2 THEN '赵' || doc_id WHEN 3 THEN 'Plato' || doc_id ELSE 'Lee' || doc_id || ', Ann & Bo Chan' END AS a,
       coalesce(nullif({sql_trim("split_part(text, chr(10), 1)")}, ''), '（无标题）') AS t, 2000 + doc_id % 25 AS y, source FROM documents)
    SELECT doc_id, md5(CASE WHEN doc_id % 5 = 2 THEN a || '，' || y || '，《' || t || '》，《' || source || '》。' ELSE a || '. ' || y || '. "' || t || '". *' || source || '*.' END) AS ref FROM d""",
)
def ref_sociological(spark, sf):
    blank = F.lit("")
    ref = fn.ref_sociological(
        authors=F.expr(_SOC_AUTHORS), year=F.expr("2000 + doc_id % 25"), title=F.split_part("text", F.lit("\n"), F.lit(1)), journal="source", doi=blank, openalex=blank
    )
    return texts(spark, sf, "documents").select("doc_id", F.md5(ref).alias("ref"))


# --- logs ----------------------------------------------------------------------------


@query("beijing_minute", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y/%m/%d %H:%M') AS shown FROM events")
def beijing_minute(spark, sf):
    return table(spark, sf, "events").select("event_id", fn.beijing_minute("ts").alias("shown"))


_LOG = "concat(text, CASE conv_id % 3 WHEN 0 THEN concat('\\nx [FAILURE_REASON]  turn ', turn, ' \\nmore') WHEN 1 THEN '\\n[FAILURE_REASON]  \\n[FAILURE_REASON] no' ELSE '' END)"


@query(
    "failure_reason",
    """SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'turn ' || turn ELSE '综述生成未完成，可能因接口超时或服务异常。建议稍后重试，或查看运行日志了解详情。' END AS reason FROM conversations""",
)
def failure_reason(spark, sf):
    return texts(spark, sf, "conversations").select("conv_id", "turn", fn.failure_reason(F.expr(_LOG)).alias("reason"))


@query(
    "line_count",
    f"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split({sql_trim('text')}, chr(10))) END AS n FROM documents",
)
def line_count(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", fn.line_count("text").cast("bigint").alias("n"))


_QA = "concat('# QA\\n', text, CASE WHEN doc_id % 4 > 0 THEN concat('\\n- total: ', n_chars) ELSE '' END, '\\n- out_of_scope_candidates:  ', doc_id * 5, '\\n')"


@query(
    "qa_counts_parse",
    """SELECT doc_id, total, doc_id * 5 AS out_of_scope, greatest(0, total - doc_id * 5) AS in_scope FROM (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN n_chars ELSE 0 END AS total FROM documents)""",
)
def qa_counts_parse(spark, sf):
    q = texts(spark, sf, "documents").select("doc_id", fn.qa_counts_parse(F.expr(_QA)).alias("q"))
    return q.select(
        "doc_id",
        *[F.col(f"q.{c}").cast("bigint").alias(c) for c in ("total", "out_of_scope", "in_scope")],
    )


# --- theme titles (P34) ------------------------------------------------------------------


def overview_docs(spark, sf):
    """One overview table of two themes and two sections per order."""
    return texts(spark, sf, "orders").selectExpr(
        "o_orderkey AS doc",
        "concat('### 主题总览\\n\\n| 序号 | 主题 |\\n| --- | --- |\\n| 1 | ', o_orderpriority, ' |\\n| 2 | ', o_orderstatus, ' |\\n| x | other |\\n') AS intro",
        "concat('intro ', o_orderkey, '\\n## 一、 Customers ', o_custkey, '\\nfirst body\\n## 二、Status\\n', o_orderstatus, '\\n') AS body",
    )


def overview_rows(spark, sf):
    rows = md.explode_md_tables(overview_docs(spark, sf), "doc", "intro").where(F.col("row_no") > 0)
    return rows.select(
        "doc",
        F.get("cells", F.lit(0)).try_cast("int").alias("number"),
        F.get("cells", F.lit(0)).alias("mark"),
        F.get("cells", F.lit(1)).alias("theme"),
    )


@query(
    "section_title_merge",
    """SELECT o_orderkey AS doc, '1' AS mark, '一、Customers ' || o_custkey || '（' || o_orderpriority || '）' AS theme FROM orders
       UNION ALL SELECT o_orderkey, '2', '二、Status（' || o_orderstatus || '）' FROM orders
       UNION ALL SELECT o_orderkey, 'x', 'other' FROM orders""",
)
def section_title_merge(spark, sf):
    sections = md.explode_report_sections(overview_docs(spark, sf))
    return merge_section_titles(overview_rows(spark, sf), sections).select("doc", "mark", "theme")


# --- predicates (F7-F9, F11, F12) -----------------------------------------------------------

_ABSTRACT = "CASE doc_id % 9 WHEN 0 THEN 'N/A.' WHEN 1 THEN concat('See the link ', text) WHEN 2 THEN concat('https://x.org/', doc_id, ' 10.1234/x', doc_id) WHEN 3 THEN 'abstract see: below and more of it here' WHEN 4 THEN 'No abstract' WHEN 5 THEN concat('doi: 10.1/', source, ' short text ISSN 1') ELSE text END"


def missing_sql(x: str, raw: bool) -> str:
    t = sql_trim(x)
    words = "no usable abstract|n/a|none|unknown" + ("|no abstract" if raw else "")
    core = (
        sql_squeeze(sql_steps(sql_squeeze(t), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?i)https?://\S+", " "), (r"(?i)\b10\.\d{4,9}/\S+", " ")))
        if raw
        else strict_sql(t)
    )
    short = "" if raw else f" OR length({t}) < 20"
    return f"""({t} = '' OR regexp_matches({t}, '(?i)^({words})\\.?$') OR regexp_matches({t}, '(?i)^see (the )?(abstract|link|url|paper)')
      OR regexp_matches({t}, '(?i)^(abstract )?see:') OR length({core}) < {25 if raw else 30}{short})"""


@query("abstract_missing_raw", f"SELECT doc_id, {missing_sql(_ABSTRACT, True)}::INT AS missing FROM documents")
def abstract_missing_raw(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", fn.abstract_missing_raw(F.expr(_ABSTRACT)).cast("int").alias("missing")
    )


@query("abstract_missing_summary", f"SELECT doc_id, {missing_sql(_ABSTRACT, False)}::INT AS missing FROM documents")
def abstract_missing_summary(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", fn.abstract_missing_summary(F.expr(_ABSTRACT)).cast("int").alias("missing")
    )


@query(
    "manual_flag",
    f"""SELECT doc_id, (doc_id % 3 = 0)::INT AS is_manual, md5({sql_trim("text")}) AS clean FROM documents""",
)
def manual_flag(spark, sf):
    block = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(text, ' [Manual]\\n') ELSE text END")
    return texts(spark, sf, "documents").select(
        "doc_id", fn.manual_flag(block).cast("int").alias("is_manual"), F.md5(fn.drop_manual_mark(block)).alias("clean")
    )


_SLUG = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN repeat('a', cast(n_chars AS INT)) WHEN doc_id % 5 = 2 THEN concat(lang, '/', source) WHEN doc_id % 5 = 3 THEN text ELSE concat('topic_', doc_id, '-x') END"


@query(
    "topic_valid",
    f"SELECT doc_id, (regexp_matches(s, '^[a-z0-9_/-]+$') AND length(s) BETWEEN 1 AND 120)::INT AS valid FROM (SELECT doc_id, {_SLUG} AS s FROM documents)",
)
def topic_valid(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", fn.topic_valid(F.expr(_SLUG)).cast("int").alias("valid"))


@query(
    "topic_routes",
    f"""SELECT coalesce(reason, 'good') AS reason, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN length(s) > 120 THEN 'too long'
      WHEN NOT regexp_matches(s, '^[a-z0-9_/-]+$') THEN 'bad characters' END AS reason FROM (SELECT doc_id, {_SLUG} AS s FROM documents)) GROUP BY 1""",
)
def topic_routes(spark, sf):
    """Both frames of the routing operator, counted by reason."""
    rows = texts(spark, sf, "documents").select("doc_id", F.expr(_SLUG).alias("topic"))
    good, rejected = route(rows, topic_checks("topic"))
    both = good.select("doc_id", F.lit("good").alias("reason")).unionByName(rejected.select("doc_id", "reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "term_non_english",
    f"""SELECT doc_id, ({sql_trim("t")} <> '' AND regexp_matches(t, '[^a-zA-Z0-9\\s\\x0b_\\-]'))::INT AS flagged FROM (SELECT doc_id, replace(replace(text, '.', ''), ',', '') AS t FROM documents)""",
)
def term_non_english(spark, sf):
    t = F.expr("replace(replace(text, '.', ''), ',', '')")
    return texts(spark, sf, "documents").select("doc_id", fn.term_non_english(t).cast("int").alias("flagged"))


__all__ = ["WS", "canonical_sql", "missing_sql", "overview_docs", "overview_rows"]
