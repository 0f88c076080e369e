"""Catalogue operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark import functions as fn
from shelfspark.operators import catalogue as cat
from shelfspark.plans import catalogue as flows
from shelfspark.plans import roles as r
from shelfspark.plans.registry import query
from shelfspark.plans.roles import table, texts
from shelfspark.plans.scalars import canonical_sql
from shelfspark.session import written

_IDX = f"{r.METRICS}, {r.metric_index_sql()}"
_DETAIL = ["jif", "jci", "oa_citable_pct", "total_citations", "jcr_abbrev"]


def _blank(*cols):
    """NULL as '-' so that both engines print it alike."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in cols]


def _blank_sql(*cols, prefix=""):
    return ", ".join(f"coalesce({prefix}{c}::VARCHAR, '-') AS {c}" for c in cols)


def index(spark, sf):
    return cat.metric_index(r.metrics(spark, sf), line_cols=list(r.LINE_WIDTHS.items()))


def looked_up(spark, sf):
    """The index as a written table, one narrow row a key: lookups ask it twice."""
    return written(index(spark, sf), "metric-index")


# --- filters ------------------------------------------------------------------------


@query(
    "filter_discipline",
    f"""WITH {r.JOURNALS} SELECT 'Psychology' AS discipline, entry_id FROM journals WHERE list_contains(categories, 'Psychology, Social')
     UNION ALL SELECT 'Area and Asian Studies', entry_id FROM journals WHERE list_contains(categories, 'Area Studies')
     UNION ALL SELECT 'management', entry_id FROM journals WHERE list_contains(categories, 'Management Q1')""",
)
def filter_discipline(spark, sf):
    j = r.journals(spark, sf)
    parts = [
        cat.filter_discipline(j, d).select(F.lit(d).alias("discipline"), "entry_id")
        for d in ("Psychology", "Area and Asian Studies", "management")
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("filter_quartile", f"WITH {_IDX} SELECT issn_key, jci FROM idx WHERE quartile = 'Q2'")
def filter_quartile(spark, sf):
    return cat.filter_quartile(index(spark, sf), "Q2").select("issn_key", "jci")


@query("filter_publisher", f"WITH {r.JOURNALS} SELECT entry_id, title FROM journals WHERE publisher = 'Brand#17'")
def filter_publisher(spark, sf):
    return cat.filter_publisher(r.journals(spark, sf), "Brand#17").select("entry_id", "title")


@query("filter_jcr_only", f"WITH {r.JOURNALS} SELECT entry_id FROM journals WHERE size > 10")
def filter_jcr_only(spark, sf):
    return cat.filter_jcr_only(r.journals(spark, sf)).select("entry_id")


@query(
    "filter_edition",
    f"WITH {r.METRICS} SELECT file_name, count(*) AS n, sum(l_orderkey)::BIGINT AS orders FROM jcr WHERE edition = 'SSCI' GROUP BY 1",
)
def filter_edition(spark, sf):
    kept = cat.filter_edition(r.metrics(spark, sf))
    return kept.groupBy("file_name").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


@query("filter_title_contains", "SELECT p_partkey AS entry_id FROM part WHERE contains(lower(p_name), 'red w')")
def filter_title_contains(spark, sf):
    return cat.filter_title_contains(r.journals(spark, sf), " Red W").select("entry_id")


@query("multi_category", "SELECT p_partkey AS entry_id FROM part WHERE p_size > 25")
def multi_category(spark, sf):
    return cat.multi_category(r.journals(spark, sf)).select("entry_id")


# --- registry inputs -------------------------------------------------------------------

_LABEL = "CASE WHEN s_acctbal > 0 THEN 'sources/q1' ELSE 'manual' END AS label"
_FILE = "concat('refs/journals_ssci_', CASE s_nationkey % 5 WHEN 0 THEN 'women_studies' WHEN 1 THEN 'area_studies' WHEN 2 THEN 'area_asian_studies' WHEN 3 THEN 'urban_studies' ELSE concat('nation_', s_nationkey) END, '_q1_2026', lpad(1 + s_suppkey % 12, 2, '0'), '15_v', 1 + s_suppkey % 3, CASE WHEN s_suppkey % 11 = 3 THEN '.txt' ELSE '.yml' END) AS file"
_INPUTS_SQL = f"""inputs AS (SELECT s_suppkey AS pos, s_suppkey // 8 AS registry_id, s_suppkey % 4 AS count, {_LABEL},
   CASE s_nationkey % 5 WHEN 0 THEN 'women_studies' WHEN 1 THEN 'area_studies' WHEN 2 THEN 'area_asian_studies' WHEN 3 THEN 'urban_studies' ELSE 'nation_' || s_nationkey END AS stem FROM supplier),
 valid AS (SELECT *, 'journals_ssci_' || stem || '_q1' AS prefix,
   CASE stem WHEN 'women_studies' THEN 'Women''s Studies' WHEN 'area_studies' THEN 'Area and Asian Studies' WHEN 'area_asian_studies' THEN 'Area and Asian Studies'
     WHEN 'urban_studies' THEN 'Urban Studies' ELSE 'Nation ' || stem[8:] END AS discipline FROM inputs WHERE count > 0 AND label LIKE '%sources%' AND pos % 11 <> 3)"""


def registry_inputs(spark, sf):
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS pos", "cast(s_suppkey DIV 8 AS INT) AS registry_id", "s_suppkey % 4 AS count", _LABEL, _FILE
    )


@query("registry_inputs_valid", f"WITH {_INPUTS_SQL} SELECT pos, prefix FROM valid")
def registry_inputs_valid(spark, sf):
    return cat.registry_inputs_valid(registry_inputs(spark, sf)).select("pos", "prefix")


@query(
    "fanout_registry_inputs",
    f"WITH {_INPUTS_SQL} SELECT registry_id, discipline, arg_min(prefix, pos) AS prefix FROM valid GROUP BY 1, 2",
)
def fanout_registry_inputs(spark, sf):
    # a registry's eight inputs are its own array, as in its meta block
    rows = registry_inputs(spark, sf).groupBy("registry_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "label", "file", "count"))).alias("listed")
    )
    meta = rows.select(
        "registry_id",
        F.transform("listed", lambda i: F.struct(i["label"].alias("label"), i["file"].alias("file"), i["count"].alias("count"))).alias("inputs"),
    )
    return cat.fanout_registry_inputs(meta, keys=["registry_id"]).select("registry_id", "discipline", "prefix")


@query(
    "preferred_prefix",
    f"""WITH {_INPUTS_SQL} SELECT discipline, prefix FROM (SELECT discipline, prefix, row_number() OVER (PARTITION BY discipline ORDER BY (prefix NOT IN ('journals_ssci_area_asian_studies_q1','journals_ssci_urban_studies_q1','journals_ssci_women_studies_q1'))::INT, pos) AS rn FROM valid) WHERE rn = 1""",
)
def preferred_prefix(spark, sf):
    valid = cat.registry_inputs_valid(registry_inputs(spark, sf)).select("prefix", "pos")
    return cat.preferred_prefix(valid).select("discipline", "prefix")


# --- scope --------------------------------------------------------------------------------


@query(
    "search_scope_by_ids",
    f"""WITH {r.REGISTRY} SELECT row_pos, openalex_source_id FROM registry WHERE openalex_source_id <> ''
      AND openalex_source_id IN (SELECT 'W' || c_nationkey || '-' || (c_custkey % 5) FROM customer)""",
)
def search_scope_by_ids(spark, sf):
    ids = table(spark, sf, "customer").selectExpr("concat('W', c_nationkey, '-', c_custkey % 5) AS source_id")
    return cat.search_scope_by_ids(r.registry(spark, sf), ids).select("row_pos", "openalex_source_id")


_WANTED = "CASE WHEN p_size > 40 THEN concat('9', lpad(p_partkey, 7, '0')) WHEN p_size > 30 THEN lpad(p_partkey, 8, '0') ELSE '123' END"
_WANTED_SQL = "CASE WHEN p_size > 40 THEN '9' || lpad(p_partkey::VARCHAR, 7, '0') WHEN p_size > 30 THEN lpad(p_partkey::VARCHAR, 8, '0') ELSE '123' END"


def requested_issns(spark, sf):
    return table(spark, sf, "part").selectExpr(f"{_WANTED} AS issn")


@query(
    "search_scope_by_issns",
    f"""WITH {r.REGISTRY}, wanted AS (SELECT {_WANTED_SQL} AS k FROM part) SELECT row_pos FROM registry
      WHERE openalex_source_id <> '' AND (issn IN (SELECT k FROM wanted WHERE length(k) >= 8) OR eissn IN (SELECT k FROM wanted WHERE length(k) >= 8))""",
)
def search_scope_by_issns(spark, sf):
    return cat.search_scope_by_issns(r.registry(spark, sf), requested_issns(spark, sf)).select("row_pos")


@query(
    "anti_missing_issn",
    f"""WITH {r.REGISTRY}, wanted AS (SELECT DISTINCT {_WANTED_SQL} AS issn_key FROM part) SELECT issn_key FROM wanted
      WHERE issn_key NOT IN (SELECT issn FROM registry UNION SELECT eissn FROM registry)""",
)
def anti_missing_issn(spark, sf):
    wanted = requested_issns(spark, sf).select(F.col("issn").alias("issn_key")).distinct()
    return cat.anti_missing_issn(wanted, r.registry(spark, sf))


# --- metric index and lookups -------------------------------------------------------------------


@query("metric_index", f"WITH {_IDX} SELECT issn_key, {_blank_sql('quartile', 'quartile_raw', *_DETAIL)} FROM idx")
def metric_index(spark, sf):
    # the raw quartile keeps its case and loses its blanks, as every detail does
    return index(spark, sf).select("issn_key", *_blank("quartile", "quartile_raw", *_DETAIL))


_ENRICHED = f"""{r.JOURNALS}, {_IDX}, enriched AS (SELECT j.*, coalesce(p.quartile, e.quartile) AS quartile,
  {", ".join(f"CASE WHEN p.issn_key IS NOT NULL THEN p.{c} ELSE e.{c} END AS {c}" for c in _DETAIL)}
  FROM journals j LEFT JOIN idx p ON p.issn_key = j.pkey LEFT JOIN idx e ON e.issn_key = j.eissn)"""


@query("enrich_two_key", f"WITH {_ENRICHED} SELECT entry_id, {_blank_sql('quartile', *_DETAIL)} FROM enriched")
def enrich_two_key(spark, sf):
    return cat.enrich_two_key(r.journals(spark, sf), looked_up(spark, sf)).select("entry_id", *_blank("quartile", *_DETAIL))


@query(
    "catalogue_flow",
    f"""WITH {_ENRICHED} SELECT entry_id, title, publisher, quartile, {_blank_sql(*_DETAIL)} FROM enriched
      WHERE quartile = 'Q1' AND list_contains(categories, 'Psychology, Social')""",
)
def catalogue_flow(spark, sf):
    df = flows.journal_catalogue(r.journals(spark, sf), looked_up(spark, sf), discipline="Psychology", quartile="Q1")
    return df.select("entry_id", "title", "publisher", "quartile", *_blank(*_DETAIL))


_RKEYS = """rkeys AS (SELECT 'issn' AS kind, issn AS k, * FROM registry UNION ALL SELECT 'eissn', eissn, * FROM registry UNION ALL SELECT 'name', lower(name), * FROM registry)"""


@query(
    "resolve_record",
    f"""WITH {r.REGISTRY}, {r.ENTRIES}, {_RKEYS}, c AS (
      SELECT entry_id, 0 AS prio, 'issn' AS kind, issn AS k FROM entries UNION ALL SELECT entry_id, 1, 'eissn', eissn FROM entries UNION ALL SELECT entry_id, 2, 'name', name_key FROM entries),
    h AS (SELECT entry_id, prio, short, row_number() OVER (PARTITION BY entry_id ORDER BY prio) AS rn FROM c JOIN rkeys USING (kind, k) WHERE k <> '')
    SELECT entry_id, coalesce(prio, -1) AS matched_by, coalesce(short, '-') AS short FROM entries LEFT JOIN (SELECT * FROM h WHERE rn = 1) USING (entry_id)""",
)
def resolve_record(spark, sf):
    out = cat.resolve_record(r.list_entries(spark, sf), r.registry(spark, sf))
    return out.select("entry_id", F.coalesce("matched_by", F.lit(-1)).alias("matched_by"), F.coalesce("resolved.short", F.lit("-")).alias("short"))


@query(
    "resolve_cross_key",
    f"""WITH {r.REGISTRY}, {_RKEYS}, x AS (SELECT p_partkey AS entry_id, CASE WHEN p_size % 2 = 0 THEN '9' || lpad((p_partkey % 150)::VARCHAR, 7, '0') ELSE lpad(p_partkey::VARCHAR, 8, '0') END AS a,
       CASE WHEN p_size % 2 = 0 THEN lpad(p_partkey::VARCHAR, 8, '0') ELSE '9' || lpad((p_partkey % 150)::VARCHAR, 7, '0') END AS b FROM part),
    c AS (SELECT entry_id, 0 AS prio, 'issn' AS kind, a AS k FROM x UNION ALL SELECT entry_id, 1, 'eissn', b FROM x UNION ALL SELECT entry_id, 2, 'eissn', a FROM x UNION ALL SELECT entry_id, 3, 'issn', b FROM x),
    h AS (SELECT entry_id, prio, short, row_number() OVER (PARTITION BY entry_id ORDER BY prio) AS rn FROM c JOIN rkeys USING (kind, k))
    SELECT entry_id, coalesce(prio, -1) AS matched_by, coalesce(short, '-') AS short FROM x LEFT JOIN (SELECT * FROM h WHERE rn = 1) USING (entry_id)""",
)
def resolve_cross_key(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey AS entry_id",
        "CASE WHEN p_size % 2 = 0 THEN concat('9', lpad(p_partkey % 150, 7, '0')) ELSE lpad(p_partkey, 8, '0') END AS issn",
        "CASE WHEN p_size % 2 = 0 THEN lpad(p_partkey, 8, '0') ELSE concat('9', lpad(p_partkey % 150, 7, '0')) END AS eissn",
    )
    out = cat.resolve_cross_key(rows, r.registry(spark, sf))
    return out.select("entry_id", F.coalesce("matched_by", F.lit(-1)).alias("matched_by"), F.coalesce("resolved.short", F.lit("-")).alias("short"))


_OVERRIDE = f"""{r.JOURNALS}, {r.REGISTRY}, sc AS (SELECT k, arg_max(source_categories, row_pos) AS c FROM (
    SELECT issn AS k, * FROM registry UNION ALL SELECT eissn, * FROM registry) WHERE len(source_categories) > 0 GROUP BY k)"""


@query(
    "category_override",
    f"""WITH {_OVERRIDE} SELECT entry_id, array_to_string(coalesce(p.c, e.c, categories), '|') AS categories FROM journals LEFT JOIN sc p ON p.k = pkey LEFT JOIN sc e ON e.k = eissn""",
)
def category_override(spark, sf):
    out = cat.category_override(r.journals(spark, sf), r.registry(spark, sf))
    return out.select("entry_id", F.array_join("categories", "|").alias("categories"))


@query(
    "overlay_nonnull",
    f"""WITH {r.ENTRIES}, {_IDX}, o AS (SELECT entry_id, name, issn, eissn, CASE WHEN size % 2 = 0 THEN 'Q9' END AS quartile, size::VARCHAR AS jif FROM entries)
    SELECT entry_id, name AS title, 'Sociology|Economics' AS categories, coalesce(CASE WHEN p.issn_key IS NOT NULL THEN p.quartile_raw ELSE e.quartile_raw END, o.quartile, '-') AS quartile,
      coalesce(CASE WHEN p.issn_key IS NOT NULL THEN p.jif ELSE e.jif END, o.jif, '-') AS jif,
      coalesce(CASE WHEN p.issn_key IS NOT NULL THEN p.jci ELSE e.jci END, '-') AS jci
    FROM o LEFT JOIN idx p ON p.issn_key = o.issn LEFT JOIN idx e ON e.issn_key = o.eissn""",
)
def overlay_nonnull(spark, sf):
    entries = r.list_entries(spark, sf).selectExpr(
        "entry_id", "name", "issn", "eissn", "CASE WHEN size % 2 = 0 THEN 'Q9' END AS quartile", "cast(size AS STRING) AS jif"
    )
    out = cat.overlay_nonnull(entries, looked_up(spark, sf), ["Sociology", "Economics"])
    return out.select("entry_id", "title", F.array_join("categories", "|").alias("categories"), *_blank("quartile", "jif", "jci"))


_DISC_RESOLVED = f"""{r.REGISTRY}, {r.ENTRIES}, {_RKEYS}, {_IDX}, c AS (
      SELECT entry_id, 0 AS prio, 'issn' AS kind, issn AS k FROM entries UNION ALL SELECT entry_id, 1, 'eissn', eissn FROM entries UNION ALL SELECT entry_id, 2, 'name', name_key FROM entries),
    h AS (SELECT c.entry_id, rk.name AS rname, rk.issn AS rissn, rk.eissn AS reissn, rk.openalex_source_id AS oid, rk.source_categories AS sc, row_number() OVER (PARTITION BY c.entry_id ORDER BY prio) AS rn
       FROM c JOIN rkeys rk ON rk.kind = c.kind AND rk.k = c.k WHERE c.k <> ''),
    m AS (SELECT e.entry_id, e.size % 7 AS disc_pos, CASE WHEN h.entry_id IS NULL THEN e.name ELSE rname END AS name, CASE WHEN h.entry_id IS NULL THEN e.name_key ELSE lower(rname) END AS nk,
       CASE WHEN h.entry_id IS NULL THEN e.issn ELSE rissn END AS issn, CASE WHEN h.entry_id IS NULL THEN e.eissn ELSE reissn END AS eissn, coalesce(oid, '') AS oid, sc
       FROM entries e LEFT JOIN (SELECT * FROM h WHERE rn = 1) h USING (entry_id)),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('id:' || nullif(oid, ''), 'issn:' || nullif(issn, ''), 'eissn:' || nullif(eissn, ''), 'name:' || nk) ORDER BY disc_pos, entry_id) AS rn FROM m) WHERE rn = 1)"""


@query(
    "discipline_flow",
    f"""WITH {_DISC_RESOLVED} SELECT u.entry_id, u.name AS title, CASE WHEN len(sc) > 0 THEN array_to_string(sc, '|') ELSE 'Sociology' END AS categories,
      coalesce(CASE WHEN p.issn_key IS NOT NULL THEN p.quartile_raw ELSE e.quartile_raw END, '-') AS quartile
    FROM u LEFT JOIN idx p ON p.issn_key = u.issn LEFT JOIN idx e ON e.issn_key = u.eissn""",
)
def discipline_flow(spark, sf):
    entries = r.list_entries(spark, sf).withColumn("disc_pos", F.col("size") % 7).withColumn("row_pos", F.col("entry_id"))
    out = flows.journals_of_disciplines(entries, r.registry(spark, sf), looked_up(spark, sf), ["Sociology"])
    return out.select("entry_id", "title", F.array_join("categories", "|").alias("categories"), *_blank("quartile"))


# --- facets, groups, sets -----------------------------------------------------------------------


@query("facet_publishers", "SELECT DISTINCT p_brand AS publisher FROM part")
def facet_publishers(spark, sf):
    return cat.facet_publishers(r.journals(spark, sf))


_FACET = """SELECT DISTINCT CASE d WHEN 'Women Studies' THEN 'Women''s Studies' WHEN 'Area Studies' THEN 'Area and Asian Studies' WHEN 'Asian Studies' THEN 'Area and Asian Studies'
   WHEN 'Industrial Relations & Labor' THEN 'Industrial Relations and Labor' ELSE d END AS discipline
   FROM (SELECT unnest(categories) AS d FROM journals UNION SELECT CASE WHEN l_linestatus = 'O' THEN 'Asian Studies' ELSE 'Urban ' || l_returnflag END FROM lineitem)"""


def _file_disciplines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_linestatus = 'O' THEN 'Asian_Studies' ELSE concat('Urban_', l_returnflag) END AS file_discipline"
    ).distinct()


@query("facet_disciplines", f"WITH {r.JOURNALS} {_FACET}")
def facet_disciplines(spark, sf):
    return cat.facet_disciplines(r.journals(spark, sf), _file_disciplines(spark, sf))


@query(
    "facet_ordered_canonical",
    f"""WITH {r.JOURNALS}, f AS ({_FACET}) SELECT discipline, CASE discipline WHEN 'Area and Asian Studies' THEN 1 WHEN 'Economics' THEN 4 WHEN 'Industrial Relations and Labor' THEN 6 ELSE 13 END AS ord
      FROM f WHERE discipline IN ('Area and Asian Studies', 'Economics', 'Industrial Relations and Labor', 'Women''s Studies')""",
)
def facet_ordered_canonical(spark, sf):
    return cat.facet_ordered_canonical(cat.facet_disciplines(r.journals(spark, sf), _file_disciplines(spark, sf)))


@query(
    "dedupe_catalogue",
    f"""WITH {r.ENTRIES}, t AS (SELECT entry_id, size % 7 AS disc_pos, size % 4 AS q_pos, coalesce('id:' || nullif(CASE WHEN size < 10 THEN 'W' || (entry_id % 37) ELSE '' END, ''), 'issn:' || nullif(issn, ''), 'eissn:' || nullif(eissn, ''), 'name:' || name_key) AS k FROM entries)
     SELECT entry_id FROM (SELECT entry_id, row_number() OVER (PARTITION BY k ORDER BY disc_pos, q_pos, entry_id) AS rn FROM t) WHERE rn = 1""",
)
def dedupe_catalogue(spark, sf):
    e = r.list_entries(spark, sf).selectExpr(
        "*",
        "size % 7 AS disc_pos",
        "size % 4 AS q_pos",
        "entry_id AS row_pos",
        "CASE WHEN size < 10 THEN concat('W', entry_id % 37) ELSE '' END AS openalex_source_id",
    )
    return cat.dedupe_catalogue(e).select("entry_id")


@query(
    "letter_groups",
    "SELECT CASE WHEN regexp_matches(upper(text[1]), '[A-Z]') THEN upper(text[1]) ELSE '#' END AS letter, count(*) AS n, (NOT regexp_matches(upper(text[1]), '[A-Z]'))::INT AS is_other FROM documents GROUP BY 1, 3",
)
def letter_groups(spark, sf):
    return cat.letter_groups(texts(spark, sf, "documents"), "text")


@query(
    "topic_union_labels",
    """SELECT topic, coalesce(max(label) FILTER (p = 1), max(label) FILTER (p = 0)) AS label FROM (
        SELECT 'topic_' || (n_nationkey % 20) AS topic, 'preset ' || (n_nationkey % 20) AS label, 0 AS p FROM nation
        UNION ALL SELECT DISTINCT 'topic_' || c_nationkey, c_mktsegment, 1 FROM customer) GROUP BY topic""",
)
def topic_union_labels(spark, sf):
    presets = table(spark, sf, "nation").selectExpr("concat('topic_', n_nationkey % 20) AS topic", "concat('preset ', n_nationkey % 20) AS label").distinct()
    found = (
        table(spark, sf, "customer").selectExpr("concat('topic_', c_nationkey) AS topic", "c_mktsegment AS label")
    )
    return cat.topic_union_labels(presets, found)


@query("union_key_pairs", f"WITH {r.JOURNALS} SELECT pkey AS issn_key FROM journals UNION SELECT eissn FROM journals")
def union_key_pairs(spark, sf):
    return cat.union_key_pairs(r.journals(spark, sf))


@query(
    "source_fallback",
    "SELECT p_partkey AS id, p_name AS name FROM part",
)
def source_fallback(spark, sf):
    none = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name").where("name = 'no such name'")
    parts = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name")
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    return cat.source_fallback(none, parts, customers)


# --- newest of a group -----------------------------------------------------------------------------

_VERSIONS_SQL = """versions AS (SELECT event_type AS prefix, strftime(ts, '%Y%m%d') AS date_tag, 1 + event_id % 13 AS version, event_id, ts AS mtime,
   event_type || '_' || strftime(ts, '%Y%m%d') || '_v' || (1 + event_id % 13) || '.yml' AS name FROM events)"""


def versions(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_type AS prefix",
        "date_format(ts, 'yyyyMMdd') AS date_tag",
        "1 + event_id % 13 AS version",
        "event_id",
        "ts AS mtime",
        "concat(event_type, '_', date_format(ts, 'yyyyMMdd'), '_v', 1 + event_id % 13, '.yml') AS name",
    )


@query(
    "latest_per_prefix",
    f"WITH {_VERSIONS_SQL} SELECT prefix, max(date_tag) AS date_tag, arg_max(version, (date_tag, version)) AS version FROM versions GROUP BY prefix",
)
def latest_per_prefix(spark, sf):
    return cat.latest_per_prefix(versions(spark, sf)).select("prefix", "date_tag", "version")


@query(
    "latest_per_slug",
    """SELECT slug, file_date, file_name FROM (SELECT slug, file_date, file_name, row_number() OVER (PARTITION BY slug ORDER BY file_date DESC, file_name) AS rn FROM (
       SELECT event_type || '_' || (user_id % 30) AS slug, strftime(ts, '%y%m%d') AS file_date, 'WOS_' || event_id || '.csv' AS file_name FROM events)) WHERE rn = 1""",
)
def latest_per_slug(spark, sf):
    files = table(spark, sf, "events").selectExpr(
        "concat(event_type, '_', user_id % 30) AS slug", "date_format(ts, 'yyMMdd') AS file_date", "concat('WOS_', event_id, '.csv') AS file_name"
    )
    return cat.latest_per_slug(files)


@query(
    "latest_by_mtime_with_fallback",
    """WITH files AS (SELECT event_id, ts, CASE user_id % 9 WHEN 0 THEN 'women_studies' WHEN 1 THEN 'Asian_Studies' WHEN 2 THEN 'Area_Studies' WHEN 3 THEN 'Industrial_Relations_Labor' WHEN 4 THEN 'Sociology' ELSE 'other_' || event_type END AS slug FROM events),
     cand AS (SELECT * FROM (VALUES ('Women''s Studies', 0, 'women_studies'), ('Area and Asian Studies', 0, 'area_and_asian_studies'), ('Area and Asian Studies', 1, 'area_studies'), ('Area and Asian Studies', 2, 'asian_studies'),
        ('Industrial Relations and Labor', 0, 'industrial_relations_and_labor'), ('Industrial Relations and Labor', 1, 'industrial_relations_labor'), ('Sociology', 0, 'sociology')) t(discipline, prio, k)),
     wanted AS (SELECT DISTINCT discipline FROM (SELECT CASE p_type WHEN 'MEDIUM' THEN 'Women''s Studies' WHEN 'LARGE' THEN 'Area and Asian Studies' WHEN 'PROMO' THEN 'Industrial Relations and Labor' WHEN 'STANDARD' THEN 'Sociology' END AS discipline FROM part) WHERE discipline IS NOT NULL)
     SELECT discipline, 'f' || event_id AS file_name FROM (SELECT discipline, event_id, row_number() OVER (PARTITION BY discipline ORDER BY prio, ts DESC, 'f' || event_id DESC) AS rn FROM wanted JOIN cand USING (discipline) JOIN files ON lower(slug) = k) WHERE rn = 1""",
)
def latest_by_mtime_with_fallback(spark, sf):
    files = table(spark, sf, "events").selectExpr(
        "CASE user_id % 9 WHEN 0 THEN 'women_studies' WHEN 1 THEN 'Asian_Studies' WHEN 2 THEN 'Area_Studies' WHEN 3 THEN 'Industrial_Relations_Labor' WHEN 4 THEN 'Sociology' ELSE concat('other_', event_type) END AS slug",
        "ts AS mtime",
        "concat('f', event_id) AS file_name",
    )
    wanted = (
        table(spark, sf, "part")
        .selectExpr("CASE p_type WHEN 'MEDIUM' THEN \"Women's Studies\" WHEN 'LARGE' THEN 'Area and Asian Studies' WHEN 'PROMO' THEN 'Industrial Relations and Labor' WHEN 'STANDARD' THEN 'Sociology' END AS discipline")
        .where("discipline IS NOT NULL")
        .distinct()
    )
    return cat.latest_by_mtime_with_fallback(wanted, files).select("discipline", "file_name")


# --- shifted rows -----------------------------------------------------------------------------------

_SHIFT_COLS = ["category", "edition", "journal_name", "issn_print", "quartile", "jif"]


@query(
    "repair_shifted_rows",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'PSYCHOLOGY, SOCIAL' ELSE 'ECONOMICS' END AS category, 'SSCI' AS edition, p_name AS journal_name,
       lpad(p_partkey::VARCHAR, 8, '0') AS issn_print, 'Q' || (1 + p_size % 4) AS quartile, p_size::VARCHAR AS jif, (p_size % 3 = 0)::INT AS shifted FROM part""",
)
def repair_shifted_rows(spark, sf):
    raw = table(spark, sf, "part").selectExpr(
        "p_partkey",
        "split(concat(CASE WHEN p_size % 3 = 0 THEN 'PSYCHOLOGY, SOCIAL' ELSE 'ECONOMICS' END, ',SSCI,', p_name, ',', lpad(p_partkey, 8, '0'), ',Q', 1 + p_size % 4, ',', p_size), ',') AS cells",
    )
    out = cat.repair_shifted_rows(raw, _SHIFT_COLS)
    return out.select("p_partkey", *_SHIFT_COLS, F.col("was_shifted").cast("int").alias("shifted"))


__all__ = ["canonical_sql", "fn", "index", "versions", "requested_issns"]
