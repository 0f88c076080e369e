"""Search, cleaning and clustering over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import clustering as cl
from shelfspark.operators import search as se
from shelfspark.plans import roles as r
from shelfspark.plans.job_queries import _STAGE, stage_files
from shelfspark.plans.registry import query
from shelfspark.plans.roles import sql_squeeze, table, texts

_KEYWORDS = "concat(lang, ' ', source, ' ', text) AS keywords"
_KEYWORDS_SQL = "lang || ' ' || source || ' ' || text AS keywords"
_SEARCH = f"""s AS (SELECT doc_id + 1 AS id, lang, source AS source_id, 2000 + doc_id % 25 AS year, trim(split_part(text, chr(10), 1)) AS title, text AS abstract, {_KEYWORDS_SQL} FROM documents)"""


def _has(c: str, t: str) -> str:
    return f"contains(lower({c}), '{t}')"


def _relaxed(t: str) -> str:
    return "(" + " OR ".join(_has(c, t) for c in ("title", "abstract", "keywords")) + ")"


def _strict(t: str) -> str:
    return "(" + " AND ".join(_has(c, t) for c in ("abstract", "keywords")) + ")"


def searchable(spark, sf):
    return texts(spark, sf, "documents").selectExpr(
        "doc_id + 1 AS id",
        "lang",
        "source AS source_id",
        "cast(2000 + doc_id % 25 AS INT) AS year",
        "trim(split_part(text, '\n', 1)) AS title",
        "text AS abstract",
        _KEYWORDS,
    )


@query(
    "literature_search",
    f"WITH {_SEARCH} SELECT id, year FROM s WHERE (({_relaxed('that')} AND {_relaxed('er')}) OR {_relaxed('queaux')}) AND year BETWEEN 2005 AND 2020",
)
def literature_search(spark, sf):
    hits = se.literature_search(searchable(spark, sf), ["That", "er ".strip(), "queaux"], ["and", "or"], year_from=2005, year_to=2020)
    return hits.select("id", "year")


@query(
    "search_mode",
    f"WITH {_SEARCH} SELECT id, {_strict('the')}::INT AS strict_hit, {_relaxed('the')}::INT AS relaxed_hit, ({_relaxed('nicht')} OR {_relaxed('src7')} OR {_relaxed('queaux')})::INT AS any_hit FROM s",
)
def search_mode(spark, sf):
    return searchable(spark, sf).select(
        "id",
        se.search_condition(["the"], mode="strict").cast("int").alias("strict_hit"),
        se.search_condition(["the"]).cast("int").alias("relaxed_hit"),
        # a logic list of the wrong length is dropped
        se.search_condition(["nicht", "src7", "queaux"], ["and"]).cast("int").alias("any_hit"),
    )


@query("year_range", f"WITH {_SEARCH} SELECT id, year FROM s WHERE year >= 2015")
def year_range(spark, sf):
    return se.year_range(searchable(spark, sf), year_from=2015).select("id", "year")


@query(
    "journal_scope",
    f"WITH {_SEARCH} SELECT id, source_id FROM s WHERE source_id IN (SELECT 'src' || (s_suppkey % 7) FROM supplier WHERE s_acctbal > 5000)",
)
def journal_scope(spark, sf):
    chosen = table(spark, sf, "supplier").where("s_acctbal > 5000").selectExpr("concat('src', s_suppkey % 7) AS source_id")
    return se.journal_scope(searchable(spark, sf), chosen).select("id", "source_id")


_DOI = "CASE doc_id % 4 WHEN 0 THEN concat('https://doi.org/10.1/', doc_id DIV 8) WHEN 1 THEN concat(' 10.1/', doc_id DIV 8, ' ') ELSE '' END"
_OA = "CASE doc_id % 4 WHEN 2 THEN concat('W', doc_id DIV 12) ELSE '' END"


@query(
    "clean_corpus",
    f"""WITH d AS (SELECT doc_id AS row_no, CASE doc_id % 4 WHEN 0 THEN 'doi:10.1/' || (doc_id // 8) WHEN 1 THEN 'doi:10.1/' || (doc_id // 8) WHEN 2 THEN 'oa:W' || (doc_id // 12) ELSE 't:' || {sql_squeeze("lower(text)")} || '|' || (2000 + doc_id % 2) END AS k,
       {sql_squeeze("text")} AS abstract FROM documents)
     SELECT row_no, md5(abstract) AS abstract FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_no) AS rn FROM d) WHERE rn = 1""",
)
def clean_corpus(spark, sf):
    raw = texts(spark, sf, "documents").selectExpr(
        "doc_id AS row_no", "text AS title", "2000 + doc_id % 2 AS year", "text AS abstract", f"{_DOI} AS doi", f"{_OA} AS openalex"
    )
    return se.clean_corpus(raw).select("row_no", F.md5("abstract").alias("abstract"))


@query(
    "structure_summaries",
    f"WITH {r.PAPERS} SELECT id, year, md5(title) AS title, md5(abstract) AS findings, '-' AS rq, '-' AS method FROM papers",
)
def structure_summaries(spark, sf):
    s = cl.structure_summaries(r.papers(spark, sf))
    return s.select(
        "id",
        "year",
        F.md5("title").alias("title"),
        F.md5("findings").alias("findings"),
        F.coalesce("rq", F.lit("-")).alias("rq"),
        F.coalesce("method", F.lit("-")).alias("method"),
    )


# --- terms and clusters ----------------------------------------------------------------------

STOP = ["the", "and", "that", "ing"]
LEMMAS = {"erst": "er", "erstly": "er", "heron": "heron"}


def tokenised(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", "source", "text")
    return docs.withColumn("tokens", cl.tokens("text", STOP, {"erstly": "erst", "thenter": "then"}, ["of the"])).drop("text")


_TOKENS = """tok AS (SELECT doc_id, source, list_filter(list_transform(list_filter(regexp_split_to_array(replace(lower(text), 'of the', 'of_the'), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3),
   lambda w: CASE w WHEN 'erstly' THEN 'erst' WHEN 'thenter' THEN 'then' ELSE w END), lambda w: w NOT IN ('the', 'and', 'that', 'ing')) AS tokens FROM documents)"""
_DF = "df AS (SELECT term, count(*) AS df, (SELECT count(*) FROM tok) AS n_docs FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM tok) GROUP BY term HAVING count(*) <= 0.5 * (SELECT count(*) FROM tok))"


_WEIGHTS = "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY 1, 2), w AS (SELECT doc_id, term, tf * ln((n_docs + 1.0) / (df + 1.0)) AS w FROM tf JOIN df USING (term))"


@query("token_features", f"WITH {_TOKENS}, {_DF}, {_WEIGHTS} SELECT doc_id, term, df, n_docs, round(w, 6) AS weight FROM w JOIN df USING (term)")
def token_features(spark, sf):
    docs = tokenised(spark, sf)
    rows = cl.token_features(docs, names=True).select("doc_id", F.explode(F.arrays_zip("terms", "dfs", "values")).alias("e"))
    n_docs = table(spark, sf, "documents").agg(F.count("*")).scalar()
    return rows.select("doc_id", F.col("e.terms").alias("term"), F.col("e.dfs").alias("df"), n_docs.alias("n_docs"), F.round("e.values", 6).alias("weight"))


@query(
    "cluster_labels",
    f"""WITH {_TOKENS}, {_DF}, tf AS (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest(tokens) AS term FROM tok) GROUP BY 1, 2),
      w AS (SELECT source, term, tf * ln((n_docs + 1.0) / (df + 1.0)) AS w FROM tf JOIN df USING (term)), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, term) AS rn FROM w)
     SELECT source AS cluster, string_agg(term, ' / ' ORDER BY rn) AS label FROM k WHERE rn <= 4 GROUP BY source""",
)
def cluster_labels(spark, sf):
    return cl.cluster_labels(tokenised(spark, sf).withColumnRenamed("source", "cluster"))


@query(
    "token_weights",
    f"""WITH {_TOKENS}, {_DF}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY 1, 2)
     SELECT doc_id, term, round(tf * ln((n_docs + 1.0) / (df + 1.0)), 6) AS weight FROM tf JOIN df USING (term)""",
)
def token_weights(spark, sf):
    return cl.token_weights(tokenised(spark, sf)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _lloyd_sql(ks: str, rounds: int = cl.LLOYD_ROUNDS) -> str:
    """CTEs of k-means over ``p (id, e)`` for all k of ``ks``, up to ``a{rounds} (id, k, best)`` with the centres ``c{rounds}``."""
    out = f"""q AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM p),
 ks AS ({ks}),
 c0 AS MATERIALIZED (SELECT k, j, e FROM (SELECT k, unnest(range(k)) AS j FROM ks) JOIN q ON rn = j * n // k)"""
    for t in range(rounds + 1):
        out += f""",
 a{t} AS MATERIALIZED (SELECT id, k, min({{'d': round(list_dot_product(c.e, c.e) - 2 * list_dot_product(p.e, c.e), 9), 'j': j}}) AS best FROM p CROSS JOIN c{t} c GROUP BY id, k)"""
        if t < rounds:
            out += f""",
 m{t} AS (SELECT k, j, list(m ORDER BY d) AS e FROM (SELECT k, best.j AS j, d, avg(x) AS m FROM a{t} JOIN (SELECT id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM p) USING (id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 c{t + 1} AS MATERIALIZED (SELECT k, j, coalesce(m.e, c.e) AS e FROM c{t} c LEFT JOIN m{t} m USING (k, j))"""
    return out


_EMBEDDED = "p AS MATERIALIZED (SELECT vec_id AS id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings)"
_LAST = cl.LLOYD_ROUNDS


@query(
    "cluster_topics",
    f"""WITH {_EMBEDDED}, {_lloyd_sql("SELECT 6 AS k")} SELECT id AS vec_id, dense_rank() OVER (ORDER BY low) - 1 AS cluster
     FROM (SELECT id, min(id) OVER (PARTITION BY best.j) AS low FROM a{_LAST})""",
)
def cluster_topics(spark, sf):
    return cl.cluster_topics(table(spark, sf, "embeddings"), 6, "vec_id").select("vec_id", F.col("cluster").cast("long").alias("cluster"))


def _text_lloyd_sql(k: int, rounds: int = cl.LLOYD_ROUNDS) -> str:
    """The same over sparse entries ``x (doc_id, term, w)``; centres are rows (j, term, m)."""
    out = f"""q AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents),
 b0 AS (SELECT doc_id, j FROM (SELECT unnest(range({k})) AS j) JOIN q ON rn = j * n // {k}),
 c0 AS MATERIALIZED (SELECT j, term, w AS m FROM b0 JOIN x USING (doc_id))"""
    for t in range(rounds + 1):
        out += f""",
 n{t} AS (SELECT r.j, coalesce(sum(m * m), 0) AS norm FROM (SELECT unnest(range({k})) AS j) r LEFT JOIN c{t} USING (j) GROUP BY r.j),
 d{t} AS (SELECT doc_id, j, sum(w * m) AS dot FROM x JOIN c{t} USING (term) GROUP BY 1, 2),
 a{t} AS MATERIALIZED (SELECT q.doc_id, min({{'d': round(norm - 2 * coalesce(dot, 0), 9), 'j': n.j}}).j AS j FROM q CROSS JOIN n{t} n LEFT JOIN d{t} d ON d.doc_id = q.doc_id AND d.j = n.j GROUP BY q.doc_id)"""
        if t < rounds:
            out += f""",
 s{t} AS (SELECT j, count(*) AS n FROM a{t} GROUP BY j),
 c{t + 1} AS MATERIALIZED (SELECT j, term, sum(w) / any_value(n) AS m FROM x JOIN a{t} USING (doc_id) JOIN s{t} USING (j) GROUP BY 1, 2
   UNION ALL SELECT j, term, m FROM c{t} WHERE j NOT IN (SELECT j FROM s{t}))"""
    return out


@query(
    "cluster_text",
    f"""WITH {_TOKENS}, {_DF}, {_WEIGHTS}, x AS MATERIALIZED (SELECT doc_id, term, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0) AS w FROM w), {_text_lloyd_sql(6)}
     SELECT doc_id, dense_rank() OVER (ORDER BY low) - 1 AS cluster FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY j) AS low FROM a{_LAST})""",
)
def cluster_text(spark, sf):
    features = cl.unit(cl.token_features(tokenised(spark, sf)))
    return cl.cluster_text(features, 6).select("doc_id", F.col("cluster").cast("long").alias("cluster"))


@query(
    "k_scan",
    f"""WITH {_EMBEDDED}, {_lloyd_sql("SELECT unnest(range(2, 21)) AS k")}, f AS (
       SELECT id, k, sqrt(greatest(min(v) FILTER (j = own), 0)) AS a, sqrt(greatest(min(v) FILTER (j <> own), 0)) AS b FROM (
         SELECT p.id, c.k, c.j, a.best.j AS own, round(list_dot_product(c.e, c.e) - 2 * list_dot_product(p.e, c.e), 9) + list_dot_product(p.e, p.e) AS v
         FROM p CROSS JOIN c{_LAST} c JOIN a{_LAST} a ON a.id = p.id AND a.k = c.k) GROUP BY 1, 2),
     s AS (SELECT k, avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS v FROM f GROUP BY k)
     SELECT CAST(k AS INT) AS k, round(v, 6) AS silhouette, k = (SELECT min(k) FROM s WHERE round(v, 9) = (SELECT max(round(v, 9)) FROM s)) AS best FROM s""",
)
def k_scan(spark, sf):
    return cl.k_scan(table(spark, sf, "embeddings"), key="vec_id").withColumn("silhouette", F.round("silhouette", 6))


@query(
    "silhouette_of_labels",
    """WITH v AS (SELECT vec_id AS id, label AS c, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
      p AS (SELECT a.id, a.c, b.c AS o, sum(list_distance(a.e, b.e) ** 2) AS s, count(*) AS n FROM v a JOIN v b ON true GROUP BY 1, 2, 3),
      q AS (SELECT id, max(CASE WHEN c = o THEN s / (n - 1) END) AS a, min(CASE WHEN c <> o THEN s / n END) AS b FROM p GROUP BY id)
     SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM q""",
)
def silhouette_of_labels(spark, sf):
    points = cl.array_features(table(spark, sf, "embeddings"))
    return spark.createDataFrame([(round(cl.silhouette(points, "label"), 6),)], "silhouette double")


@query(
    "meta_table",
    f"""WITH {r.PAPERS}, l AS (SELECT source AS cluster, 'label ' || source AS label FROM (SELECT DISTINCT source FROM documents)) SELECT id, topic, year, journal AS cluster, label FROM papers JOIN l ON l.cluster = journal""",
)
def meta_table(spark, sf):
    p = r.papers(spark, sf).select("id", "topic", "year", "journal")
    assigned = p.select("id", F.col("journal").alias("cluster"))
    labels = assigned.select("cluster").distinct().withColumn("label", F.concat(F.lit("label "), F.col("cluster")))
    return cl.meta_table(p, assigned, labels).select("id", "topic", "year", "cluster", "label")


_DIST = """v AS (SELECT vec_id AS id, label AS cluster, embedding, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
  m AS (SELECT cluster, d, avg(x) AS m FROM v GROUP BY 1, 2), dist AS (SELECT id, v.cluster, sqrt(sum((x - m) * (x - m))) AS distance FROM v JOIN m ON m.cluster = v.cluster AND m.d = v.d GROUP BY 1, 2)"""


def distances(spark, sf):
    points = table(spark, sf, "embeddings").selectExpr("vec_id AS id", "label AS cluster", "embedding")
    return cl.centroid_distance(points)


@query("centroid_distance", f"WITH {_DIST} SELECT id, cluster, round(distance, 6) AS distance FROM dist")
def centroid_distance(spark, sf):
    return distances(spark, sf).withColumn("distance", F.round("distance", 6))


@query(
    "out_of_scope_flag",
    f"""WITH {_DIST}, l AS (SELECT cluster, avg(distance) + stddev_pop(distance) AS lim FROM dist GROUP BY cluster) SELECT id, dist.cluster, (distance > lim)::INT AS out_of_scope FROM dist JOIN l USING (cluster)""",
)
def out_of_scope_flag(spark, sf):
    flags = cl.out_of_scope_by_distance(distances(spark, sf), sigmas=1.0)
    return flags.select("id", "cluster", F.col("out_of_scope").cast("int").alias("out_of_scope"))


@query("exclude_out_of_scope", f"WITH {_SEARCH} SELECT id FROM s WHERE {_relaxed('that')} OR {_relaxed('nicht')}")
def exclude_out_of_scope(spark, sf):
    papers = searchable(spark, sf)
    flags = cl.out_of_scope_by_terms(papers, se.search_condition(["that", "nicht"]))
    return cl.exclude_out_of_scope(papers, flags).select("id")


@query(
    "stage_gate",
    f"""WITH f AS (SELECT 'u' || user_id || '_' || event_type AS topic, {_STAGE} AS stage FROM events),
     c AS (SELECT topic, {", ".join(f"count(*) FILTER (stage = '{s}') AS s{i}" for i, s in enumerate(["01_raw", "02_clean", "03_summaries", "04_meta", "05_report", "06_review"]))} FROM f GROUP BY topic)
     SELECT topic, s0 AS "01_raw", s5 AS "06_review", concat_ws(',', '01_raw', CASE WHEN s0 > 0 THEN '02_clean' END, CASE WHEN s1 > 0 THEN '03_summaries' END, CASE WHEN s2 > 0 THEN '04_meta' END, CASE WHEN s3 > 0 THEN '05_report' END, CASE WHEN s4 > 0 THEN '06_review' END) AS ready FROM c""",
)
def stage_gate(spark, sf):
    files = table(spark, sf, "events").selectExpr("concat('u', user_id, '_', event_type) AS topic", f"{_STAGE} AS stage")
    return cl.stage_gate(files).select("topic", "01_raw", "06_review", "ready")


__all__ = ["searchable", "stage_files", "tokenised"]
