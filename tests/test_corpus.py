"""Markdown, citations, search and clusters."""

import math
import re

import pytest

from pyspark.sql import functions as F

from shelfspark.operators import clustering as cl
from shelfspark.operators import markdown as md
from shelfspark.operators import papers as pp
from shelfspark.operators import search as se

SUMMARY = """﻿# Summaries

Total papers: 4

---

## 1. A machine (draft), not a mind (2026)

- Journal: CSR
- Author(s): Ann Lee, Bo Chan
- DOI: 10.1/x

**Research question**: How programmers,
in two lines.

**Data / material**:

**Method**: interviews

**Key findings (from abstract)**: Two imaginaries are found in the online discussions of programmers.

---  

## 2. No year here (NA)

- Journal: X
- OpenAlex: W2

**Key findings (from abstract)**:

**Contribution**: something

---

## 3. more entries

(sample)

---

## 4. Typed in (2020)

- Authors: C D

**Key findings (from abstract)**: short [MANUAL]
"""


def docs(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc int, body string")


def test_paper_blocks(spark):
    p = {r["id"]: r for r in md.explode_paper_blocks(docs(spark, SUMMARY)).collect()}
    assert set(p) == {1, 2, 3, 4}
    assert p[1]["title"] == "A machine (draft), not a mind" and p[1]["year"] == 2026
    # several lines are kept, an empty field does not take the next one
    assert p[1]["rq"] == "How programmers,\nin two lines."
    assert p[1]["data"] is None and p[1]["method"] == "interviews"
    assert p[1]["authors"] == "Ann Lee, Bo Chan" and p[4]["authors"] == "C D"
    assert (p[2]["title"], p[2]["year"], p[2]["openalex"]) == ("No year here", None, "W2")
    assert p[2]["findings"] is None and p[2]["contribution"] == "something"
    assert p[3]["title"] is None


def test_audit_and_patch(spark):
    d = docs(spark, SUMMARY)
    audit = {r["id"]: (r["missing"], r["is_manual"], r["key_findings"]) for r in md.audit_blocks(d).collect()}
    assert audit[1][0] is False and audit[2] == (True, False, "") and audit[4] == (True, True, "short")
    patches = spark.createDataFrame(
        [(0, 2, "old", 0), (0, 2, r"a better $1 text with \ signs, long enough", 1), (0, 99, "nobody", 0)],
        "doc int, idx int, abstract string, seq int",
    )
    blocks = md.paper_blocks(d)
    patched = md.join_blocks(md.patch_blocks(blocks, patches))
    after = {r["id"]: (r["missing"], r["is_manual"], r["key_findings"]) for r in md.audit_blocks(patched).collect()}
    assert after[2] == (False, True, r"a better $1 text with \ signs, long enough")
    assert {k: v for k, v in after.items() if k != 2} == {k: v for k, v in audit.items() if k != 2}
    by = pp.audit_partition(md.audit_blocks(d), ["doc"]).first()
    assert (by["total"], by["n_missing"], by["n_filled"], by["n_manual"]) == (4, 3, 1, 1)


LOOSE = "# Head\n\nno separator\n## 1. First (2020)\n\n**Key findings (from abstract)**: one\n\n**Key findings (from abstract)**: two\n\n---  \n\n## Notes\n\nunnumbered\n\n---\n## 2. Second (NA)\n\n**Key findings (from abstract)**: x\n"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_lose_nothing(spark, end):
    body = LOOSE.replace("\n", end)
    d = docs(spark, body, "", "---", "no block")
    assert {(r["id"], r["title"]) for r in md.explode_paper_blocks(d).collect()} == {(1, "First"), (2, "Second")}
    blocks = md.document_blocks(d)
    back = {r["doc"]: r["body"] for r in md.join_blocks(blocks).collect()}
    assert back == {0: body, 1: "", 2: "---", 3: "no block"}
    patches = spark.createDataFrame([(0, 1, "patched $1", 0), (0, 0, "nobody", 0), (3, 0, "nobody", 0)], "doc int, idx int, abstract string, seq int")
    after = {r["doc"]: r["body"] for r in md.join_blocks(md.patch_blocks(blocks, patches)).collect()}
    # the first field only; preamble, notes and the other paper stay as they are
    one, rest = body.split(f"{end}{end}**Key findings (from abstract)**: two")
    assert after[0].startswith(one[: -len("one")] + "patched $1 [MANUAL]") and after[0].endswith(f"**Key findings (from abstract)**: two{rest}")
    assert {k: v for k, v in after.items() if k} == {k: v for k, v in back.items() if k}


def test_render_then_parse_is_identity(spark):
    fields = {"Abstract": "abstract", "Research question": "rq", "Data / material": "data", "Method": "method", "Key findings (from abstract)": "findings", "Contribution": "contribution"}
    bullets = {"Journal": "journal", "Author(s)": "authors", "DOI": "doi", "OpenAlex": "openalex"}
    rows = [
        (1, "T (x) 1", 2020, "J", "10.1", "W1", "A B", "abs\nline", "q", None, "m", "f", None),
        (2, "Ti", None, None, None, None, None, None, None, "d", None, None, "c"),
    ]
    names = ["id", "title", "year", "journal", "doi", "openalex", "authors", "abstract", "rq", "data", "method", "findings", "contribution"]
    df = spark.createDataFrame(rows, "id int, title string, year int, " + ", ".join(f"{n} string" for n in names[3:]))
    block = md.render_paper_block(F.col("id"), F.col("title"), F.col("year"), {k: F.col(v) for k, v in fields.items()}, {k: F.col(v) for k, v in bullets.items()})
    text = df.select("id", block.alias("b")).orderBy("id").collect()
    back = md.explode_paper_blocks(docs(spark, "\n---\n\n".join(r["b"] for r in text)))
    assert sorted(tuple(r[n] for n in names) for r in back.collect()) == sorted(rows)


def test_raw_table(spark):
    body = "﻿x\n| Journal | Year | Title | Authors | DOI | OpenAlex | Abstract |\n|--|--|--|--|--|--|--|\n| J | 2020 | T | A B | 10.1 | W | left | right |\n| short | row |\n"
    no_authors = "| Journal | Year | Title | DOI | OpenAlex | Abstract |\n|--|--|--|--|--|--|\n| J | NA | T | 10.1 | W | N/A |\n"
    three = "| Title | Journal | Year |\n|--|--|--|\n| a | b | 2020 |\n"
    got = {r["doc"]: r for r in md.explode_raw_papers(docs(spark, body, no_authors, three, "no table")).collect()}
    assert set(got) == {0, 1}
    assert got[0]["abstract"] == "left | right" and got[0]["authors"] == "A B" and got[0]["doi"] == "10.1"
    assert got[1]["abstract"] == "N/A" and got[1]["authors"] is None and got[1]["year"] is None
    stats = pp.raw_paper_stats(md.explode_raw_papers(docs(spark, no_authors)), ["doc"]).first()
    assert (stats["total"], stats["missing_abstract"]) == (1, 1)


def test_tables_blocks_and_dropped_column(spark):
    body = "# H\n\n| a | OpenAlex | c |\n|:--|---|--:|\n| **1** | W | [t](u) |\n| 2 |\n\n- item\n| lonely |\nend"
    d = docs(spark, body)
    t = [(r["table_no"], r["row_no"], r["cells"]) for r in md.explode_md_tables(d).orderBy("table_no", "row_no").collect()]
    assert t == [(0, 0, ["a", "OpenAlex", "c"]), (0, 1, ["**1**", "W", "[t](u)"]), (0, 2, ["2"])]
    dropped = d.select(md.drop_md_column("body").alias("b")).first()["b"]
    assert dropped == "# H\n\n| a | c |\n| :-- | --: |\n| **1** | [t](u) |\n| 2 |\n\n- item\n| lonely |\nend"
    again = docs(spark, dropped).select(md.drop_md_column("body").alias("b")).first()["b"]
    assert again == dropped
    blocks = [(r["type"], r["text"], r["rows"]) for r in md.explode_content_blocks(d).orderBy("pos").collect()]
    assert blocks == [("paragraph", "H", []), ("table", "", [["a", "c"], ["1", "t (u)"], ["2"]]), ("paragraph", "• item", []), ("paragraph", "end", [])]


def test_report_sections(spark):
    body = "intro\n## 一、 First \nlead\n**（一）Main**\nx\n**（二）Method** note\ny\n## 二、Second\n## Other\nz\n"
    s = md.explode_report_sections(docs(spark, body, "plain"))
    got = [(r["doc"], r["pos"], r["title"], r["body"]) for r in s.orderBy("doc", "pos").collect()]
    assert got[0] == (0, 0, "", "intro") and got[1][2] == "一、First" and got[2] == (0, 2, "二、Second", "## Other\nz")
    assert got[3] == (1, 0, "", "plain")
    subs = md.explode_subsections(s.where("doc = 0 AND pos = 1"))
    assert [(r["sub_title"], r["sub_body"]) for r in subs.orderBy("sub_pos").collect()] == [("lead", ""), ("（一）Main", "x"), ("（二）Method note", "y")]


def test_chunks_keep_every_section_whole(spark):
    body = "i" * 100 + "\n## 一、A\n" + "a" * 600 + "\n## 二、B\n" + "b" * 50 + "\n## 三、C\n" + "c" * 380
    chunks = [r["chunk"] for r in md.chunk_report(docs(spark, body), 1).orderBy("chunk_no").collect()]
    assert "\n".join(chunks) == body and [len(c) <= 500 for c in chunks] == [True, False, True]


def brute_link(body, cites):
    """The rule itself, over every citation."""
    for cid, text in sorted(cites, key=lambda c: -len(c[1])):
        link = f"[{text}](#paper-{cid})"
        put = lambda m: m.group(1) + link
        body = re.sub(r"(^|[^\[])(" + re.escape(text) + ")", put, body)
        body = re.sub(r"(^|[^\[（(])(" + re.escape(text[1:-1]) + ")", put, body)
    return body


def test_links_equal_brute_force(spark):
    cites = [(1, "(Lee, 2020)"), (2, "(Lee & Chan, 2020)"), (3, "(Li et al., 2019)"), (4, "(Chan, 2020)"), (5, "(Lee, 2020)"), (6, "(O'Neil, ?)"), (7, "(A.B, 2001)"), (8, "(C$D, 2001)")]
    bodies = [
        "Lee, 2020 and (Lee, 2020) and [(Lee, 2020)](#paper-9)",
        "McLee, 2020; Lee & Chan, 2020, 2021 (Li et al., 2019)",
        "(Chan, 2020)\nWu & Chan, 2020 x（Lee, 2020）",
        "O'Neil, ? AxB, 2001 A.B, 2001 C$D, 2001",
        "nothing, 20 here, 1999",
        "",
    ]
    b = spark.createDataFrame([(i, "t", x) for i, x in enumerate(bodies)] + [(99, "u", bodies[0])], "doc int, topic string, body string")
    c = spark.createDataFrame([("t", i, x, i) for i, x in cites], "topic string, id int, in_text string, pos int")
    linked = pp.link_mentions(b, c)
    got = {r["doc"]: r["body"] for r in linked.collect()}
    assert got[99] == bodies[0]
    unique = list({t: (i, t) for i, t in reversed(cites)}.values())
    for i, body in enumerate(bodies):
        assert got[i] == brute_link(body, unique), body
    twice = {r["doc"]: r["body"] for r in pp.link_mentions(linked.drop("n_links"), c).collect()}
    assert {k: twice[k] for k in (0, 3, 4, 5)} == {k: got[k] for k in (0, 3, 4, 5)}


def test_a_citation_is_probed_by_an_anchor_of_its_own(spark):
    """Texts that only differ far from their year, as all those ending in "et al.", do not share an anchor."""
    texts = [f"C{n} et al., 1990" for n in range(100, 200)]
    sizes = [F.coalesce(*[pp._anchor(F.col("t"), n) for n in reversed(pp.ANCHORS)])]
    anchors = spark.createDataFrame([(t,) for t in texts], "t string").select(*sizes).distinct().count()
    assert anchors == len(texts)
    c = spark.createDataFrame([("t", n, f"({t})", n) for n, t in enumerate(texts)], "topic string, id int, in_text string, pos int")
    b = spark.createDataFrame([(1, "t", "McC123 et al., 1990 and C7, 1990")], "doc int, topic string, body string")
    got = pp.link_mentions(b, c).first()
    assert (got["body"], got["n_links"]) == ("Mc[(C123 et al., 1990)](#paper-23) and C7, 1990", 1)
    assert pp.link_mentions(b, c.limit(0)).first()["n_links"] == 0


def test_page_text(spark):
    html = "<html><script>var t='<p>';</script><style>p{}</style><!-- x --><p>A&amp;B&nbsp;<b>c</b> &amp;lt;</p></html>"
    assert docs(spark, html).select(md.page_text("body").alias("t")).first()["t"] == "A&B c &lt;"


def test_search_folds_from_the_left(spark):
    p = spark.createDataFrame([(1, "A", "x y", ""), (2, "b", "y", "y"), (3, "z", "", "")], "id int, title string, abstract string, keywords string")
    hit = lambda *a, **k: {r["id"] for r in p.where(se.search_condition(*a, **k)).collect()}
    assert hit(["x", "y", "z"], ["and", "or"]) == {1, 3}
    assert hit(["z", "x", "y"], ["or", "and"]) == {1}
    assert hit(["x", "z"], ["and", "and"]) == {1, 3}
    assert hit(["y"], mode="strict") == {2}
    assert hit(["", "  "]) == {1, 2, 3}


def test_clean_corpus_keys(spark):
    raw = spark.createDataFrame(
        [(1, "T", 2020, "https://doi.org/10.1/A", "", "x"), (2, "U", 2020, "10.1/a", "", "y"), (3, " t ", 2020, "", "", "z"), (4, "T", 2021, "", "", "z"), (5, "T", 2020, "", "W", "")],
        "row_no int, title string, year int, doi string, openalex string, abstract string",
    )
    assert {r["row_no"] for r in se.clean_corpus(raw).collect()} == {1, 3, 4, 5}


def plain_lloyd(x, k, rounds=cl.LLOYD_ROUNDS):
    """Centres and clusters of k-means from rows at equal steps, by nested loops."""
    import numpy as np

    n = len(x)
    centres = [x[c * n // k] for c in range(k)]
    for turn in range(rounds + 1):
        own = [min(range(k), key=lambda c: (round(float(centres[c] @ centres[c] - 2 * v @ centres[c]), 9), c)) for v in x]
        if turn < rounds:
            centres = [np.mean([v for v, o in zip(x, own, strict=True) if o == c], 0) if c in own else centres[c] for c in range(k)]
    order = list(dict.fromkeys(own))
    return centres, [order.index(c) for c in own]


def test_clusters(spark):
    import numpy as np

    pts = spark.createDataFrame([(i, [float(i % 2 * 10), float(i % 2)]) for i in range(40)], "id int, embedding array<float>")
    scan = cl.k_scan(pts, [2, 3, 4])
    assert cl.best_k(scan) == 2 and scan.where("best").count() == 1
    a, b = (sorted((r["id"], r["cluster"]) for r in cl.cluster_topics(pts, k).collect()) for k in (2, 2))
    assert a == b == [(i, i % 2) for i in range(40)]
    x = np.random.default_rng(3).normal(size=(60, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>").repartition(7)
    for k in (3, 7):
        got = [r["cluster"] for r in cl.cluster_topics(rows, k).orderBy("id").collect()]
        assert got == plain_lloyd(x, k)[1]
    best = cl.best_k(cl.k_scan(rows))
    assert [r["cluster"] for r in cl.cluster_topics(rows, "auto").orderBy("id").collect()] == plain_lloyd(x, best)[1]


def test_text_clusters_are_those_of_dense_rows(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = np.round(rng.random((50, 12)) * (rng.random((50, 12)) < 0.3), 3)
    x[7] = 0  # a row without terms
    x[20:25] = x[0]  # equal first centres leave one of them empty
    sparse = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)]
    rows = spark.createDataFrame(sparse, "doc_id int, indices array<long>, values array<double>").repartition(5)
    for k in (2, 5, 10):
        got = [r["cluster"] for r in cl.cluster_text(rows, k).orderBy("doc_id").collect()]
        assert got == plain_lloyd(x, k)[1]
    assert {r["doc_id"]: sum(v * v for v in r["values"]) for r in cl.unit(rows).collect()}[7] == 0


def test_text_clusters_do_not_depend_on_the_terms_that_are_sent(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    x = np.round(rng.random((60, 14)) * (rng.random((60, 14)) < 0.3), 3)
    x[3] = 0
    x[20:25] = x[0]
    sparse = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)]
    rows = spark.createDataFrame(sparse, "doc_id int, indices array<long>, values array<double>")
    for k, heavy in ((5, 0), (10, 7)):
        got = [r["cluster"] for r in cl.cluster_text(rows, k, heavy=heavy).orderBy("doc_id").collect()]
        assert got == plain_lloyd(x, k)[1]


def test_bucketed_rows_stay_where_they_are(spark):
    from shelfspark.session import bucketed

    rows = spark.range(500).select("id", F.array("id").alias("v"))
    with bucketed(rows, "probe", "id") as kept:
        assert kept.count() == 500
        joined = kept.join(spark.range(40).hint("shuffle_hash"), "id")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and joined.count() == 40
        name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("shelfspark_"))
    assert name not in [t.name for t in spark.catalog.listTables()]


def test_cluster_shares_and_scope(spark):
    a = [(i, i % 2) for i in range(40)]
    share = pp.cluster_share(spark.createDataFrame(a, "id int, cluster int")).collect()
    assert sum(r["pct"] for r in share) == 100.0
    far = spark.createDataFrame([(i, 0, [0.0, float(i == 9) * 50]) for i in range(10)], "id int, cluster int, embedding array<double>")
    flags = cl.out_of_scope_by_distance(cl.centroid_distance(far))
    assert {r["id"] for r in flags.where("out_of_scope").collect()} == {9}


def test_tokens_and_labels(spark):
    d = spark.createDataFrame([(0, "machine learning runs"), (0, "machine Learning run"), (1, "field work")], "cluster int, text string")
    t = d.withColumn("tokens", cl.tokens("text", ["the"], {"runs": "run"}, ["machine learning"]))
    assert [r["tokens"] for r in t.collect()] == [["machine_learning", "run"], ["machine_learning", "run"], ["field", "work"]]
    labels = {r["cluster"]: r["label"] for r in cl.cluster_labels(t, max_df=1.0).collect()}
    assert labels == {0: "machine_learning / run", 1: "field / work"}
    t = t.withColumn("doc_id", F.monotonically_increasing_id())
    features = [(r["indices"], r["values"]) for r in cl.token_features(t, max_df=1.0).orderBy("doc_id").collect()]
    # no term is dropped, also those of a single document; terms are numbered in their order
    assert [i for i, _ in features] == [[1, 2], [1, 2], [0, 3]]
    assert [r["term"] for r in cl.dictionary(t, max_df=1.0).orderBy("term_id").collect()] == ["field", "machine_learning", "run", "work"]
    common = [len(r["indices"]) for r in cl.token_features(t, max_df=0.5).orderBy("doc_id").collect()]
    assert common == [0, 0, 2]
    weights = {(r["cluster"], r["term"]): r["weight"] for r in cl.token_weights(t.where("cluster = 1"), "cluster", max_df=1.0).collect()}
    assert weights == {(1, "field"): 0.0, (1, "work"): 0.0}


def test_qa_gate_and_batches(spark):
    flags = spark.range(100).select((F.col("id") == 0).alias("out_of_scope"))
    r = pp.qa_scope_counts(flags).first()
    assert (r["total"], r["out_of_scope"], r["in_scope"], r["gate"]) == (100, 1, 99, True)
    assert pp.qa_scope_counts(flags.limit(99)).first()["gate"] is False
    a = spark.range(25).select("id", F.lit(1).alias("cluster"))
    sizes = sorted(r["count"] for r in pp.papers_per_cluster_batches(a).groupBy("batch").count().collect())
    assert sizes == [1, 12, 12]
    assert pp.papers_per_cluster_batches(a, 0).select("batch").distinct().count() == 25


def test_fallback_by_url_then_doi(spark):
    papers = spark.createDataFrame([(1, "u1", "d1", ""), (2, "u2", "d2", ""), (3, None, "d3", None), (4, "u1", None, "kept"), (5, None, None, "")], "id int, url string, doi string, abstract string")
    pages = spark.createDataFrame([("u1", "d9", "by url"), ("x", "d1", "other"), (None, "d2", "by doi"), (None, "d3", " ")], "url string, doi string, page_text string")
    missing = F.coalesce(F.col("abstract"), F.lit("")) == ""
    got = {r["id"]: (r["abstract"], r["filled"]) for r in pp.fill_from_fallback(papers, pages, missing, ["url", "doi"]).collect()}
    assert got == {1: ("by url", True), 2: ("by doi", True), 3: (None, False), 4: ("kept", False), 5: ("", False)}


@pytest.mark.parametrize("heavy", [0, 2, 100])
def test_features_by_sent_and_shuffled_terms_are_equal(spark, heavy):
    """Whether a term is sent to the tasks or shuffled to its entries, the rows are the same; no token is shuffled for its count."""
    words = [["b", "a", "b", None], ["a", "c"], ["d", "c", "a"], [], None, ["e"]]
    t = spark.createDataFrame(list(enumerate(words)), "doc_id long, tokens array<string>")
    want = {(i, w): ws.count(w) for i, ws in enumerate(words) for w in ws or [] if w and w != "a"}
    df = {w: sum(w in (ws or []) for ws in words) for w in "bcde"}
    weight = {(i, w): round(n * math.log(7 / (df[w] + 1)), 9) for (i, w), n in want.items()}
    rows = cl.token_features(t, max_df=0.4, names=True, heavy=heavy)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert set(got) == set(range(6)) and got[3]["indices"] == [] and got[4]["indices"] == []
    assert all(r["indices"] == sorted(r["indices"]) and [("bcde"[i], df["bcde"[i]]) for i in r["indices"]] == list(zip(r["terms"], r["dfs"], strict=True)) for r in got.values())
    assert {(i, w): round(v, 9) for i, r in got.items() for w, v in zip(r["terms"], r["values"], strict=True)} == weight
    assert {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in cl.token_weights(t, max_df=0.4, heavy=heavy).collect()} == weight
    counts = cl.term_counts(t)
    assert {r["doc_id"]: r["e"] and [tuple(x) for x in r["e"]] for r in counts.collect()}[0] == [("a", 1), ("b", 2)]


def test_frequent_terms_are_not_shuffled(spark):
    t = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "doc_id long, tokens array<string>")
    for rows in (cl.token_features(t), cl.token_weights(t)):
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
