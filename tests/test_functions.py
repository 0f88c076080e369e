"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from shelfspark import functions as fn

NBSP, WIDE, BOM = chr(0xA0), chr(0x3000), chr(0xFEFF)


@pytest.mark.parametrize(
    "raw, key, digits",
    [("1234-567X", "1234567X", "1234567"), (" 0001-0002 ", "00010002", "00010002"), ("1234-567x", "1234567X", "1234567"), ("", "", "")],
)
def test_issn_keeps_the_check_digit(one, raw, key, digits):
    assert one(fn.issn_norm("a"), a=raw) == key
    assert one(fn.issn_norm("a", strict_x=False), a=raw) == digits


def test_empty_issn_is_no_key(one):
    assert one(fn.issn_key("a"), a=" - ") is None
    assert one(fn.issn_hyphen("a"), a="1234567X") == "1234-567X"
    assert one(fn.issn_hyphen("a"), a="123") == "123"


@pytest.mark.parametrize("notes, want", [("a; WOS/JCR ; Sage ; ", "Sage"), ("one", "one"), (" ; ", ""), ("", "")])
def test_publisher_from_notes(one, notes, want):
    assert one(fn.publisher_from_notes("a"), a=notes) == want


def test_trim_and_squeeze_know_wide_spaces(one):
    text = f"{BOM}{WIDE} a{NBSP}{NBSP} b\t{WIDE}"
    assert one(fn.trim_all("a"), a=text) == f"a{NBSP}{NBSP} b"
    assert one(fn.squeeze("a"), a=text) == "a b"
    assert one(fn.name_norm("a"), a=f" The{WIDE}Journal  X") == "the journal x"


def test_title_case_breaks_words_at_apostrophes(one):
    assert one(fn.title_case("a"), a="WOMEN'S STUDIES in-depth") == "Women'S Studies In-Depth"
    assert one(fn.slug_to_display("a"), a="journals_ssci_urban_studies_Q1") == "Urban Studies"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Women'S Studies", "Women's Studies"),
        (" area studies ", "Area and Asian Studies"),
        ("Industrial Relations & Labor", "Industrial Relations and Labor"),
        ("Law", "Law"),
    ],
)
def test_discipline_canonical(one, raw, want):
    assert one(fn.discipline_canonical("a"), a=raw) == want


def test_discipline_keys_and_slugs(one):
    assert one(fn.strip_quartile_suffix("a"), a="Management q1") == "Management"
    assert one(fn.discipline_compare_key("a"), a="Area and  Asian Studies") == "Area Asian Studies"
    assert one(fn.discipline_compare_key("a"), a="Women's Studies") == "Women Studies"
    assert one(fn.discipline_slug("a"), a="Psychology, Social | x") == "Psychology_Social_x"
    assert one(fn.discipline_slug("a"), a="?") == "Sociology"
    assert one(fn.discipline_slug("a", default=""), a="?") == ""
    assert one(fn.topic_slug("a"), a=" Digital Labor-2 ") == "digital_labor_2"
    assert one(fn.topic_slug("a"), a="数字") == "digital_labor"
    assert one(fn.topic_slug("a", keep_hyphen=True), a="a-b c") == "a-b_c"


@pytest.mark.parametrize("raw, want", [(" q1 ", "Q1"), ("Q5", None), ("N/A", None), ("Q4", "Q4"), ("", None)])
def test_quartile_clean(one, raw, want):
    assert one(fn.quartile_clean("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [("abc", "A"), ("éa", "#"), ("9", "#"), ("", "#"), ("Z", "Z")])
def test_index_letter(one, raw, want):
    assert one(fn.index_letter("a"), a=raw) == want


@pytest.mark.parametrize("raw, want", [("ßa", "#"), ("ŉa", "#"), ("ǰa", "#"), ("ﬁx", "#"), ("ẖa", "#"), ("ıa", "I"), ("ſa", "S"), (None, "#"), ("\n", "#")])
def test_index_letter_is_one_letter(one, raw, want):
    assert one(fn.index_letter(F.col("a").cast("string")), a=raw) == want


def test_versions(one):
    v = one(fn.version_parse("a"), a="meta_clusters_20260221_v12.md")
    assert (v["prefix"], v["date_tag"], v["version"]) == ("meta_clusters", "20260221", 12)
    assert one(fn.version_parse("a"), a="papers_latest.md") is None
    assert one(fn.version_label("a"), a="papers_20260221_v2.md") == "论文列表 2026-02-21 v2"
    assert one(fn.version_label("a"), a="odd_name_20260221_v2.md") == "odd name 2026-02-21 v2"
    assert one(fn.version_label("a"), a="k_scan_latest.md") == "聚类扫描（最新）"
    assert one(fn.version_label("a"), a="my_file_latest.md") == "my file（最新）"
    assert one(fn.version_label("a"), a="free_text.md") == "free text"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Lauren Alfrey France Winddance Twine", ["Alfrey", "Twine"]),
        ("A B, C D", ["B", "D"]),
        ("A B and C D", ["B", "D"]),
        ("A B & C D et al.", ["B", "D"]),
        ("A B；C D、E F，G H", ["B", "D", "F", "H"]),
        ("First Middle Last", ["Last"]),
        ("a b c d e f g", ["b", "d", "g"]),
        ("a b c d", ["b", "d"]),
        ("Plato", ["Plato"]),
        ("", []),
        (None, []),
    ],
)
def test_surnames(one, raw, want):
    assert one(fn.surnames(F.col("a").cast("string")), a=raw) == want


@pytest.mark.parametrize(
    "raw, year, want",
    [("", 2020, "(Unknown, 2020)"), ("A B", 2020, "(B, 2020)"), ("A B, C D", None, "(B & D, ?)"), ("A B, C D, E F", 2021, "(B et al., 2021)")],
)
def test_in_text_citation(one, raw, year, want):
    assert one(fn.in_text_citation("a", F.col("y").cast("int")), a=raw, y=year) == want


def test_references(one):
    p = {"authors": "Ann Lee", "year": 2020, "title": "T", "journal": "J", "doi": "10.1/x", "openalex": "W1"}
    assert one(fn.ref_apa(), **p) == "Ann Lee (2020). T. *J*. https://doi.org/10.1/x"
    assert one(fn.ref_chicago(), **p) == 'Ann Lee. "T". *J* (2020). https://doi.org/10.1/x'
    bare = {**p, "authors": "", "journal": "", "doi": "", "openalex": "", "title": ""}
    assert one(fn.ref_apa(), **bare) == "Unknown (2020). （无标题）."
    assert one(fn.ref_url("doi", "openalex"), **{**p, "doi": ""}) == "W1"
    assert one(fn.ref_url("doi", "openalex"), **{**p, "doi": "https://d"}) == "https://d"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("George Ritzer & Nathan Jurgenson", 'Ritzer, George & Nathan Jurgenson. 2010. "T".'),
        ("Zhao, Yizhang, Tianyu Qiao & Weidong Wang", 'Zhao, Yizhang, Tianyu Qiao & Weidong Wang. 2010. "T".'),
        ("Ann Lee", 'Lee, Ann. 2010. "T".'),
        ("Plato", 'Plato. 2010. "T".'),
        ("赵一璋", "赵一璋，2010，《T》"),
    ],
)
def test_third_style(one, raw, want):
    got = one(fn.ref_sociological(), authors=raw, year=2010, title="T", journal="", doi="", openalex="")
    assert got == want + ("。" if raw == "赵一璋" else ".")


@pytest.mark.parametrize(
    "text, raw_missing, summary_missing",
    [
        ("", True, True),
        ("  N/A. ", True, True),
        ("no abstract", True, True),
        ("See the link for more details of this long paper", True, True),
        ("abstract see: somewhere else in this very long sentence", True, True),
        ("https://example.org/a/very/long/link/with/many/parts 10.1234/abcdefgh", True, True),
        ("exactly twenty-seven chars.", False, True),
        ("a text that is long enough for both of the two rules", False, False),
        ("doi: 10.1/abc openalex: W12345678 PMID 123456 short", False, True),
        (f"{WIDE}none{WIDE}", True, True),
    ],
)
def test_missing_abstract_rules(one, text, raw_missing, summary_missing):
    assert one(fn.abstract_missing_raw("a"), a=text) is raw_missing
    assert one(fn.abstract_missing_summary("a"), a=text) is summary_missing


def test_link_removal(one):
    text = "[shown](http://x.y) and https://a.b/c?d 10.1234/abc end"
    assert one(fn.strip_links_basic("a"), a=text) == "shown and end"
    assert one(fn.strip_links_strict("a"), a="x DOI：10.1/2 ISSN 1234-5678 y") == "x y"


def test_markdown_text(one):
    assert one(fn.md_cell_plain("a"), a="**b** [t](u) [](v) `c`\nd") == "b t (u) v (v) c d"
    assert one(fn.md_paragraph_plain("a"), a="## H\n- *x*\n  + y") == "H\n• x\n• y"
    shown = one(fn.md_display_clean("a"), a="```md\n**（一）X（2-4句话）**\n1、y\n```\n（ [(L, 2020)](#paper-3) ）")
    assert shown == "**（一）X**\n\n1、y\n\n[(L, 2020)](#paper-3)"
    assert one(fn.md_display_clean("a"), a="```md\nno end") == "```md\nno end"
    f = one(fn.summary_fence("a"), a="head\n```txt\n sum \n```\ntail ``` more")
    assert (f["summary"], f["before"], f["after"]) == ("sum", "head", "tail ``` more")
    assert one(fn.summary_fence("a"), a="```\nopen") is None


def test_log_functions(one):
    assert one(fn.failure_reason("a"), a="x\n[FAILURE_REASON]  out of time \nmore") == "out of time"
    assert one(fn.failure_reason("a"), a="[FAILURE_REASON]\n[FAILURE_REASON] late").startswith("综述")
    assert one(fn.line_count("a"), a="\na\nb\n") == 2
    assert one(fn.line_count("a"), a="") == 0
    q = one(fn.qa_counts_parse("a"), a="- total: 5\n- out_of_scope_candidates: 9\n")
    assert (q["total"], q["out_of_scope"], q["in_scope"]) == (5, 9, 0)
    assert one(fn.qa_counts_parse("a"), a="nothing")["total"] == 0
    assert one(fn.beijing_minute(F.col("a").cast("timestamp")), a="2026-02-23 18:05:59") == "2026/02/24 02:05"


@pytest.mark.parametrize("slug, ok", [("a_b/c-1", True), ("A", False), ("", False), ("a" * 120, True), ("a" * 121, False), ("abc\n", False)])
def test_topic_valid(one, slug, ok):
    assert one(fn.topic_valid("a"), a=slug) is ok


def test_other_predicates(one):
    assert one(fn.term_non_english("a"), a="digital labor_1-2") is False
    assert one(fn.term_non_english("a"), a="数字") is True
    assert one(fn.manual_flag("a"), a="x [manual]") is True
    assert one(fn.drop_manual_mark("a"), a="x [MANUAL] \n") == "x"
    assert one(fn.has_jcr_flag("a"), a="x wos/jcr") is True
    assert one(fn.display_fallback("a", "b"), a="", b="n") == "n"


def test_routing_keeps_every_row_once_with_its_reason(spark):
    from pyspark.sql import functions as F

    from shelfspark.operators.routing import path_checks, route, topic_checks

    topics = ["ai/law_1-x", "", None, "Bad", "a" * 121, "a" * 120, "tail\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(topics)], "id int, topic string")
    good, bad = route(rows, topic_checks("topic"))
    assert sorted(r["id"] for r in good.collect()) == [0, 5] and good.columns == rows.columns
    assert {r["id"]: r["reason"] for r in bad.collect()} == {1: "empty", 2: "missing", 3: "bad characters", 4: "too long", 6: "bad characters"}
    assert {r["id"] for r in rows.where(fn.topic_valid("topic")).collect()} == {0, 5}
    paths = ["a/b.md", "a/../b", "../x", "a/../../x", "/etc", "a b/c", "a\\b", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(paths)], "id int, path string")
    good, bad = route(rows, path_checks("path"), "why")
    assert sorted(r["id"] for r in good.collect()) == [0, 1, 5]
    assert {r["id"]: r["why"] for r in bad.collect()} == {2: "leaves the folder", 3: "leaves the folder", 4: "absolute", 6: "bad characters", 7: "missing", 8: "missing"}
    everything, none = route(rows, {})
    assert everything.count() == len(paths) and none.count() == 0
