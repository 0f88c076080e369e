"""Readers over real file layouts, and writers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfspark import session
from shelfspark import sources as src
from shelfspark.operators import catalogue as cat
from shelfspark.operators import markdown as md
from shelfspark.plans import source_queries


def put(base, name, text, mtime=None):
    path = os.path.join(base, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8", newline="") as f:
        f.write(text)
    if mtime:
        os.utime(path, (mtime, mtime))
    return path


def test_journal_index(spark, tmp_path):
    text = 'Journal title,ISSN,eISSN,Publisher name,Languages,Web of Science Categories\n"A, ""B""",1234-567X,,Sage,EN,"Law | Sociology | "\n,1,2,P,EN,X\n  C ,,2222-2222,P,EN,\n'
    path = put(tmp_path, "index.csv", text)
    got = {r["title"]: (r["issn"], r["eissn"], r["categories"]) for r in src.scan_journal_index(spark, path).collect()}
    assert got == {'A, "B"': ("1234-567X", "", ["Law", "Sociology"]), "C": ("", "2222-2222", [])}


def test_header_must_be_clear():
    assert src.resolve_header(["ISSN", "eISSN"], {"issn": "^issn$", "eissn": "eissn"}) == {"issn": "ISSN", "eissn": "eISSN"}
    with pytest.raises(ValueError):
        src.resolve_header(["jif", "jif_quartile"], {"quartile_or_jif": "jif"})
    assert src.resolve_header(["jif_quartile", "jif"], {"jif": "jif"}) == {"jif": "jif"}


HEAD = "category,edition,journal_name,issn_print,issn_e,publisher,quartile,jif,jci,oa_citable_pct,total_citations,jcr_abbrev\n"


def metric_dir(tmp_path):
    put(tmp_path, "WOS_JCR_260101_Social_Work_260201_normalized.csv", HEAD + 'SOCIAL WORK,SSCI,One,1111-1111,,P,Q1,1.5,,,10,ONE\nPSYCHOLOGY, SOCIAL,SSCI,Two,2222-2222,2222-000X,"P, Q",Q2,2.5,,,20,TWO\nSOCIAL WORK,SSCI,One again,1111-1111,,P,N/A,9,,,30,ONE2\n')
    other = "jcr_abbrev,journal_name,quartile,issn_e,issn_print\n"
    put(tmp_path, "WOS_JCR_260101_Law_260301_normalized.csv", other + "L,Three,q3,,1111-1111\nM,Four,Q4,3333-3333,\n")
    put(tmp_path, "other.csv", "a,b\n1,2\n")
    return str(tmp_path)


@pytest.mark.parametrize("salted", [False, True])
def test_metric_files(spark, tmp_path, monkeypatch, salted):
    if salted:
        # the ways for very many files give the same rows
        monkeypatch.setattr(src.readers, "BROADCAST_FILES", 0)
    rows = src.scan_metric_files(spark, metric_dir(tmp_path))
    got = {r["journal_name"]: r for r in rows.collect()}
    assert set(got) == {"One", "Two", "One again", "Three", "Four"}
    two = got["Two"]
    assert (two["category"], two["edition"], two["issn_e"], two["publisher"], two["jcr_abbrev"]) == ("PSYCHOLOGY, SOCIAL", "SSCI", "2222-000X", "P, Q", "TWO")
    assert (two["file_discipline"], two["file_date"], two["was_shifted"]) == ("Social Work", "260201", True)
    three = got["Three"]
    assert (three["quartile"], three["category"], three["issn_print"], three["slug"]) == ("q3", None, "1111-1111", "Law")
    order = ["part_no", "block_start", "row_in_block"]
    idx = {r["issn_key"]: (r["quartile"], r["jcr_abbrev"]) for r in cat.metric_index(rows, line_cols=order).collect()}
    # Law comes first by file name, its row decides both
    assert idx["11111111"] == ("Q3", "L") and idx["2222000X"] == ("Q2", "TWO") and idx["33333333"] == ("Q4", "M")


def test_cells_of_a_line(spark):
    import csv

    lines = ['a,b', ',', '', 'a,"b, c",d', '"say ""hi""",x,', '"",""', ' "q",1', 'x,"open', 'a"b,c', '"é,ü",' + ",".join("v" * 300)]
    got = [r["c"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k int, v string").select("k", src.csv_cells(F.col("v")).alias("c")).orderBy("k").collect()]
    for line, cells in zip(lines, got, strict=True):
        if "open" not in line and line:
            assert cells == next(csv.reader([line]))
    assert got[2] == [""] and got[7] == ["x", '"open']


def test_metric_data_are_scanned_once(spark, tmp_path):
    df = src.scan_metric_files(spark, metric_dir(tmp_path))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [value#") == 1


def test_metric_files_of_any_width(spark, tmp_path):
    extra = ",".join(f"x{i}" for i in range(40))
    put(tmp_path, "WOS_JCR_260101_Law_260301_normalized.csv", f"{extra},{HEAD}" + "v," * 40 + "LAW,SSCI,Wide,1111-1111,,P,Q1,1.5,,,10,W\n")
    put(tmp_path, "WOS_JCR_260101_Arts_260301_normalized.csv", "category,title\nLAW,No header\n")
    got = src.scan_metric_files(spark, str(tmp_path)).collect()
    assert [(r["journal_name"], r["quartile"], r["jif"], r["jcr_abbrev"]) for r in got] == [("Wide", "Q1", "1.5", "W")]


YAML = """meta:
  generated: 2026-02-01
  inputs:
    - label: sources q1
      file: a.yml
      count: 3
journals:
  - name: "Alpha: a journal"
    issn: 1234-567X
    source_categories:
      - Law Q1
      - Sociology
  - name: Beta
    eissn: '0000-0001'
    notes: |
      a; b
      WOS/JCR
"""


def test_registry_yaml(spark, tmp_path):
    got = {r["name"]: r for r in src.scan_registry(spark, put(tmp_path, "journals.yml", YAML)).collect()}
    assert set(got) == {"Alpha: a journal", "Beta"}
    assert got["Alpha: a journal"]["source_categories"] == ["Law Q1", "Sociology"] and got["Alpha: a journal"]["issn"] == "1234-567X"
    assert got["Beta"]["eissn"] == "0000-0001" and "WOS/JCR" in got["Beta"]["notes"] and got["Beta"]["source_categories"] is None
    bare = put(tmp_path, "bare.yml", chr(0xFEFF) + "- name: One\n  issn: '1'\n- name: Two\n")
    assert {r["name"] for r in src.scan_registry(spark, bare, indent="").collect()} == {"One", "Two"}
    # the usual dump does not indent the items; a record may begin with any field
    flat = put(tmp_path, "flat.yml", "meta:\n  generated: 1\njournals:\n- short: S\n  name: Three\n- short: only\n- name: Four\n")
    got = src.scan_registry(spark, [bare, flat, str(tmp_path / "journals.yml")]).collect()
    assert sorted((r["name"] or r["short"]) for r in got) == ["Alpha: a journal", "Beta", "Four", "One", "Three", "Two", "only"]
    with pytest.raises(ValueError, match="no registry record"):
        src.scan_registry(spark, put(tmp_path, "none.yml", "meta:\n  a: 1\n"))


HARD = r"""# head comment
meta:
  inputs:
    - label: x
journals:
- name: Plain text:no, a 'quote' inside # and a comment
  short:   spaced
  issn: 01234567
  eissn:
  notes: first line
    second line

    after a blank
  jif: 1.50
- short: |
    literal
      deeper # no comment

    last

  name: >-
    folded
    line

    new paragraph
      kept
      so
    end
  notes: |+
    keep

  issn: "12 \"x\" \\ \u00e9\x41\tz"
  eissn: 'it''s'
  source_categories: [Law, "Q, 1", 'it''s', plain text]
# a comment between records
- "name": "long
    quoted

    text"
  quartile: ~
  jci: null
  openalex_source_id: ''
  source_categories:
  - Law Q1 # why
  - 'Social: Work'
  # comment inside
  - "A \"b\""
  - >
    folded
    item
-   name: wide dash
    short: '#no comment'
    source_categories: []
    name2: other
- name: twice
  name: last wins
  notes: >2
     a
     b
    c
  source_categories:
    - deeper
    - ~
    - two
      lines
version: 3
other: x
"""


@pytest.mark.parametrize("shift", [0, 2, 4])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_registry_records_equal_a_loader(spark, tmp_path, shift, ends):
    import yaml

    head, tail = HARD.split("journals:\n")
    body, foot = tail.split("version: 3")
    body = "".join((" " * shift if v.strip() else "") + v + "\n" for v in body.splitlines())
    whole = f"{head}journals:\n{body}version: 3{foot}"
    want = yaml.load(whole, Loader=yaml.BaseLoader)["journals"]
    path = tmp_path / "journals.yml"
    path.write_bytes(whole.replace("\n", ends).encode())
    got = sorted(src.scan_registry(spark, str(path)).collect(), key=lambda r: (r["block_start"], r["row_in_block"]))
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        for f in src.REGISTRY_FIELDS:
            assert r[f] == (None if w.get(f) in (None, "~", "null") or w.get(f) == "" and f != "openalex_source_id" else w[f]), f
        cats = w.get("source_categories")
        assert r["source_categories"] == (None if cats is None else [c for c in cats if c != "~"])


def test_records_of_both_indents_in_one_folder_without_python(spark, tmp_path):
    put(tmp_path, "a.yml", "journals:\n- name: flat\n  issn: '1'\n")
    put(tmp_path, "b.yml", "journals:\n  - name: deep\n    issn: '2'\n")
    df = src.scan_registry(spark, str(tmp_path))
    assert {(r["name"], r["issn"], r["file_name"]) for r in df.collect()} == {("flat", "1", "a.yml"), ("deep", "2", "b.yml")}
    text = df._jdf.queryExecution().toString()
    assert "MapInPandas" not in text and "PythonUDF" not in text and "SortAggregate" not in text


def test_registry_inputs(spark, tmp_path):
    got = src.scan_registry_inputs(spark, put(tmp_path, "journals.yml", YAML.replace("count: 3", "count: 3\n    - label: 'b'\n      file: x_20260101_v1.yml\n      count: many"))).orderBy("pos").collect()
    assert [(r["pos"], r["label"], r["file"], r["count"]) for r in got] == [(0, "sources q1", "a.yml", 3), (1, "b", "x_20260101_v1.yml", None)]


def test_registry_inputs_in_packs(spark, tmp_path):
    """Many registries a file give the rows of a file each."""
    import json

    whole = {name: YAML.replace("count: 3", f"count: 3\n    - label: 'b'\n      file: {name}.yml\n      count: many") for name in ("r1", "r2", "r3")}
    for name, text in whole.items():
        (tmp_path / "files" / name).mkdir(parents=True)
        (tmp_path / "files" / name / "journals.yml").write_text(text)
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "part-0.json").write_text("".join(json.dumps({"registry": n, "content": t}) + "\n" for n, t in whole.items()))
    rows = lambda df: sorted((r["folder"].rsplit("/", 1)[-1], r["pos"], r["label"], r["file"], r["count"]) for r in df.collect())
    got = rows(src.scan_registry_inputs(spark, str(tmp_path / "packs"), packed=True))
    assert len(got) == 6 and got == rows(src.scan_registry_inputs(spark, str(tmp_path / "files" / "*")))


def test_newest_source_lists(spark, tmp_path):
    for v, name in (("v2", "old"), ("v10", "new")):
        put(tmp_path, f"journals_law_20260201_{v}.yml", f"journals:\n  - name: {name}\n")
    put(tmp_path, "journals_art_20260101_v1.yaml", "journals:\n  - name: art\n")
    put(tmp_path, "notes.yml", "journals:\n  - name: none\n")
    got = {(r["prefix"], r["version"], r["name"]) for r in src.scan_source_lists(spark, str(tmp_path)).collect()}
    assert got == {("journals_law", 10, "new"), ("journals_art", 1, "art")}


def test_corpus_inventory_and_topics(spark, tmp_path):
    block = "\n---\n\n## 1. T (2020)\n\n**Abstract**: x\n\n---\n\n## 2. U (NA)\n"
    put(tmp_path, "ai/03_summaries/summaries_latest.md", chr(0xFEFF) + "# head" + block, 1_700_000_000)
    put(tmp_path, "ai/index.json", json.dumps({"topic": "ai", "label": "AI", "stages": []}, indent=1))
    put(tmp_path, "law/01_raw/papers_latest.md", "| a |\n")
    put(tmp_path, "law/index.json", "{}")
    corpus = src.scan_markdown_corpus(spark, str(tmp_path))
    assert {(r["topic"], r["stage"], r["file"], r["body"][:3]) for r in corpus.collect()} == {("ai", "03_summaries", "summaries_latest.md", "# h"), ("law", "01_raw", "papers_latest.md", "| a")}
    whole = md.explode_paper_blocks(corpus, "topic")
    parts = md.explode_paper_blocks(src.scan_summary_blocks(spark, str(tmp_path)).withColumnRenamed("block", "body"), "topic")
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str) and whole.count() == 2
    inv = {r["name"]: r for r in src.scan_file_inventory(spark, str(tmp_path), "*.md").collect()}
    assert inv["papers_latest.md"]["size"] == 6 and inv["summaries_latest.md"]["mtime"].timestamp() == 1_700_000_000
    read = src.scan_file_inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in read
    assert {(r["topic"], r["label"]) for r in src.scan_topic_index(spark, str(tmp_path)).collect()} == {("ai", "AI"), ("law", "law")}


def test_job_logs_prefer_the_live_file(spark, tmp_path):
    put(tmp_path, "job_1.log", "live\nline")
    put(tmp_path, "archive/2026-01/job_1.log", "archived")
    put(tmp_path, "archive/2026-01/job_2.log", "only archived")
    put(tmp_path, "archive/2026-01/job_2.meta.json", json.dumps({"exitCode": None, "signal": "SIGTERM", "done": True}, indent=1))
    put(tmp_path, "session.log", "x")
    got = {r["job_id"]: (r["content"], r["done"], r["exit_code"]) for r in src.scan_job_logs(spark, str(tmp_path)).collect()}
    assert got == {"job_1": ("live\nline", False, None), "job_2": ("only archived", True, None)}


def test_versioned_sink(spark, tmp_path):
    path = str(tmp_path / "v")
    df = spark.range(3)
    assert [src.sink_versioned(df.withColumn("n", F.lit(i)), path, d) for i, d in enumerate(["20260101", "20260101", "20260102"])] == [1, 2, 1]
    assert {r["n"] for r in src.read_latest(spark, path).collect()} == {2}


def test_two_writers_at_once_give_two_whole_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "both")
    frames = [spark.range(0, 5000, 1, 7).withColumn("writer", F.lit(w)) for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda f: src.sink_versioned(f, path, "20260301"), frames))
    assert sorted(numbers) == [1, 2, 3, 4]
    for w, n in enumerate(numbers):
        whole = spark.read.parquet(f"{path}/date_tag=20260301/version={n}")
        assert whole.count() == 5000 and {r["writer"] for r in whole.select("writer").distinct().collect()} == {w}


def test_only_committed_versions_are_read(spark, tmp_path):
    path = str(tmp_path / "half")
    with pytest.raises(ValueError, match="no committed version"):
        src.read_latest(spark, path)
    assert src.sink_versioned(spark.range(3), path, "20260301") == 1
    # a writer that claimed the next number and died while writing
    spark.range(9).write.parquet(f"{path}/date_tag=20260301/version=2")
    (tmp_path / "half/_claimed/20260301_v2").touch()
    assert src.read_latest(spark, path).count() == 3
    assert src.sink_versioned(spark.range(4), path, "20260301") == 3 and src.read_latest(spark, path).first()["version"] == 3
    assert src.sink_versioned(spark.range(5), path, "20260228") == 1 and src.read_latest(spark, path).count() == 4


def test_job_subset_rerun_replaces_only_its_own(spark, tmp_path):
    path = str(tmp_path / "s")
    for job, n in (("a", 3), ("b", 2), ("a", 1)):
        src.sink_job_subset(spark.range(n), path, job)
    assert {(r["job_id"], r["count"]) for r in spark.read.parquet(path).groupBy("job_id").count().collect()} == {("a", 1), ("b", 2)}


def test_archive_rerun_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "archive")
    jobs = spark.createDataFrame([("a", "2026-01-05 00:00:00"), ("b", "2026-02-05 00:00:00")], "job_id string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    src.sink_archive_by_month(jobs, path)
    src.sink_archive_by_month(jobs.union(jobs.limit(1).withColumn("job_id", F.lit("c"))), path)
    assert sorted(r["job_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_packed_job_logs(spark, tmp_path):
    put(tmp_path, "a.txt", '{"job_id": "job_1", "content": "live\\nline"}\n{"job_id": "job_2", "content": "two"}\n{"content": "of no job"}\n')
    (tmp_path / "archive").mkdir()
    put(tmp_path / "archive", "0.txt", '{"job_id": "job_1", "content": "old"}\n{"job_id": "job_3", "content": "first"}\n{"job_id": "job_3", "content": "second"}\n')
    put(tmp_path, "m.json", '{"job_id": "job_1", "exitCode": 7, "done": true}\n')
    got = {r["job_id"]: (r["content"], r["done"], r["exit_code"]) for r in src.scan_job_logs(spark, str(tmp_path), "*.txt", "*.json", packed=True).collect()}
    assert got == {"job_1": ("live\nline", True, 7), "job_2": ("two", False, None), "job_3": ("first", False, None)}


def test_job_log_query_writes_no_file_a_job(spark):
    before = len(session._made)
    source_queries.scan_job_logs(spark, "/root/testdata/sf0.001")
    path = next(p for p in session._made[before:] if "/logs-" in p)
    files = src.scan_file_inventory(spark, path).count()
    assert files <= 4 * spark.sparkContext.defaultParallelism < spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()
