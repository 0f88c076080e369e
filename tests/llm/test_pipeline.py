"""Stages of the pipeline against plain versions of the same decisions."""

import hashlib

import public_tokenizers as P
import tiktoken
from test_decontaminate import brute
from test_near import brute_jaccard, grouped

import corpus_pipeline
from shelfspark.llm import pii
from shelfspark.llm.byte_bpe import load_ranks
from shelfspark.session import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.dtypes
    outs, ins = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        ins[name] = docs.toPandas().sort_values("doc_id")
        docs = written(stage(spark, docs, sf), name)
        outs[name] = docs.toPandas().sort_values("doc_id")
        if name != "bpe":
            assert docs.dtypes == columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    good = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    assert set(outs["quality"].doc_id) < set(ins["quality"].doc_id)
    assert len(good & set(outs["quality"].doc_id)) >= 0.97 * len(good)
    keys, texts = ins["jaccard"].doc_id.tolist(), ins["jaccard"].text.tolist()
    assert set(outs["jaccard"].doc_id) == set(grouped(keys, brute_jaccard(texts))[1])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute(list(zip(ins["decontaminate"].doc_id, ins["decontaminate"].text)), items)
    assert set(outs["decontaminate"].doc_id) == {k for k, v in hits.items() if not v[1]}
    before, after = (dict(zip(x["pii"].doc_id, x["pii"].text)) for x in (ins, outs))
    assert set(before) == set(after)
    for k, text in before.items():
        spans = pii.base_spans(text)
        assert (after[k] == text) or spans
        assert all(text[s:e] not in after[k] for kind, s, e in spans if kind == "email")
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in outs["bpe"].itertuples():
        ids = encoder.encode_ordinary(after[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry

    found = entry.queries()
    assert {"pipeline", *(n for n in found if n.startswith("op"))} >= {"pipeline"} and sum(n.startswith("op") for n in found) == 13
    assert set(entry.oracle_sql()) <= set(found)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "decontaminate", "pii", "bpe"]


def test_stages_take_no_rows_and_hard_rows(spark, documents, sf):
    rows = [(None, None), (1, None), (2, ""), (3, "x" * 50_000), (4, "word " * 9000), (5, "same words in both of these"), (5, "same words in both of these")]
    for docs in (documents([]), documents(rows)):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
