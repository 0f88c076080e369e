import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from shelfspark.llm.byte_bpe import Encoder, Vocabulary, decode, decode_ids, encode_texts, load_ranks, op8_byte_bpe, send_vocabulary, token_digests

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(load_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def texts():
    pick = random.Random(3)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "١", "½", "漢", "🙂", "é", "'s", "'ll", "!!", "$$$", "_", "123", "　", "\x00", "ab" * 200, "x" * 700]
    return ["".join(pick.choices(parts, k=pick.randint(0, 30))) for _ in range(600)] + ["", "a" * 5000, "ab" * 4000, "!" * 3000, "<|endoftext|>"]


def test_ids_equal_the_library(vocabulary, reference):
    own = texts()
    ids, ptr = Encoder(vocabulary, cache=50).encode(own)
    assert [ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:])] == [reference.encode_ordinary(t) for t in own]
    raw, off = decode(vocabulary, ids.astype(np.int64))
    assert [raw[off[a] : off[b]].tobytes() for a, b in zip(ptr[:-1], ptr[1:])] == [t.encode() for t in own]


def test_cache_restarts(vocabulary, reference):
    e = Encoder(vocabulary, cache=3)
    for t in texts()[:40]:
        assert e.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_long_piece_equals_matrix(vocabulary):
    pieces = [t.encode() for t in ("abcdefgh" * 20, "aaab" * 40, "éü" * 60)]
    flat, n = vocabulary.merge_matrix(pieces, 256)
    assert np.split(flat, np.cumsum(n)[:-1])[1].tolist() == vocabulary.merge_long(pieces[1]).tolist()
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [vocabulary.merge_long(p).tolist() for p in pieces]


def test_frames(spark, documents, reference):
    docs = documents([None, "", "Hello  wörld", "Hello  wörld", "x" * 3000])
    sent = send_vocabulary(spark, PATH, P.PATTERN)
    got = decode_ids(encode_texts(docs, sent), sent).toPandas().sort_values("doc_id")
    assert got.ids.tolist()[2].tolist() == reference.encode_ordinary("Hello  wörld")
    assert [bytes(x) for x in got.decoded] == [b"", b"", "Hello  wörld".encode(), "Hello  wörld".encode(), b"x" * 3000]
    assert set(docs.columns) - {"text"} <= set(got.columns)
    assert token_digests(docs.limit(0)).count() == 0


def test_query(spark, sf, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
