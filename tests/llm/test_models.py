"""Classifiers, the tagger and the language model: gradients, held-out accuracy, whole results, edge cases."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import language_model as lm
from shelfspark.llm import pii, quality, stats, toxicity
from shelfspark.llm.words import words

EDGES = [None, "", " ", "x" * 60_000, "word " * 20_000, "same", "same", "ÄÖ\x00\n\n!!", "1 @ +"]


def check_gradients(model, loss, names, tolerance):
    rng = np.random.default_rng(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = loss()[:2]
    for name, at in names:
        value = model.p[name]
        for _ in range(3):
            i = at or tuple(rng.integers(0, s) for s in value.shape)
            old = value[i]
            value[i] = old + 1e-4
            up = loss()[0]
            value[i] = old - 1e-4
            down = loss()[0]
            value[i] = old
            assert abs((up - down) / 2e-4 - g[name][i]) < tolerance, name


def accuracy(scored, labels, label):
    both = scored.join(labels.select("doc_id", label), "doc_id").where("held_out").toPandas()
    both = both[both[label].notna()]
    return (both.predicted == both[label]).mean(), both


# --- quality -------------------------------------------------------------------------------------------------


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    ptr, at, value, x = quality.inputs(pa.array(["a b b c", "", "d " * 9]), pa.array([7, None, 18]))
    m = quality.FactorMachine(0.3, rng.normal(size=quality.BUCKETS), rng.normal(size=(quality.BUCKETS, 8)), rng.normal(size=x.shape[1]), rng.normal(size=(x.shape[1], 8)), x.mean(0), np.ones(x.shape[1]))
    z = m.dense(x)
    for k, got in enumerate(m.margin(ptr, at, value, x)):
        own = slice(ptr[k], ptr[k + 1])
        a, v = np.r_[value[own], z[k]], np.concatenate([m.v[at[own]], m.dv])
        pairs = sum(a[i] * a[j] * (v[i] @ v[j]) for i in range(len(a)) for j in range(i))
        assert got == pytest.approx(m.bias + m.w[at[own]] @ value[own] + z[k] @ m.dw + pairs, rel=1e-5)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = quality.op6_quality(spark, sf)
    share, both = accuracy(scored, spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert share >= 0.9 and both[both.quality == 1].predicted.mean() >= 0.97
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_edges(spark, documents):
    docs = documents(EDGES)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(9)] + [(0, None, None), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.quality_scores(docs, model).toPandas()
    assert len(got) == len(EDGES) and got.score.between(0, 1).all() and set(got.columns) == set(docs.columns)
    assert quality.quality_scores(docs.limit(0), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert quality.quality_scores(docs, none, ["doc_id"]).where("score between 0.4 and 0.6").count() == len(EDGES)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_labels_outside_the_fold_only(spark, documents):
    docs = documents([f"text {k}" for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = stats.labelled_sample(docs, labels, "quality", 10, 4, 2).collect()
    assert len(got) == 10 and all(zlib.crc32(str(r["__key"]).encode()) % 4 != 2 and r["__label"] == r["__key"] % 2 for r in got)


# --- toxicity ------------------------------------------------------------------------------------------------


def test_toxicity_features():
    seed, second = toxicity.Lookup(toxicity._hashes(["idiot"])), toxicity.Lookup(toxicity._hashes(["you"]))
    lexicon = toxicity.Lexicon.learn([words(pa.array([t])).hash for t in ["grumf a"] * 60 + ["a b"] * 60], np.r_[np.ones(60), np.zeros(60)])
    x = toxicity.features(pa.array(["You are an Idiot", "1d1ot", "idiot " + "x " * 20 + "you", "grumf", "", None]), lexicon, seed, second)
    at = {n: k for k, n in enumerate(toxicity.NAMES)}
    assert x[0, at["seed_rate"]] == 0.25 and x[0, at["near_share"]] == 1 and x[2, at["near_share"]] == 0
    assert x[1, at["disguised_rate"]] == 1 and x[0, at["disguised_rate"]] == 0
    assert x[3, at["learned_rate"]] > 0 and not x[4:].any() and np.isfinite(x).all()


def test_toxicity_carries_columns_of_any_name(spark, sf):
    """Names that the model's own columns have, repeated rows, very long and null texts, and no rows at all."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    names = ["probability", "features", "x", "prediction", "rawPrediction", "chance", "__text", "score"]
    own = spark.createDataFrame([(1, "fine"), (1, "fine"), (2, None), (3, "word " * 100_000), (4, "you idiot")], "doc_id long, text string")
    own = own.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    got = model.score(own, ["doc_id", *names]).collect()
    assert len(got) == 5 and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names[:-1]) and all(0 <= r["score"] <= 1 for r in got)
    plain = sorted((r["doc_id"], r["score"]) for r in model.score(own, ["doc_id"]).collect())
    assert plain == sorted((r["doc_id"], r["score"]) for r in got)
    assert model.score(own.limit(0), ["doc_id", "probability"]).count() == 0
    none = toxicity.train(docs.limit(0), labels)
    assert {r["score"] for r in none.score(own, ["doc_id", "features"]).collect()} == {none.prior}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op2_toxicity(spark, sf)
    share, both = accuracy(scored, spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert share >= 0.97 and both[both.toxic == 1].predicted.mean() >= 0.85 and both[both.toxic == 0].predicted.mean() <= 0.01


def test_toxicity_edges(spark, documents):
    docs = documents(EDGES)
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(9)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.train(docs, known).score(docs, ["doc_id"]).toPandas()
        assert len(got) == len(EDGES) and got.score.between(0, 1).all()


# --- personal data -------------------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_base_spans():
    pick = np.random.default_rng(8)
    parts = ["a", "b.c", "@", "@x.y", "a@b.co", " ", "-", ".", "+", "1", "255", "256", "1.2.3.4", "01", "4111 1111 1111 1111", "(", ")", "é", "🙂", "+1 (017) 555-7713", "00000000000000", "%", "_"]
    for _ in range(3000):
        text = "".join(pick.choice(parts, pick.integers(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 100_000 + "a" * 100_000) == []


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.new(1)
    code, tag = rng.integers(1, 200, (3, 9)), np.zeros((3, 9), int)
    tag[0, 2], tag[0, 3:6], tag[1, 4] = 1, 2, 7
    names = [(n, (code[0, 3], 2) if n == "embed" else None) for n in tagger.p]
    check_gradients(tagger, lambda: tagger.gradients(code, tag), names, 3e-3)


def test_tagger_learns_and_stitches():
    pick = np.random.default_rng(2)
    digits = lambda n: "".join(map(str, pick.integers(0, 10, n)))
    made = {
        "email": lambda: f"u{digits(2)}@mail{digits(1)}.example.com",
        "ip": lambda: ".".join(str(x) for x in pick.integers(1, 255, 4)),
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
    }
    say = lambda: " ".join(pick.choice(["and", "then", "of", "12", "the", "room"], 12))
    texts = [" ".join([say(), made[k](), say(), made[k](), say()]) for k in list(made) * 40]
    both = [pii.training_windows(t, 0) for t in texts]
    tagger = pii.Tagger.new()
    losses = tagger.fit(np.concatenate([b[0] for b in both]).astype(int), np.concatenate([b[1] for b in both]).astype(int))
    assert losses[-1] < 0.2 * losses[0]
    found = total = 0
    for k in list(made) * 10:
        text = " ".join([say(), made[k](), say()])
        code = pii.codes(text)
        cell = pii.cells(code)
        got = pii.stitched(tagger, text, code, cell, tagger.decode(pii.windows(code, cell).astype(int)))
        want = pii.base_spans(text)
        found, total = found + sum(s in got for s in want), total + len(want)
    assert found >= 0.85 * total
    # the rules' spans stay, added ones touch none of them
    for spans in pii.all_spans(tagger, [*texts[:20], "call 1 (017) 555-7713 now"]):
        marked = [s for s in spans if s[3]]
        assert all(a[3] or all(a[2] <= b[1] or b[2] <= a[1] for b in marked) for a in spans)


def test_pii_reads_all_that_can_be_a_span(monkeypatch):
    pad = "plain words of a text that say nothing at all " * 6
    mails = ["jane(at)example(dot)org", "jane[at]example[dot]org", f"{'j' * 150}(at)example(dot)org", f"jane (at) {'sub-label . ' * 20}org", f"jane{' ' * 150}@ example.org"]
    texts = [pad + m + " " + pad for m in mails] + [pad + "1" + "\t" * 150 + ". 2.3.4 " + pad]

    def decode(self, code):
        """A network that marks all of e-mails, or all digits and signs of an ip."""
        out = np.zeros(code.shape, np.int8)
        for t, body in zip(texts, [*mails, texts[5][len(pad) : -len(pad) - 1]]):
            k = t.index(body)
            tag = np.zeros(len(t), np.int16)
            tag[k : k + len(body)] = 2 + 2 * pii.KINDS.index("email" if body in mails else "ip")
            tag[k] -= 1
            all_ = np.arange(-(-len(t) // pii.CELL))
            known = {c.tobytes(): x for c, x in zip(pii.windows(pii.codes(t), all_).astype(int), pii.windows(tag, all_))}
            for row, c in enumerate(code.astype(int)):
                out[row] = np.maximum(out[row], known.get(c.tobytes(), 0))
        return out

    monkeypatch.setattr(pii.Tagger, "decode", decode)
    got = pii.all_spans(pii.Tagger({}), texts)
    assert [[(k, t[s:e]) for k, s, e, base in x if not base] for t, x in zip(texts, got)] == [*([("email", m)] for m in mails), [("ip", texts[5][len(pad) : -len(pad) - 1])]]
    rows, tags = pii.training_windows(pad + "write a@b.co " + pad, 1 + 3 * 100)
    assert tags.any() and pii.training_windows(pad + "jane(at)example(dot)org", 0)[0].size


def test_pii_frames(spark, documents):
    mail = "é write a@b.co, +1 (017) 555-7713 or 4111 1111 1111 1111 "
    docs = documents([*EDGES, mail * 400, mail, mail])
    tagger = pii.train(docs)
    got = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs, tagger).collect()}
    assert len(got) == 12 and [(s["kind"], s["start"], s["end"]) for s in got[10] if s["base"]] == pii.base_spans(mail)
    clean = pii.redact(docs, tagger)
    assert clean.dtypes == docs.dtypes
    text = {r["doc_id"]: r for r in clean.collect()}
    assert text[10]["text"] == "é write [EMAIL], [PHONE] or [CARD] " and text[0]["text"] is None
    assert text[10]["n_chars"] == len(text[10]["text"]) and text[9]["n_chars"] is None
    assert pii.find_pii(docs.limit(0), tagger).count() == 0
    assert not pii.train(docs.limit(0)).decode(pii.windows(pii.codes("1 a"), np.array([0])).astype(int)).any()


# --- language model ------------------------------------------------------------------------------------------


def test_network_gradients():
    net = lm.Network(np.arange(lm.VOCABULARY))
    rng = np.random.default_rng(0)
    target, fresh = rng.integers(0, lm.VOCABULARY, (6, 4)), np.zeros((6, 4), bool)
    fresh[0], fresh[3, 2] = True, True
    before, h = np.where(fresh, 0, np.roll(target, 1, 0)), np.zeros((4, lm.HIDDEN))
    names = [(n, (before[2, 1], 3) if n == "embed" else None) for n in net.p]
    check_gradients(net, lambda: net.gradients(before, target, fresh, h), names, 1e-4)


def test_lanes_equal_one_text_at_a_time():
    net = lm.Network(np.arange(lm.VOCABULARY))
    rng = np.random.default_rng(1)
    sizes = [5, 1, 40, 7, 100]
    symbols, ptr = rng.integers(0, lm.VOCABULARY, sum(sizes)), np.r_[0, np.cumsum(sizes)]
    states = [net.score(symbols, ptr)[d] for d in range(5)]
    for d in range(5):
        h, total, last = np.zeros((1, lm.HIDDEN), np.float32), 0.0, lm.END
        for x in symbols[ptr[d] : ptr[d + 1]]:
            h = net.step(net.gates()[[last]], h)[0]
            total, last = total + net.log_probability(h, np.array([x]))[0], x
        assert states[d] == pytest.approx(total, abs=1e-2)


def test_symbols_sum_to_one():
    net = lm.Network(np.arange(lm.VOCABULARY))
    h = np.random.default_rng(3).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    p = np.exp(net.log_probability(np.repeat(h, lm.VOCABULARY, 0), np.arange(lm.VOCABULARY)).astype(float))
    assert p.sum() == pytest.approx(1, abs=1e-3)


def tokens_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), None]


def brute_base(rows, training):
    c = collections.Counter(x for t in training for x in tokens_of(t))
    n, v = sum(c.values()), len(c)
    return n, {k: (len(own := tokens_of(t)), sum(c[x] > 0 for x in own), sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)) for k, t in rows}


def test_language_model_query(spark, sf):
    got = lm.op5_lm_score(spark, sf).toPandas()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, want = brute_base(rows, [t for k, t in rows if zlib.crc32(str(k).encode()) % 10])
    assert len(got) == len(rows) and set(got.train_tokens) == {n}
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and np.isfinite(got.score).all()


def test_rare_words_are_joined(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 5)
    rows = [*enumerate(EDGES), (20, "a b c d e f g h i j k l m n a b c a b"), (21, "a zz zz l"), (None, "a new")]
    docs = documents(rows)
    got = lm.score_texts(docs, docs.where(F.col("doc_id") != 21)).collect()
    n, want = brute_base(rows, [t for k, t in rows if k is not None and k != 21])
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == n and (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2], rel=1e-9) and np.isfinite(r["score"])
    none = lm.score_texts(docs, docs.limit(0)).collect()
    assert len(none) == len(rows) and all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in none)
    assert lm.score_texts(docs.limit(0), docs).count() == 0


def test_pii_query(spark, sf):
    import hashlib

    got = {r["doc_id"]: r for r in pii.op7_pii(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for d in rows:
        spans, r = plain_spans(d["text"]), got[d["doc_id"]]
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(told.split(",")) <= set(r["spans"].split(","))


def test_bounded_sample(spark):
    df = spark.range(10_000).repartition(20)
    got = stats.bounded(df, 50, "id")
    assert 20 <= got.count() <= 50 and stats.bounded(df, 20_000, "id").count() == 10_000
    same = spark.range(10_000).select(F.when(F.col("id") < 5000, 7).otherwise(F.col("id")).alias("id"))
    assert stats.bounded(same, 200, "id").where("id = 7").count() < 150
    assert stats.bounded(df.limit(0), 5, "id").count() == 0


def untrained(spark, docs):
    """Symbols that occur in ``docs``, trained on by one task, and whose embedding the training has left as it was."""
    docs = docs.coalesce(1)
    corpus = lm.Corpus.of(lm.token_counts(docs), docs.count())
    rows = lm.as_symbols(docs.select("text", (F.col("doc_id") % lm.ROUNDS).alias("round")), spark.sparkContext.broadcast(corpus), ["round"])
    net = lm.train(rows.select("round", F.col("__symbols").alias("symbols")), corpus)
    moved = np.abs(net.p["embed"] - lm.Network(corpus.symbol_count).p["embed"]).max(1) > 1e-5
    return np.flatnonzero(~moved & (corpus.symbol_count > 0))


def test_language_model_trains_on_all_documents(spark, documents):
    assert untrained(spark, documents([f"own{k} same words" for k in range(1500)])).size == 0


def test_long_text_displaces_no_other(spark, documents):
    long = " ".join(["same words"] * 150_500 + ["last1 last2"])
    assert untrained(spark, documents([*(f"own{k} same words" for k in range(50)), long, *(f"own{k} same words" for k in range(50, 100))])).size == 0


@pytest.mark.parametrize("size", [0, 1, 40, 400])
def test_every_size_is_passed_through_once(spark, documents, size):
    """One pass in as many rounds whatever the number of tokens: the rounds together fit every symbol once."""
    docs = documents([f"a{k} b c" for k in range(size)])
    corpus = lm.Corpus.of(lm.token_counts(docs), docs.count())
    rows = lm.as_symbols(docs.select("text", (F.col("doc_id") % lm.ROUNDS).alias("round")), spark.sparkContext.broadcast(corpus), ["round"])
    net = spark.sparkContext.broadcast(lm.Network(corpus.symbol_count))
    fitted = [rows.where(F.col("round") == k).select("__symbols").mapInArrow(lm._trained(net), lm.WEIGHTS).where("block = 0").agg(F.sum("n")).first()[0] or 0 for k in range(lm.ROUNDS)]
    assert sum(fitted) == corpus.tokens == 4 * size and (size < 40 or min(fitted) == size)


def test_ties_at_the_frequent_words(spark, documents, monkeypatch):
    """Words of one count fill the frequent ones up to the limit; none is lost for the scores."""
    monkeypatch.setattr(lm, "FREQUENT", 500)
    docs = documents([" ".join(f"w{k}_{i}" for i in range(40)) for k in range(50)] + ["the the the the"])
    corpus = lm.Corpus.of(lm.token_counts(docs), docs.count())
    assert 450 <= len(corpus.count) <= 500 and corpus.count.max() == 4 and (corpus.symbol > 1).all()
    monkeypatch.setattr(lm, "FREQUENT", 4000)
    assert len(lm.Corpus.of(lm.token_counts(docs), docs.count()).count) == 2001


def test_a_condition_trains_as_its_rows_do(spark, documents):
    docs = documents([*enumerate(EDGES), (50, "a b c"), (None, "a")])
    part = F.col("doc_id") % 2 == 0
    one, two = (lm.score_texts(docs, t, carry=["doc_id", "score", "lang"]).toPandas() for t in (part, docs.where(part)))
    assert len(one) == len(EDGES) + 2 and list(one.columns) == ["doc_id", "score", "lang", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same = lambda f: sorted(zip(f.n_tokens, f.n_known, f.train_tokens, f.base_score.round(6), strict=True))
    assert same(one) == same(two)


def test_padding_of_lanes_counts_nothing():
    net, rng = lm.Network(np.arange(lm.VOCABULARY)), np.random.default_rng(0)
    target, fresh = rng.integers(0, lm.VOCABULARY, (6, 4)), np.zeros((6, 4), bool)
    keep = np.ones((6, 4), bool)
    keep[:, 3] = False
    h = np.zeros((4, lm.HIDDEN), np.float32)
    (a, g, _), (b, want, _) = net.gradients(target, target, fresh, h, keep), net.gradients(target[:, :3], target[:, :3], fresh[:, :3], h[:3])
    assert a == pytest.approx(b) and all(np.allclose(g[k], want[k], atol=1e-6) for k in g)
