"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of the whole text: densities of a seed lexicon (plain, and with disguising digits and signs undone)
and of a lexicon learned from labels (words and word beginnings), closeness of second-person words to the
hits, rates of capitals, punctuation and disguise. The trees and the calibration are Spark ML estimators
fitted on a bounded sample. The learned lexicon of a sample row never comes from that row's own fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.decontaminate import Lookup
from shelfspark.llm.registry import query, table
from shelfspark.llm.stats import NAMES as STRUCTURE
from shelfspark.llm.stats import fold, labelled_sample, structure
from shelfspark.llm.words import ALNUM, Words, chunks, words
from shelfspark.session import written

#: Labelled rows the model is fitted on, at most.
SAMPLE_ROWS = 6000
#: Entries of the learned lexicon, at most.
LEXICON = 4096
FOLDS, HELD = 3, 1
CUTS = 3
TOXIC = 0.7
PREFIXES = (4, 5, 6, 7)
#: Words within which a second-person word counts as close to a hit.
NEAR = 6
SEED = (
    "asshole bastard bitch bullshit clown coward crap creep cretin cunt damn despicable dick disgusting dumb dumbass dumbest "
    "failure filth filthy fool freak fuck fucking garbage hate idiot idiotic idiots imbecile kill loser losers lunatic moron "
    "moronic morons nazi pathetic pig pigs prick psycho repulsive retard retarded scum shit shut slut stupid stupidity sucks "
    "terrible trash ugly useless vermin vile whore worthless"
).split()
SECOND_PERSON = "you your yours yourself youre ur u thou thy tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch ti tus tuyo usted ustedes vosotros".split()


def _disguised() -> np.ndarray:
    table_ = ALNUM.copy()
    for sign, letter in zip("013457@$", "oieastas", strict=True):
        table_[ord(sign)] = ord(letter) + 1
    return table_


DISGUISED = _disguised()
NAMES = [
    *STRUCTURE,
    "seed_rate",
    "seed_hits",
    "disguised_rate",
    "learned_rate",
    "learned_hits",
    "learned_best",
    "learned_mean",
    "second_rate",
    "near_share",
    "near_rate",
    "mixed_words",
    "single_letters",
]


def _hashes(entries: list[str]) -> np.ndarray:
    return words(pa.array(entries)).hash


@dataclass
class Lexicon:
    """Hashes of learned words and word beginnings with the log odds of each."""

    key: np.ndarray
    weight: np.ndarray

    @staticmethod
    def learn(tokens: list[np.ndarray], y: np.ndarray, limit: int = LEXICON) -> Lexicon:
        """Entries that mark toxic texts beyond chance: six standard deviations and odds of at least 4."""
        if not len(y) or not len(tokens) or y.min() == y.max():
            return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
        flat = np.concatenate(tokens)
        key, at = np.unique(flat, return_inverse=True)
        n = np.bincount(at, minlength=len(key))
        t = np.bincount(at, np.repeat(y, [len(x) for x in tokens]), len(key))
        prior = y.mean()
        z = (t - n * prior) / np.sqrt(n * prior * (1 - prior))
        weight = np.log((t + 0.5) / (y.sum() + 1)) - np.log((n - t + 0.5) / (len(y) - y.sum() + 1))
        good = np.flatnonzero((n >= 3) & (z >= 6) & (weight >= np.log(4)))
        good = good[np.argsort(-z[good], kind="stable")][:limit]
        good = np.sort(good)
        return Lexicon(key[good], weight[good])


def word_weights(w: Words, lexicon: Lexicon, lookup: Lookup) -> np.ndarray:
    """Largest weight of each word or of its beginnings, 0 for none."""
    out = np.zeros(len(w.hash))
    for k, h in [(None, w.hash), *(w.prefixes(n) for n in PREFIXES)]:
        at, key = lookup.find(h)
        np.maximum.at(out, at if k is None else k[at], lexicon.weight[key])
    return out


def features(texts: pa.Array, lexicon: Lexicon, seed: Lookup, second: Lookup) -> np.ndarray:
    """One row of ``NAMES`` per text, all finite; an empty text has zeros."""
    w = words(texts)
    per = np.maximum(w.counts, 1)

    def total(v: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0.0, np.cumsum(v)][w.ptr])

    plain = np.zeros(len(w.hash), bool)
    plain[seed.find(w.hash)[0]] = True
    undone = words(texts, DISGUISED)
    hidden = np.bincount(undone.doc[seed.find(undone.hash)[0]], minlength=len(per)) - total(plain)
    weight = word_weights(w, lexicon, Lookup(lexicon.key))
    learned = weight > 0
    best = np.zeros(len(per))
    np.maximum.at(best, w.doc, weight)
    you = np.zeros(len(w.hash), bool)
    you[second.find(w.hash)[0]] = True
    hit = np.flatnonzero(plain | learned)
    near = np.zeros(len(hit))
    at, doc = np.flatnonzero(you), w.doc
    if len(at):
        for side in (np.searchsorted(at, hit), np.searchsorted(at, hit) - 1):
            other = at[np.clip(side, 0, len(at) - 1)]
            near = np.maximum(near, (np.abs(other - hit) <= NEAR) & (doc[other] == doc[hit]))
    close = np.bincount(doc[hit], near, len(per))
    hits = np.bincount(doc[hit], minlength=len(per))
    length = w.ends - w.starts
    is_digit = ((w.raw >= 48) & (w.raw <= 57)).astype(np.int64)
    digits = np.r_[0, np.cumsum(is_digit)]
    digits = digits[w.ends] - digits[w.starts] if len(length) else length
    some = np.maximum(total(learned), 1)
    columns = [total(plain) / per, np.log1p(total(plain)), np.maximum(hidden, 0) / per, total(weight) / per, np.log1p(total(learned)), best, total(weight) / some]
    columns += [total(you) / per, close / np.maximum(hits, 1), close / per, total((digits > 0) & (digits < length)) / per, total(length == 1) / per]
    return np.concatenate([structure(texts, w), np.stack(columns, 1)], 1)


def _tokens(batches):
    for batch in batches:
        for part in chunks(batch):
            w = words(part.column(0))
            own = [(np.arange(len(w.hash)), w.hash), *(w.prefixes(n) for n in PREFIXES)]
            doc, h = w.doc[np.concatenate([k for k, _ in own])], np.concatenate([h for _, h in own])
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][: len(h)]
            ptr = np.searchsorted(doc[new], np.arange(len(w.ptr)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(h[new].view(np.int64))), part.column(1), part.column(2)], ["tokens", "cut", "y"])


def with_features(docs: DataFrame, lexicons: list[Lexicon], carry: list[str], text: str = "text", cut: str | None = None) -> DataFrame:
    """``carry`` and ``x``, the features by the lexicon of the row's cut (the last lexicon without one)."""
    df = docs.select(*carry, F.col(text).cast("string").alias("__text"), (F.col(cut) if cut else F.lit(len(lexicons) - 1)).cast("int").alias("__cut"))
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches):
        seed, second = Lookup(_hashes(SEED)), Lookup(_hashes(SECOND_PERSON))
        for batch in batches:
            for part in chunks(batch, "__text"):
                cuts = part.column(len(carry) + 1).to_numpy()
                x = np.zeros((len(cuts), len(NAMES)))
                for k in np.unique(cuts).tolist():
                    own = np.flatnonzero(cuts == k)
                    x[own] = features(part.column(len(carry)).take(pa.array(own)), sent.value[k], seed, second)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], rows], [*carry, "x"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-2], T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; without trees (one class only in the sample) a constant chance."""

    lexicon: Lexicon
    trees: object
    calibration: object
    prior: float

    def score(self, docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
        """``carry`` and ``score``, the calibrated chance of toxicity, for every row; null text counts as empty.

        Texts are read whole. Repeated rows are scored each, an empty table gives no rows, and columns that are not carried
        are ignored. Carried columns may have any names; one named ``score`` gives way to the chance.
        """
        kept = [F.col("__carried").getField(c).alias(c) for c in carry if c != "score"]
        rows = docs.select(F.struct(*carry).alias("__carried"), F.col(text).alias("__body"))
        if self.trees is None:
            return rows.select(*kept, F.lit(self.prior).alias("score"))
        rows = with_features(rows, [self.lexicon], ["__carried"], "__body").withColumn("features", array_to_vector("x"))
        raw = self.trees.transform(rows).select("__carried", vector_to_array("probability")[1].alias("chance"))
        return self.calibration.transform(raw).select(*kept, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", rows, FOLDS, HELD)
    cut = F.pmod(F.xxhash64("__key", F.lit("cut")), F.lit(CUTS)).cast("int")
    part = F.pmod(F.xxhash64("__key", F.lit("part")), F.lit(10)).cast("int")
    sample = written(sample.select("text", cut.alias("cut"), part.alias("part"), F.col("__label").alias("y")), "toxic-sample")
    found = sample.select("text", "cut", "y").mapInArrow(_tokens, "tokens array<bigint>, cut int, y int").toArrow()
    y, cuts = found.column("y").to_numpy().astype(float), found.column("cut").to_numpy()
    tokens = [t.values.to_numpy().view(np.uint64) for t in found.column("tokens")]
    prior = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return ToxicityModel(Lexicon.learn([], y), None, None, prior)
    lexicons = [Lexicon.learn([t for t, c in zip(tokens, cuts, strict=True) if c != k], y[cuts != k]) for k in range(CUTS)]
    rows_ = written(with_features(sample, lexicons, ["part", "y"], cut="cut"), "toxic-features").withColumn("features", array_to_vector("x"))
    fitted = rows_.where("part < 7").withColumn("label", F.col("y").cast("double")).coalesce(4)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, maxBins=64, seed=2, minInstancesPerNode=5).fit(fitted)
    held = trees.transform(rows_.where("part >= 7")).select(vector_to_array("probability")[1].alias("chance"), F.col("y").cast("double").alias("label")).coalesce(1)
    calibration = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="score").fit(held)
    return ToxicityModel(Lexicon.learn(tokens, y), trees, calibration, prior)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = train(docs, table(spark, sf_dir, "labels")).score(docs, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
