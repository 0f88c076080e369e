"""Document quality by a factorisation machine.

Inputs: hashed words (term frequency, length one), structure statistics of the text, and its recorded
number of characters. All pairs of inputs interact through low-rank vectors; a text is scored in time
linear in its inputs by half of (squared sum minus sum of squares). Trained by AdaGrad on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.registry import query, table
from shelfspark.llm.stats import NAMES, fold, labelled_sample, structure
from shelfspark.llm.words import chunks, words

BUCKETS = 1 << 16
RANK = 8
#: Labelled rows the machine is fitted on, at most.
SAMPLE_ROWS = 6000
FOLDS, HELD = 4, 2
ACCEPT = 0.7
#: The filter rejects only what is likelier bad than good, so that clean texts stay.
REJECT = 0.5
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.1, 2e-4
#: Small samples are passed through more often, up to so many steps.
LEAST_STEPS = 1200


def inputs(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(borders, bucket, value) of the hashed words of each text, and the dense inputs."""
    w = words(texts)
    n = len(w.counts)
    key = w.doc.astype(np.int64) * BUCKETS + (w.hash >> np.uint64(64 - 16)).astype(np.int64)
    kinds, count = np.unique(key, return_counts=True)
    doc = kinds // BUCKETS
    norm = np.sqrt(np.bincount(doc, count.astype(np.float64) ** 2, n)) if n else np.zeros(0)
    ptr = np.searchsorted(doc, np.arange(n + 1))
    chars = n_chars.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    known = np.isfinite(chars) & (chars >= 0)
    meta = np.stack([known, np.log1p(np.where(known, chars, 0))], 1)
    return ptr, kinds % BUCKETS, (count / norm[doc]).astype(np.float32), np.concatenate([structure(texts, w), meta], 1)


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows between borders; empty runs give 0."""
    out = np.zeros((len(ptr) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, ptr[:-1][full], axis=0, dtype=np.float64)
    return out


@dataclass
class FactorMachine:
    """Bias, weights and vectors of the hashed words and of the dense inputs, which are standardised."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    dw: np.ndarray
    dv: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5) / np.sqrt(len(self.mean))

    def margin(self, ptr: np.ndarray, at: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = self.dense(x)
        vx = self.v[at] * value[:, None]
        total = _sums(vx, ptr) + x @ self.dv
        squares = _sums(vx * vx, ptr) + (x * x) @ (self.dv * self.dv)
        return self.bias + _sums(self.w[at] * value, ptr) + x @ self.dw + 0.5 * (total * total - squares).sum(1)

    def score(self, *rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*rows), -30, 30)))


def fit(ptr: np.ndarray, at: np.ndarray, value: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 6) -> FactorMachine:
    """AdaGrad on the log loss. One class only, or no rows: a constant score."""
    rng = np.random.default_rng(seed)
    dense = x.shape[1]
    scale = x.std(0) if len(x) else np.ones(dense)
    m = FactorMachine(0.0, np.zeros(BUCKETS, np.float32), rng.normal(0, 0.01, (BUCKETS, RANK)).astype(np.float32), np.zeros(dense), rng.normal(0, 0.01, (dense, RANK)), x.mean(0) if len(x) else np.zeros(dense), np.where(scale > 1e-9, scale, 1.0))
    rate = (y.sum() + 1) / (len(y) + 2)
    m.bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return m
    z = m.dense(x)
    gw, gv, gdw, gdv, gb = np.full(BUCKETS, 1e-2), np.full((BUCKETS, RANK), 1e-2), np.full(dense, 1e-2), np.full((dense, RANK), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            own = order[k : k + BATCH]
            n = ptr[own + 1] - ptr[own]
            row = np.repeat(np.arange(len(own)), n)
            pick = np.repeat(ptr[own] - (np.cumsum(n) - n), n) + np.arange(len(row))
            i, a = at[pick], value[pick]
            border = np.r_[0, np.cumsum(n)]
            vx = m.v[i] * a[:, None]
            total = _sums(vx, border) + z[own] @ m.dv
            squares = _sums(vx * vx, border) + z[own] ** 2 @ (m.dv * m.dv)
            margin = m.bias + _sums(m.w[i] * a, border) + z[own] @ m.dw + 0.5 * (total * total - squares).sum(1)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own]) / len(own)
            kinds, inverse = np.unique(i, return_inverse=True)
            ga = g[row] * a
            step = np.bincount(inverse, ga, len(kinds)) + DECAY * m.w[kinds]
            gw[kinds] += step**2
            m.w[kinds] -= RATE * step / np.sqrt(gw[kinds])
            push = ga[:, None] * (total[row] - vx)
            for f in range(RANK):
                step = np.bincount(inverse, push[:, f], len(kinds)) + DECAY * m.v[kinds, f]
                gv[kinds, f] += step**2
                m.v[kinds, f] -= 0.3 * RATE * step / np.sqrt(gv[kinds, f])
            step = z[own].T @ g + DECAY * m.dw
            gdw += step**2
            m.dw -= RATE * step / np.sqrt(gdw)
            step = z[own].T @ (g[:, None] * total) - (z[own] ** 2).T @ g[:, None] * m.dv + DECAY * m.dv
            gdv += step**2
            m.dv -= 0.3 * RATE * step / np.sqrt(gdv)
            gb += g.sum() ** 2
            m.bias -= RATE * g.sum() / np.sqrt(gb)
    return m


def _feature_rows(batches):
    for batch in batches:
        for part in chunks(batch):
            ptr, at, value, x = inputs(part.column(0), part.column(1))
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(v, kind))
            dense = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists(at, pa.int32()), lists(value, pa.float32()), dense, part.column(2)], ["at", "value", "dense", "y"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> FactorMachine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold; only their inputs reach the driver."""
    sample = labelled_sample(docs, labels, "quality", rows, FOLDS, HELD, carry=("text", "n_chars"))
    found = sample.select("text", "n_chars", F.col("__label").alias("y")).mapInArrow(_feature_rows, "at array<int>, value array<float>, dense array<double>, y int").toArrow()
    lists = found.column("at").combine_chunks()
    ptr = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
    x = found.column("dense").combine_chunks().flatten().to_numpy().reshape(len(lists), len(NAMES) + 2)
    return fit(ptr, lists.flatten().to_numpy(), found.column("value").combine_chunks().flatten().to_numpy(), x, found.column("y").to_numpy())


def quality_scores(docs: DataFrame, model: FactorMachine, carry: list[str] | None = None, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The ``carry`` columns (default: all) and ``score``, the chance of quality 1, for every row.

    Null text counts as empty, null ``n_chars`` as unknown; a carried column named score is replaced.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c != "score"]
    df = docs.select(*carry, F.col(text).cast("string").alias("__text"), F.col(n_chars).cast("double").alias("__chars"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text"):
                score = sent.value.score(*inputs(part.column(len(carry)), part.column(len(carry) + 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(score)], [*carry, "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-2], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents the classifier does not reject, with their own columns only."""
    model = train(docs, labels)
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__body"), F.col("n_chars").alias("__n"))
    return quality_scores(packed, model, ["__row"], "__body", "__n").where(F.col("score") >= REJECT).select("__row.*")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
