"""Structure statistics of whole texts and labelled samples, shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.words import _lower, Words, words

#: Lines as "words": everything but the line feed.
LINES = _lower(lambda b: b != 10)
_CLASSES = {
    "upper": lambda b: 65 <= b <= 90,
    "lower": lambda b: 97 <= b <= 122,
    "digit": lambda b: 48 <= b <= 57,
    "blank": lambda b: b in (9, 11, 12, 13, 32),
    "feed": lambda b: b == 10,
    "stop": lambda b: b in (33, 44, 46, 58, 59, 63),
    "odd": lambda b: b < 128 and chr(b) in "#$%&*+<=>@\\^_`|~/{}[]",
    "quote": lambda b: b < 128 and chr(b) in "\"'()-",
    "beyond": lambda b: b >= 128,
    "bang": lambda b: b in (33, 63),
}
_TABLE = {name: np.array([f(b) for b in range(256)], np.uint8) for name, f in _CLASSES.items()}


def byte_counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Bytes of each class per text."""
    out = {}
    total = np.zeros(len(raw) + 1, np.int64)
    for name, mark in _TABLE.items():
        np.cumsum(mark[raw], out=total[1:])
        out[name] = total[off[1:]] - total[off[:-1]]
    return out


def distinct(ptr: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of different hashes, and the count of the most frequent."""
    n = len(ptr) - 1
    if not len(h):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(ptr))
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(h)])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], count)
    return np.bincount(d[at], minlength=n), top


NAMES = [
    *(f"{c}_rate" for c in _CLASSES),
    "log_bytes",
    "log_words",
    "word_bytes",
    "log_longest_word",
    "distinct_words",
    "top_word",
    "log_lines",
    "repeated_lines",
    "words_a_line",
    "capital_words",
    "shouted_words",
    "odd_words",
]


def structure(texts: pa.Array, w: Words) -> np.ndarray:
    """One row of ``NAMES`` per text, all finite; an empty text has zeros."""
    raw, off, n_words = w.raw, w.offsets, w.counts
    size = np.diff(off)
    per = np.maximum(size, 1)
    counts = byte_counts(raw, off)
    some = np.maximum(n_words, 1)
    length = w.ends - w.starts
    total = np.r_[0, np.cumsum(length)]
    longest = np.zeros(len(size), np.int64)
    np.maximum.at(longest, w.doc, length)
    kinds, top = distinct(w.ptr, w.hash)
    lines = words(texts, LINES)
    line_kinds, _ = distinct(lines.ptr, lines.hash)
    n_lines = np.maximum(lines.counts, 1)
    first = _TABLE["upper"][raw[w.starts]] if len(length) else np.zeros(0, np.uint8)
    upto = np.r_[0, np.cumsum(_TABLE["upper"][raw], dtype=np.int64)]
    shouted = (length > 1) & (upto[w.ends] - upto[w.starts] == length)
    after = np.minimum(w.ends, max(len(raw) - 1, 0))
    odd = _TABLE["odd"][raw[after]] if len(length) else np.zeros(0, np.uint8)
    per_text = lambda mark: np.diff(np.r_[0, np.cumsum(mark, dtype=np.int64)][w.ptr]) / some
    columns = [c / per for c in counts.values()]
    columns += [np.log1p(size), np.log1p(n_words), np.diff(total[w.ptr]) / some, np.log1p(longest), kinds / some, top / some, np.log1p(lines.counts)]
    columns += [1 - line_kinds / n_lines * (lines.counts > 0) - (lines.counts == 0), n_words / n_lines, per_text(first), per_text(shouted), per_text(odd)]
    return np.stack(columns, 1)


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def bounded(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most ``rows`` rows by a hash of ``by`` and the row's place in the scan, so that equal rows are as rare here as in all.

    One count fixes the share of hashes that is taken, so only about ``rows`` rows ever move to the one task
    that cuts them, whatever the number of partitions.
    """
    total, parts = df.count(), 1 << 30
    take = min(parts, -(-parts * 5 * rows // (4 * max(total, 1))))
    hashed = df.withColumn("__hash", F.pmod(F.xxhash64(*by, F.monotonically_increasing_id()), F.lit(parts)))
    return hashed.where(F.col("__hash") < take).orderBy("__hash").limit(rows).drop("__hash")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, parts: int, held: int, key: str = "doc_id", carry: tuple[str, ...] = ("text",)) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, with the column ``label``.

    Chosen by a hash of the key, so the sample is the same in every run; a key labelled twice counts once, by
    the mean of its labels. The chosen labels are at most ``rows`` rows and are broadcast; repeated rows of a
    chosen document are cut to ``rows`` in total.
    """
    one = labels.where(F.col(label).isNotNull() & (fold(key, parts) != held)).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    chosen = one.orderBy(F.xxhash64(key), key).limit(rows)
    found = docs.select(key, *carry).join(F.broadcast(chosen), key).orderBy(F.xxhash64(key), key).limit(rows)
    return found.select(F.col(key).alias("__key"), *carry, F.col("__label"))
