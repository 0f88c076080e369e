"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (an item of fewer words is
one window). A window's set elements are its short shingles, ordered by how rare they are in the
corpus. Containment is asked for in full, so the necessary prefix is one element: a document that
holds the window holds its rarest shingle. Documents are joined with these prefix shingles; the
place of the shingle in the window bounds where the window can lie (position) and whether it fits
into the text (length); survivors are compared word by word, then byte by byte.

Item windows are the only thing sent to all tasks, in blocks of at most ``BLOCK_BYTES`` of item
text; each block is one more pass over the documents, so no benchmark is too large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.registry import query, table
from shelfspark.llm.words import Words, chunks, inside_text, shingles, words
from shelfspark.session import written

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 8 << 20


class Lookup:
    """Place of 64-bit keys in a sorted array, behind a bitmap that turns most misses away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = min(26, max(16, int(len(self.keys) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are keys, and which key each is."""
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[h >> self.shift])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


class ItemWindows:
    """Windows of a block of items, with the word hashes and bytes of each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE):
        w = words(pa.array([t for _, t in items], pa.string()))
        self.items = [i for i, _ in items]
        self.window = window
        start, length, item = [], [], []
        for i, (a, b) in enumerate(zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True)):
            size = min(window, b - a)
            if size:
                n = b - a - size + 1
                start.append(np.arange(a, a + n))
                length.append(np.full(n, size))
                item.append(np.full(n, i))
        none = np.zeros(0, np.int64)
        self.start, self.length, self.item = (np.concatenate(x) if x else none for x in (start, length, item))
        self.hashes = np.zeros((len(self.start), window), np.uint64)
        for k in range(window):
            own = self.length > k
            self.hashes[own, k] = w.hash[self.start[own] + k]
        self.text = [b" ".join(w.bytes_of(k) for k in range(s, s + n)) for s, n in zip(self.start.tolist(), self.length.tolist(), strict=True)]
        self.size = np.minimum(shingle, self.length)
        self.tokens = {}
        for q in np.unique(self.size).tolist():
            h = shingles(w.hash, q)
            own = np.flatnonzero(self.size == q)
            places = [(np.full(n, v), np.arange(n), s) for v, s, n in zip(own, self.start[own], self.length[own] - q + 1, strict=True)]
            win, off = np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places])
            self.tokens[q] = (win, off, h[self.start[win] + off])


class PrefixIndex:
    """The rarest shingle of each window, by size of the shingle."""

    def __init__(self, windows: ItemWindows, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.w = windows
        self.by_size = {}
        for q, (win, off, token) in windows.tokens.items():
            keys, n = counts.get(q, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            seen = np.zeros(len(token), np.int64)
            if len(keys):
                k = np.minimum(np.searchsorted(keys, token), len(keys) - 1)
                seen = np.where(keys[k] == token, n[k], 0)
            order = np.lexsort((off, seen, win))
            first = order[np.r_[True, win[order][1:] != win[order][:-1]]]
            # a prefix shingle that no document holds cannot match
            first = first[seen[first] > 0]
            lookup = Lookup(token[first])
            by = np.argsort(token[first], kind="stable")
            self.by_size[q] = (lookup, win[first][by], off[first][by], np.searchsorted(token[first][by], np.r_[lookup.keys]), len(first))

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window in the chunk."""
        starts, wins = [], []
        for q, (lookup, win, off, ptr, n) in self.by_size.items():
            at, key = lookup.find(shingles(w.hash, q))
            if not len(at):
                continue
            to = np.r_[ptr[1:], n][key]
            reps = to - ptr[key]
            at = np.repeat(at, reps)
            row = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(ptr[key], reps)
            start, v = at - off[row], win[row]
            doc = np.searchsorted(w.ptr, at, side="right") - 1
            ok = (start >= w.ptr[doc]) & (start + self.w.length[v] <= w.ptr[doc + 1])
            start, v = start[ok], v[ok]
            for k in range(self.w.window):
                longer = self.w.length[v] > k
                ok = ~longer
                ok[longer] = w.hash[start[longer] + k] == self.w.hashes[v[longer], k]
                start, v = start[ok], v[ok]
            starts.append(start)
            wins.append(v)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, v = np.concatenate(starts), np.concatenate(wins)
        same: dict[tuple[int, bytes], bool] = {}
        ok = np.zeros(len(v), bool)
        for i, (s, k) in enumerate(zip(start.tolist(), v.tolist(), strict=True)):
            last = s + int(self.w.length[k]) - 1
            seen = (k, w.raw[w.starts[s] : w.ends[last]].tobytes())
            if seen not in same:
                same[seen] = b" ".join(w.bytes_of(j) for j in range(s, last + 1)) == self.w.text[k]
            ok[i] = same[seen]
        return start[ok], v[ok]

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Per text: words, words inside a window, their runs (in words, end exclusive), and the items found."""
        w = words(texts)
        start, v = self.matches(w)
        step = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + self.w.length[v], -1)
        inside = np.cumsum(step)[:-1] > 0
        n = len(w.ptr) - 1
        doc = np.searchsorted(w.ptr, start, side="right") - 1
        n_hit = np.add.reduceat(np.r_[inside, False].astype(np.int64), w.ptr[:-1]) * (w.counts > 0) if n else np.zeros(0, np.int64)
        runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        for d in np.unique(doc).tolist():
            a, b = w.ptr[d], w.ptr[d + 1]
            turn = np.flatnonzero(np.diff(np.r_[False, inside[a:b], False]))
            runs[d] = list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))
        for d, i in sorted(set(zip(doc.tolist(), self.w.item[v].tolist(), strict=True))):
            items[d].append(self.w.items[i])
        return w.counts, n_hit, runs, [sorted(set(x)) for x in items]


def item_blocks(bench: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded text. A null id counts as the id 'null', null text has no words."""
    rows = bench.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        yield [(r["id"], r["t"]) for r in rows.collect()]
        return
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id", "t"), F.lit(n)))
    for b in range(n):
        yield [(r["id"], r["t"]) for r in rows.where(F.col("b") == b).collect()]


def corpus_counts(docs: DataFrame, windows: ItemWindows, text: str = "text") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each shingle of the items occurs in all documents: at most one row per shingle comes back."""
    spark = docs.sparkSession
    keys = spark.sparkContext.broadcast({q: np.unique(t[2]) for q, t in windows.tokens.items()})

    def count(batches):
        lookups = {q: Lookup(k) for q, k in keys.value.items()}
        total = {q: np.zeros(len(k.keys), np.int64) for q, k in lookups.items()}
        for batch in batches:
            for part in chunks(batch, "t"):
                w = words(part.column(0))
                for q, lookup in lookups.items():
                    at, key = lookup.find(shingles(w.hash, q))
                    ok = inside_text(w.ptr, len(w.hash), q)[at]
                    total[q] += np.bincount(key[ok], minlength=len(lookup.keys))
        for q, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), pa.array(lookups[q].keys[at].view(np.int64)), pa.array(n[at])], ["q", "h", "n"])

    found = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "q int, h long, n long").groupBy("q", "h").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for q, own in found.groupby("q"):
        h = own["h"].to_numpy().view(np.uint64)
        by = np.argsort(h)
        out[int(q)] = (h[by], own["n"].to_numpy()[by])
    return out


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", carry: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words, hit words, their runs and the items found, for every row of ``docs``.

    Returns the ``carry`` columns (default: all) plus ``n_words``, ``n_hit``, ``hit_runs`` (in words, end
    exclusive) and ``items`` (ids as strings, each once, sorted). A column of such a name in ``docs`` is
    replaced. Null or empty text has no words and no hits; an empty benchmark hits nothing; repeated rows
    each get their result.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_hit", "hit_runs", "items")
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in added]
    run = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    df = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    extra = [T.StructField("n_words", T.LongType()), T.StructField("hit_runs", T.ArrayType(run)), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*df.schema.fields, *extra])
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for k, block in enumerate(item_blocks(bench, item_key, item_text, block_bytes)):
        windows = ItemWindows(block, window)
        if k:
            df = written(df, "decontaminated")
        index = spark.sparkContext.broadcast(PrefixIndex(windows, corpus_counts(df, windows, "__text")))

        def scan(batches, index=index, later=k > 0):
            for batch in batches:
                for part in chunks(batch, "__text"):
                    at = part.schema.get_field_index("__text")
                    n_words, _, runs, items = index.value.hits(part.column(at))
                    if later:
                        old = part.column(part.schema.get_field_index("hit_runs")).to_pylist()
                        runs = [merged(a, b) for a, b in zip(old, runs, strict=True)]
                        old = part.column(part.schema.get_field_index("items")).to_pylist()
                        items = [sorted(set(a) | set(b)) for a, b in zip(old, items, strict=True)]
                    columns = [*part.columns[: len(carry) + 1], pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], run_type), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, [*carry, "__text", "n_words", "hit_runs", "items"])

        df = df.mapInArrow(scan, schema)
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]).cast("long"))
    return df.drop("__text").withColumn("n_hit", hit)


def merged(old: list[dict], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of two lists of runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([(r["start"], r["end"]) for r in old] + new):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """Documents without a hit word, with their own columns only."""
    inner = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__body"))
    found = contamination(inner, bench, "__body", carry=["__row"])
    return found.where("n_hit = 0").select("__row.*")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT item, least(10, len(w)) AS l, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
g AS (
  SELECT rid, i, l, array_to_string(w[i : i + l - 1], ' ') AS s
  FROM (SELECT rid, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT g.rid, g.i, g.l, win.item FROM g JOIN win ON g.l = win.l AND g.s = win.s),
marks AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(generate_series(i, i + l - 1)) AS p FROM hit) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (rid) LEFT JOIN found USING (rid)
"""


@query("op9_decontaminate", SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    """Digest of the item list as the query gives it (used by the brute-force test)."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
