"""Byte-level BPE encoding and decoding over padded numpy matrices.

The pretokenizer's pieces are encoded once per task and cache; pieces of like length form a padded matrix of
token ids. Each round every row merges its leftmost pair of minimum rank, found through a hashed pair table,
and rows close up by one column; finished rows leave. Pieces longer than ``LONGEST`` bytes use a heap per
piece, so one giant piece stays near linear. Ids are exactly those of merging by rank, one pair at a time.
"""

from __future__ import annotations

import base64
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.registry import query, table
from shelfspark.llm.words import chunks

BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 128, 256)
LONGEST = BUCKETS[-1]
#: Pieces a task keeps encoded; beyond it the cache starts anew.
CACHE = 150_000
#: Bytes of text that are cut into pieces at a time.
CHUNK = 1 << 20
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Vocabulary:
    """Tables of a vocabulary as numpy arrays, small and of fixed size: sent to all tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.pattern = pattern
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(len(key) * 3).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        rest, value = key, np.array(merged, np.int32)
        at = self._slot(rest)
        while len(rest):
            first = np.unique(at, return_index=True)[1]
            first = first[self.values[at[first]] == NONE]
            self.keys[at[first]], self.values[at[first]] = rest[first], value[first]
            placed = np.zeros(len(rest), bool)
            placed[first] = True
            rest, value, at = rest[~placed], value[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_ptr = np.r_[0, np.cumsum(lengths)]
        self.token_bytes = np.zeros(self.token_ptr[-1], np.uint8)
        for token, rank in ranks.items():
            self.token_bytes[self.token_ptr[rank] : self.token_ptr[rank + 1]] = np.frombuffer(token, np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each two neighbours joined, ``NONE`` where they are no token (or one is padding, -1)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NONE)
        rows = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[rows].astype(np.uint64) << np.uint64(32)) | right[rows].astype(np.uint64)
        at = self._slot(key)
        while len(rows):
            value = self.values[at]
            found = self.keys[at] == key
            out[rows[found]] = value[found]
            on = ~found & (value != NONE)
            rows, key, at = rows[on], key[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def merge_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most ``width`` bytes, one after another, and how many each has."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        ids = np.full((n, width), -1, np.int32)
        inside = np.arange(width)[None, :] < length[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(n), np.full((n, width), -1, np.int32)
        while len(row):
            best = rank.argmin(1)
            value = rank[np.arange(len(row)), best]
            done = value == NONE
            out[row[done], : ids.shape[1]] = ids[done]
            if done.all():
                break
            go = ~done
            row, ids, rank, best, value = row[go], ids[go], rank[go], best[go], value[go]
            each = np.arange(len(row))
            ids[each, best] = value
            w = ids.shape[1] - 1
            cols = np.arange(w)[None, :]
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            if w == 1:
                rank = np.full((len(row), 1), NONE)
                continue
            cols = np.arange(w - 1)[None, :]
            rank = np.take_along_axis(rank, cols + (cols >= best[:, None]), 1)
            right = best < w - 1
            rank[each[right], best[right]] = self.pair_ranks(ids[each[right], best[right]], ids[each[right], best[right] + 1])
            left = best > 0
            rank[each[left], best[left] - 1] = self.pair_ranks(ids[each[left], best[left] - 1], ids[each[left], best[left]])
        held = out >= 0
        return out[held], held.sum(1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece through a heap of (rank, place)."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)

        part = [piece[k : k + 1] for k in range(n)]

        def push(i: int, j: int) -> None:
            r = self.ranks.get(part[i] + part[j])
            if r is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            part[i] += part[j]
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        raw = [p.encode() for p in pieces]
        rank = np.array([self.ranks.get(p, -1) for p in raw], np.int32)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        bucket = np.where(rank >= 0, -1, np.searchsorted(BUCKETS, size))
        count = np.ones(len(raw), np.int64)
        parts = [(np.flatnonzero(rank >= 0), rank[rank >= 0])]
        for k in np.unique(bucket[bucket >= 0]).tolist():
            own = np.flatnonzero(bucket == k)
            if k == len(BUCKETS):
                found = [self.merge_long(raw[i]) for i in own.tolist()]
                count[own] = [len(x) for x in found]
                parts.append((own, np.concatenate(found)))
                continue
            step = max(1, (1 << 19) // BUCKETS[k])
            for a in range(0, len(own), step):
                some = own[a : a + step]
                flat, count[some] = self.merge_matrix([raw[i] for i in some.tolist()], BUCKETS[k])
                parts.append((some, flat))
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for own, flat in parts:
            n = count[own]
            out[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return out, count


class Encoder:
    """A vocabulary with a bounded cache of encoded pieces."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.limit = cache
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start = self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the borders of the texts."""
        found = [self.find(t) for t in texts]
        if len(self.place) > self.limit:
            self._clear()
        place = self.place
        new = list(dict.fromkeys(p for pieces in found for p in pieces if p not in place))
        if new:
            ids, length = self.v.encode_pieces(new)
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(length) - length]
            self.length = np.r_[self.length, length]
            self.flat = np.concatenate([self.flat, ids])
        n = np.array([len(x) for x in found], np.int64)
        at = np.fromiter((place[p] for pieces in found for p in pieces), np.int64, int(n.sum()))
        length = self.length[at]
        ptr = np.r_[0, np.cumsum(length)]
        ids = self.flat[np.arange(ptr[-1]) - np.repeat(ptr[:-1] - self.start[at], length)]
        return ids, ptr[np.r_[0, np.cumsum(n)]]


def decode(v: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids one after another, and the borders of the ids."""
    length = v.token_ptr[ids + 1] - v.token_ptr[ids]
    ptr = np.r_[0, np.cumsum(length)]
    return v.token_bytes[np.arange(ptr[-1]) - np.repeat(ptr[:-1] - v.token_ptr[ids], length)], ptr


def _bytes(raw: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def send_vocabulary(spark: SparkSession, path: str, pattern: str):
    return spark.sparkContext.broadcast(Vocabulary(load_ranks(path), pattern))


def encode_texts(docs: DataFrame, vocabulary, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all but the text) and ``ids``. Null or empty text: no ids.

    Repeated rows are encoded each; a carried column named ids is replaced.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in ("ids", text)]
    df = docs.select(*carry, F.col(text).cast("string").alias("__text"))

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for part in chunks(batch, "__text", CHUNK):
                ids, ptr = encoder.encode([t or "" for t in part.column(len(carry)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids, pa.int32()))], [*carry, "ids"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(encoded: DataFrame, vocabulary, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the bytes of the ids. Null ids: null."""
    columns = [c for c in encoded.columns if c != "decoded"]
    df = encoded.select(*columns, F.col(ids).alias("__ids"))

    def run(batches):
        v = vocabulary.value
        for batch in batches:
            lists = batch.column(len(columns))
            own = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            raw, ptr = decode(v, lists.flatten().to_numpy().astype(np.int64))
            off = ptr[np.r_[0, np.cumsum(own)]]
            out = pc.if_else(lists.is_valid(), _bytes(raw, off), None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], out], [*columns, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns, ``ids`` and ``decoded``: both operators in one Python worker, so a task holds the vocabulary once."""
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in ("ids", "decoded", text)]
    df = docs.select(*carry, F.col(text).cast("string").alias("__text"))

    def run(batches):
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for part in chunks(batch, "__text", CHUNK):
                ids, ptr = encoder.encode([t or "" for t in part.column(len(carry)).to_pylist()])
                raw, off = decode(vocabulary.value, ids.astype(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], lists, _bytes(raw, off[ptr])], [*carry, "ids", "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]))


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens, digest of the ids and digest of the decoded bytes, per row of ``docs``."""
    import public_tokenizers

    vocabulary = send_vocabulary(docs.sparkSession, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    decoded = round_trip(docs, vocabulary, text, [key])
    return decoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
