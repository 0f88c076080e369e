"""Words and their hashes for whole Arrow batches, by numpy over the UTF-8 bytes.

Both word classes in use are byte classes: every byte of a non-ASCII character is
128 or more and belongs to a word, so cutting bytes cuts the same words as a regular
expression over characters. Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _lower(inside) -> np.ndarray:
    """Per byte: its lower-case value where it belongs to a word, else 0; the value is one higher so that byte 0 can belong."""
    table = np.zeros(256, np.uint16)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if inside(low):
            table[b] = low + 1
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text: digits, letters, everything beyond ASCII.
ALNUM = _lower(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
NONSPACE = _lower(lambda b: not (b == 32 or 9 <= b <= 13))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """First ``n`` powers of the base or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        steps = np.full(n, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


@dataclass
class Words:
    """Words of a chunk of texts; ``ptr[i]:ptr[i + 1]`` are those of text ``i``."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray
    total: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than ``n`` bytes and the hash of their first ``n`` bytes."""
        k = np.flatnonzero(self.ends - self.starts > n)
        at = self.starts[k]
        with np.errstate(over="ignore"):
            return k, mix((self.total[at + n] - self.total[at]) * _power("down", len(self.raw))[at] + np.uint64(n))

    def bytes_of(self, k: int) -> bytes:
        """Word ``k``, A-Z lower-cased."""
        return self.raw[self.starts[k] : self.ends[k]].tobytes().lower()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(texts: pa.Array, table: np.ndarray = ALNUM) -> Words:
    """All words of the texts with a 64-bit hash of each."""
    raw, off = text_bytes(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, np.zeros(len(off), np.int64), np.zeros(0, np.uint64), off, np.zeros(1, np.uint64))
    low = table[raw]
    inside = low > 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(low * _power("up", len(raw)), out=total[1:])
        h = (total[ends] - total[starts]) * _power("down", len(raw))[starts]
        h = mix(h)
    return Words(raw, starts, ends, np.searchsorted(starts, off).astype(np.int64), h, off, total)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive word hashes (over the whole array, text borders included)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out *= _BASE
            out += h[k : len(h) - n + 1 + k]
        return mix(out)


def inside_text(ptr: np.ndarray, total: int, n: int) -> np.ndarray:
    """Whether the ``n`` words from each position on lie in one text."""
    if total < n:
        return np.zeros(0, bool)
    ok = np.zeros(total - n + 1, bool)
    last = ptr[1:] - n + 1
    step = np.zeros(total - n + 2, np.int64)
    long = last > ptr[:-1]
    np.add.at(step, ptr[:-1][long], 1)
    np.add.at(step, last[long], -1)
    ok[:] = np.cumsum(step)[:-1] > 0
    return ok
