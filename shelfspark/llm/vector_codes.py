"""Vectors as four-byte codes: product codebooks, searched exactly in the integers by a Walsh-Hadamard transform.

Components become integers, vectors are cut into four parts, and every part is replaced by the number of the nearest of
its codebook's entries. Parts and entries are padded with zeros to a power of two and transformed; sums of squared
differences grow by that power of two, so dividing at the end gives the squared distance without rounding. The leading
coefficients in sequency order (few sign changes) hold most of a smooth part, so they are summed first: an entry whose
partial sum is above the whole sum of some other entry is out. Every step is integer addition and multiplication, in 64 bits
where the largest value proves that nothing can overflow, else in integers of any size; both give the same codes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.registry import query, table
from shelfspark.session import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Coefficients that are summed between two eliminations.
STEP = 4
#: Rows of a batch compared with all entries at once.
ROWS = 1024
#: Doubles from here on are whole numbers, and 1024 times as much passes 64 bits or the range of doubles.
_WHOLE = float(1 << 52)


def sequency(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of ``size`` (a power of two) by their number of sign changes."""
    bits = size.bit_length() - 1
    k = np.arange(size)
    gray = k ^ (k >> 1)
    return sum(((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)) + np.zeros(size, np.int64)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, coefficients in sequency order. Sums of squares grow by the row's length."""
    size, h = x.shape[-1], 1
    order = sequency(size)
    while h < size:
        pair = x.reshape(*x.shape[:-1], size // (2 * h), 2, h)
        x = np.stack([pair[..., 0, :] + pair[..., 1, :], pair[..., 0, :] - pair[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x[..., order]


def padded(x: np.ndarray) -> np.ndarray:
    """Rows with zeros behind, up to a power of two."""
    size = 1 << max(0, (x.shape[-1] - 1).bit_length())
    out = np.zeros((*x.shape[:-1], size), x.dtype)
    out[..., : x.shape[-1]] = x
    return out


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def fits(size: int, most: int) -> bool:
    """Whether the sums of ``size`` coefficients of values up to ``most`` stay within 64 bits."""
    return 4 * size * size * most * most < 1 << 63


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest entry (the lower number of equal ones), its squared distance, and how many sums were added up to the end."""
    x, entries = padded(x), padded(entries)
    size = x.shape[1]
    kind = np.int64 if fits(size, max(_most(x), _most(entries))) else object
    x, entries = transform(x.astype(kind)), transform(entries.astype(kind))
    index, error, whole = np.zeros(len(x), np.int64), np.zeros(len(x), kind), 0
    for s in range(0, len(x), ROWS):
        row = x[s : s + ROWS]
        upto = min(STEP, size)
        sums = sum((row[:, k, None] - entries[None, :, k]) ** 2 for k in range(upto))
        guess = sums.argmin(1)
        bound = ((row - entries[guess]) ** 2).sum(1)
        i, j = np.nonzero(sums <= bound[:, None])
        part = sums[i, j]
        while upto < size:
            part = part + ((row[i, upto : upto + STEP] - entries[j, upto : upto + STEP]) ** 2).sum(1)
            upto += STEP
            ok = part <= bound[i]
            i, j, part = i[ok], j[ok], part[ok]
        whole += len(i)
        # bound holds for the guess itself, so every row is left with one entry at least; they come by row and number
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        least = np.minimum.reduceat(part, starts)
        hit = np.flatnonzero(part == np.repeat(least, np.diff(np.r_[starts, len(i)])))
        first = hit[np.r_[True, i[hit][1:] != i[hit][:-1]]]
        index[s : s + ROWS], error[s : s + ROWS] = j[first], least // size
    return index, error, whole


def integers(x: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)`` of doubles, exactly."""
    if not x.size or np.abs(x).max() < _WHOLE:
        return np.floor(x * SCALE).astype(np.int64)
    flat = [int(v) * SCALE if abs(v) >= _WHOLE else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def parts_of(column: pa.Array, dim: int) -> np.ndarray:
    """Integer parts (vector, part, component); vectors that four does not divide get zeros behind."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    whole = np.zeros((len(x), -(-dim // PARTS) * PARTS))
    whole[:, :dim] = x
    return integers(whole).reshape(len(x), PARTS, -1)


@dataclass(frozen=True)
class Codebooks:
    """Integer entries (part, entry, component) of the vectors of one length."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.ravel()).encode()).hexdigest()

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and squared distances, (vector, part) each."""
        found = [nearest(parts[:, p], self.entries[p]) for p in range(PARTS)]
        kind = np.int64 if all(f[1].dtype == np.int64 for f in found) else object
        return np.stack([f[0] for f in found], 1), np.stack([f[1].astype(kind) for f in found], 1)

    def updated(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries replaced by the floor of their parts' mean; entries without parts stay."""
        new = self.entries.astype(object)
        for (part, entry), (count, total) in sums.items():
            new[part, entry] = [t // count for t in total]
        return Codebooks(new.astype(np.int64) if _most(new) < 1 << 62 else new)

    def decoded(self, codes: list[str]) -> np.ndarray:
        """Vectors that the codes stand for."""
        at = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(-1, PARTS)
        return np.concatenate([self.entries[p, at[:, p]] for p in range(PARTS)], 1).astype(np.float64) / SCALE


def _by_length(batches):
    """(dim, vectors, batch rows) of every length in every batch; the columns are key, label, vector."""
    for batch in batches:
        size = pc.list_value_length(batch.column(2)).to_numpy()
        for d in np.unique(size).tolist():
            rows = batch.filter(pa.array(size == d))
            for s in range(0, rows.num_rows, 4 * ROWS):
                part = rows.slice(s, 4 * ROWS)
                yield d, parts_of(part.column(2), d), part


def usable(vector: Column) -> Column:
    """Vectors that are not null or empty and hold finite components only."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def first_entries(rows: DataFrame) -> dict[int, Codebooks]:
    """The parts of the vectors of the 256 smallest keys of each length; one short job a length."""
    lengths = [r["dim"] for r in rows.select(F.size("vector").alias("dim")).distinct().collect()]
    out = {}
    for d in sorted(lengths):
        first = rows.where(F.size("vector") == d).orderBy(F.col("key").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow()
        out[d] = Codebooks(parts_of(first["vector"].combine_chunks(), d).transpose(1, 0, 2).copy())
    return out


SUMS = "dim int, part int, entry int, n long, total array<string>"


def _emit(sums: dict):
    keys = list(sums)
    if keys:
        columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
        columns += [pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([[str(v) for v in sums[k][1]] for k in keys], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["dim", "part", "entry", "n", "total"])


def _add(sums: dict, key: tuple, n: int, total: list[int]):
    had = sums.get(key)
    sums[key] = (n, total) if had is None else (had[0] + n, [a + b for a, b in zip(had[1], total, strict=True)])


def _partial(books):
    """Counts and sums of the parts at each entry, one row an entry and task."""

    def run(batches):
        sums: dict = {}
        for d, x, _ in _by_length(batches):
            code, _ = books.value[d].assign(x)
            for p in range(PARTS):
                order = np.argsort(code[:, p], kind="stable")
                entry = code[order, p]
                starts = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
                total = np.add.reduceat(x[order, p], starts, 0).tolist()
                for e, n, t in zip(entry[starts].tolist(), np.diff(np.r_[starts, len(x)]).tolist(), total, strict=True):
                    _add(sums, (d, p, e), n, t)
        yield from _emit(sums)

    return run


def _combined(batches):
    sums: dict = {}
    for batch in batches:
        for d, p, e, n, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            _add(sums, (d, p, e), n, [int(v) for v in total])
    yield from _emit(sums)


def train(rows: DataFrame, rounds: int = ROUNDS) -> dict[int, Codebooks]:
    """Codebooks by vector length after ``rounds`` passes over all of ``rows`` (key, label, vector).

    A task adds up its own parts in integers of any size, sums meet by entry, and what comes back to the driver is one row
    an entry, as large as the codebooks.
    """
    books = first_entries(rows)
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)
        found = rows.mapInArrow(_partial(sent), SUMS).repartition("dim", "part", "entry").mapInArrow(_combined, SUMS).collect()
        books = {d: b.updated({(r["part"], r["entry"]): (r["n"], [int(v) for v in r["total"]]) for r in found if r["dim"] == d}) for d, b in books.items()}
        sent.unpersist()
    return books


def encode(rows: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """(key, label, code, error, books) of ``rows`` (key, label, vector): hex code, squared distance in the integers
    (null beyond 64 bits), digest of the codebooks used."""
    sent = rows.sparkSession.sparkContext.broadcast((books, {d: b.digest() for d, b in books.items()}))

    def run(batches):
        for d, x, part in _by_length(batches):
            code, error = sent.value[0][d].assign(x)
            total = [v if v < 1 << 63 else None for v in map(int, error.astype(object).sum(1))]
            names = [c.tobytes().hex() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names), pa.array(total, pa.int64()), pa.array([sent.value[1][d]] * len(x))], ["key", "label", "code", "error", "books"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, code string, error long, books string")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable vector.

    Vectors that are null, empty or hold null or non-finite components are dropped. Every length of vector is a set of its
    own with its own codebooks; a length that four does not divide counts as filled up with zeros. The first entries are the
    vectors of the smallest keys (null keys last, equal keys by vector); fewer than 256 vectors give fewer entries.
    Repeated rows count and are coded each. Ties go to the lower entry. ``error`` and ``label_error`` (over the rows of an
    equal label, nulls together) are null where they pass 64 bits. Empty tables give no rows; other columns are ignored.
    """
    named = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = named.where(usable(F.col("vector")))
    coded = written(encode(rows, train(rows)), "vector-codes")
    total = F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error")
    by_label = written(coded.groupBy(F.col("label").alias("of")).agg(total), "vector-label-errors")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.col("books").alias("codebooks_sha256"))


def _sql() -> str:
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    rounds = ""
    for r in range(ROUNDS + 1):
        # integers below 2**53, so the doubles are exact
        rounds += f""",
a{r} AS MATERIALIZED (
  SELECT rid, part, min({{'d': CAST({dot("p.x", "p.x")} - 2 * {dot("p.x", "c.x")} + {dot("c.x", "c.x")} AS BIGINT), 'e': c.e}}) AS best
  FROM p JOIN c{r} c USING (part) GROUP BY rid, part)"""
        if r < ROUNDS:
            rounds += f""",
s{r} AS (
  SELECT part, e, list(m ORDER BY k) AS x FROM (
    SELECT part, e, k, floor(sum(v) / count(*)) AS m FROM (
      SELECT part, best.e AS e, unnest(range(len(x))) AS k, unnest(x) AS v FROM p JOIN a{r} USING (rid, part)) u
    GROUP BY part, e, k) w
  GROUP BY part, e)"""
            rounds += f""",
c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (part, e))"""
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (
  SELECT rid, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM k, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS e, x FROM p WHERE rid <= {ENTRIES}){rounds},
f AS (
  SELECT rid, string_agg(lpad(lower(hex(best.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string([CAST(v AS BIGINT) FOR v IN x], ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN k USING (rid), b
"""


@query("op11_vector_codes", _sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
