"""Jaccard self-join of documents on word five-shingles, by chosen paths.

1. A document's set is turned into ``T`` min-hashes, so that two documents agree in a position with the
   probability of their Jaccard similarity. Documents with the same words in the same order are one class.
2. Every run samples tokens (positions); a class falls into the bucket of its value there. A bucket of at
   most ``LIMIT`` classes is compared by brute force; a larger one is split again on positions sampled by
   its own path, until it is small or a split no longer shrinks it (then it is compared in blocks).
   The chance to miss a pair at the threshold (no shared root position in any run, or too few agreeing min-hashes to be
   likely) is :func:`miss_chance`, below 1e-11.
3. Buckets leave only a spanning forest of their likely pairs. In its components all pairs are compared
   exactly on the whole shingle sets, in blocks: each pair once, so the number of links is exact.

Nothing but sampled path keys is shuffled for classes that share no bucket with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.components import components
from shelfspark.llm.forest import forest
from shelfspark.llm.registry import query, table
from shelfspark.llm.words import chunks, inside_text, mix, shingles, words
from shelfspark.session import written

SHINGLE = 5
THRESHOLD = 0.8
T = 64
RUNS = 20
LIMIT = 2048
#: Classes of a bucket that one task compares at a time; a larger bucket is compared in pairs of such blocks.
BLOCK = 2048
#: A split that leaves more than this share of its bucket together does not help any more.
DENSE = 0.7
MAX_DEPTH = 12
#: Share of agreeing min-hashes from which a pair is likely and compared exactly: 27 of 64.
LIKELY = 27 / 64
TILE = 256
BLOOM_BITS = 26

_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sampled(paths: np.ndarray, rate: float) -> np.ndarray:
    """Whether each path samples each position; a path samples one position at least."""
    with np.errstate(over="ignore"):
        draw = mix(paths.astype(np.uint64)[:, None] * np.uint64(T) + np.arange(T, dtype=np.uint64)[None, :] + np.uint64(1))
    take = draw < np.uint64(int(rate / T * 2**64))
    take[np.arange(len(paths)), draw.argmin(1)] = True
    return take


#: Positions sampled at the root by any of the runs, each with expectation one over the threshold.
ROOT = np.flatnonzero(sampled(np.arange(RUNS), 1 / THRESHOLD).any(0))


def miss_chance(similarity: float = THRESHOLD) -> float:
    """Bound of the chance that a pair of this similarity is not compared exactly, where its buckets need no split.

    All runs look at the same min-hashes: the pair shares no root position of any run, or it agrees in fewer than
    ``LIKELY`` of all positions. A split bucket samples two positions of its own path more, or is compared whole.
    """
    need = int(np.ceil(LIKELY * T))
    unlikely = sum(comb(T, k) * similarity**k * (1 - similarity) ** (T - k) for k in range(need))
    return unlikely + (1 - similarity) ** len(ROOT)


def child(path: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(path + position.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + value.astype(np.uint64)).view(np.int64)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, their borders, and a class hash of each text's words (0: no words).

    A text of fewer than ``n`` words but not none has one shingle, all its words.
    """
    w = words(texts)
    count = w.counts
    own = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    ptr = np.r_[0, np.cumsum(own)]
    out = np.zeros(ptr[-1], np.uint64)
    full = np.repeat(count >= n, own)
    out[full] = shingles(w.hash, n)[inside_text(w.ptr, len(w.hash), n)]
    with np.errstate(over="ignore"):
        place = np.arange(len(w.hash)) - np.repeat(w.ptr[:-1], count)
        tagged = mix(w.hash + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        whole = np.add.reduceat(np.r_[tagged, np.uint64(0)], w.ptr[:-1]) if len(count) else np.zeros(0, np.uint64)
    cls = np.where(count > 0, mix(whole + count.astype(np.uint64)) | np.uint64(1), np.uint64(0))
    short = (count > 0) & (count < n)
    out[ptr[:-1][short]] = cls[short]
    return out, ptr, cls


def signatures(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Min-hashes of non-empty sets, one row each."""
    out = np.zeros((len(ptr) - 1, T), np.uint32)
    if len(out):
        with np.errstate(over="ignore"):
            for k, f in enumerate(_FACTORS):
                out[:, k] = np.minimum.reduceat((sets * f) >> np.uint64(32), ptr[:-1]).astype(np.uint32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def classed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, cls, sig): class and min-hashes of every row. Without words: class and sig are null."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, "__text"):
                sets, ptr, cls = shingle_sets(part.column(1))
                held = cls != 0
                sig = signatures(sets, np.r_[ptr[:-1][held], ptr[-1]])
                full = pa.array(np.where(held, np.cumsum(held) - 1, 0), mask=~held)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls.view(np.int64), mask=~held), _binary(sig).take(full)], [key, "cls", "sig"])

    rows = docs.select(key, F.col(text).cast("string").alias("__text"))
    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, cls long, sig binary")


def _root_paths(batches):
    for batch in batches:
        cls, sig = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint32, T)
        path = child(np.zeros((len(cls), len(ROOT)), np.uint64), np.broadcast_to(ROOT, (len(cls), len(ROOT))), sig[:, ROOT])
        yield pa.RecordBatch.from_arrays([pa.array(path.ravel()), pa.array(np.repeat(cls, len(ROOT)))], ["path", "cls"])


def _split_paths(batches):
    for batch in batches:
        path, size, cls = (batch.column(k).to_numpy() for k in range(3))
        sig = _matrix(batch.column(3), np.uint32, T)
        row, at = np.nonzero(sampled(path.view(np.uint64), 2.0))
        new = child(path.view(np.uint64)[row], at, sig[row, at])
        yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(cls[row]), pa.array(size[row])], ["path", "cls", "parent_size"])


def _grouped(batches, keys: int, limit_rows: int = 1 << 16):
    """Batches of whole groups: rows of equal first ``keys`` columns, which come sorted, are never cut apart."""
    held: list[pa.RecordBatch] = []
    rows, usual = 0, limit_rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < limit_rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        change = _changes(whole, keys)
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield whole.slice(0, cut)
        held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
        limit_rows = max(limit_rows, rows * 2) if not cut else usual
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(rows: pa.Table, keys: int) -> np.ndarray:
    """Rows at which a new group begins, but for the first."""
    differs = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in range(keys):
        v = rows.column(k).to_numpy()
        differs |= v[1:] != v[:-1]
    return np.flatnonzero(differs) + 1


def likely_pairs(sig: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one group that agree in enough min-hashes. Brute force, small groups side by side."""
    need = int(np.ceil(LIKELY * T))
    left, right = [], []
    size = np.diff(cuts)
    small = size <= 64
    group_end = np.repeat(cuts[1:], size)
    rows = np.flatnonzero(np.repeat(small, size))
    step = 1
    while len(rows):
        rows = rows[rows + step < group_end[rows]]
        for k in range(0, len(rows), 1 << 16):
            r = rows[k : k + (1 << 16)]
            ok = (sig[r] == sig[r + step]).sum(1) >= need
            left.append(r[ok])
            right.append(r[ok] + step)
        step += 1
    for a, b in zip(cuts[:-1][~small].tolist(), cuts[1:][~small].tolist(), strict=True):
        for k in range(a, b, 128):
            to = min(b, k + 128)
            same = (sig[k:to, None, :] == sig[None, k:b, :]).sum(2, dtype=np.uint8) >= need
            i, j = np.nonzero(np.triu(same, 1))
            i, j = forest(i, j)  # within the strip only a forest is needed
            left.append(i + k)
            right.append(j + k)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def _bucket_forest(batches):
    for rows in _grouped(batches, 2):
        cuts = np.r_[0, _changes(rows, 2), rows.num_rows]
        cls, sig = rows.column(2).to_numpy(), _matrix(rows.column(3).combine_chunks(), np.uint32, T)
        i, j = likely_pairs(sig, cuts)
        a, b = forest(cls[i], cls[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def block_pairs(block, blocks):
    """All unordered pairs of blocks that hold ``block``, as one number each."""
    other = F.sequence(F.lit(0).cast("long"), blocks - 1)
    return F.transform(other, lambda o: F.least(block, o) * blocks + F.greatest(block, o))


def candidate_links(classes: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Forest of likely pairs of classes (cls, sig): the recursive splitting and the buckets' brute force."""
    rows = classes.mapInArrow(_root_paths, "path long, cls long").withColumn("parent_size", F.lit(None).cast("long"))
    found = None
    for depth in range(MAX_DEPTH + 1):
        rows = written(rows, "paths")
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        rows = written(rows.join(sizes, "path"), "buckets")
        dense = F.coalesce(F.col("size") >= DENSE * F.col("parent_size"), F.lit(False))
        leaf = (F.col("size") <= limit) | dense | F.lit(depth == MAX_DEPTH)
        blocks = F.ceil(F.col("size") / block)
        ends = rows.where(leaf).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")))
        ends = ends.select("path", F.explode(block_pairs(F.col("own"), F.col("blocks"))).alias("block"), "cls")
        ends = ends.join(classes, "cls").select("path", "block", "cls", "sig")
        links = ends.repartition("path", "block").sortWithinPartitions("path", "block").mapInArrow(_bucket_forest, "a long, b long")
        links = written(links, "likely")
        found = links if found is None else found.unionByName(links)
        large = rows.where(~leaf)
        if depth == MAX_DEPTH or large.isEmpty():
            return found
        rows = large.join(classes, "cls").select("path", "size", "cls", "sig").mapInArrow(_split_paths, "path long, cls long, parent_size long")
    return found


def _bloom(members: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Bitmap of fixed size over the classes: most others are known not to be among them."""
    place = F.call_function("shiftrightunsigned", F.col("cls"), F.lit(1)).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    found = members.groupBy(F.floor(place / 64).alias("w")).agg(F.bit_or(one).alias("v"))
    out = np.zeros((1 << bits) // 64, np.int64)
    for batch in found.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def candidate_sets(docs: DataFrame, members: DataFrame, text: str = "text") -> DataFrame:
    """``members`` with ``set``, the whole shingle set of each class; a task sends a class once."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(members))
    mask = np.uint64((1 << BLOOM_BITS) - 1)

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "__text"):
                sets, ptr, cls = shingle_sets(part.column(0))
                place = ((cls >> np.uint64(1)) & mask).astype(np.int64)
                hit = (cls != 0) & ((bloom.value[place >> 6] >> (place & 63)) & 1).astype(bool)
                names, own = [], []
                for k in np.flatnonzero(hit).tolist():
                    c = int(cls[k].view(np.int64))
                    if c not in sent:
                        sent.add(c)
                        names.append(c)
                        own.append(np.unique(sets[ptr[k] : ptr[k + 1]]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(own, pa.binary())], ["cls", "set"])

    found = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "cls long, set binary")
    return found.join(members, "cls").dropDuplicates(["cls"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n <= 8:
        out = np.diag(size)
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    doc = np.repeat(np.arange(n), size)
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[word] > 1
    name = np.cumsum(count > 1) - 1
    doc, word = doc[shared], name[word[shared]]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(word, kind="stable")
    doc, word = doc[order], word[order]
    total = int(word[-1]) + 1 if len(word) else 0
    for at in range(0, total, 8192):
        a, b = np.searchsorted(word, [at, at + 8192])
        m = np.zeros((n, min(8192, total - at)), np.float32)
        m[doc[a:b], word[a:b] - at] = 1
        out += m @ m.T
    out = out.round().astype(np.int64)
    np.fill_diagonal(out, size)
    return out


def _tile_links(batches, threshold=THRESHOLD):
    """Exact pairs of a tile: links counted per class, and a forest of them as links (a, b)."""
    for rows in _grouped(batches, 2, 1 << 12):
        cuts = np.r_[0, _changes(rows, 2), rows.num_rows]
        cls, own, blocks, pair, copies = (rows.column(k).to_numpy() for k in (2, 3, 4, 1, 5))
        sets = [np.frombuffer(s, np.uint64) for s in rows.column(6).to_pylist()]
        out_cls, out_n, out_to = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            both = intersections(sets[a:b])
            size = np.diag(both)
            near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(near, False)
            if pair[a] // blocks[a] != pair[a] % blocks[a]:
                near &= own[a:b, None] != own[None, a:b]
            n = near @ copies[a:b]
            i, j = np.nonzero(np.triu(near))
            node, low = forest(cls[a:b][i], cls[a:b][j])
            to = dict(zip(node.tolist(), low.tolist(), strict=True))
            out_cls += cls[a:b][n > 0].tolist()
            out_n += n[n > 0].tolist()
            out_to += [to.get(c, c) for c in cls[a:b][n > 0].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(out_cls, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_to, pa.int64())], ["cls", "n", "low"])


def exact_links(docs: DataFrame, members: DataFrame, text: str = "text", tile: int = TILE) -> DataFrame:
    """(cls, n, low) from exact comparison of all pairs within the components of ``members`` (cls, component, copies)."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / tile).alias("blocks"))
    rows = candidate_sets(docs, written(members.join(sizes, "component"), "members"), text)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls", F.lit("tile")), F.col("blocks")))
    rows = rows.select("component", F.explode(block_pairs(F.col("own"), F.col("blocks"))).alias("pair"), "cls", "own", "blocks", "copies", "set")
    rows = rows.repartition("component", "pair").sortWithinPartitions("component", "pair")
    return rows.mapInArrow(_tile_links, "cls long, n long, low long")


def near_classes(docs: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(cls, links, group, least, copies) of every class in ``rows`` (key, cls, sig): links to rows of other classes,
    the group's label and its smallest key."""
    held = rows.where("cls is not null")
    classes = written(held.groupBy("cls").agg(F.first("sig").alias("sig")), "classes")
    copies = held.groupBy("cls").agg(F.count("*").alias("copies"), F.min(key).alias("least"))
    copies = written(copies, "copies")
    likely = components(candidate_links(classes, limit, block), "candidates")
    members = likely.select(F.col("node").alias("cls"), "component").join(copies.select("cls", "copies"), "cls")
    found = written(exact_links(docs, members, text, tile), "links")
    groups = components(found.where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b")), "groups")
    links = found.groupBy("cls").agg(F.sum("n").alias("links"))
    known = copies.join(links, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    known = written(known.select("cls", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("group")), "known")
    least = known.groupBy("group").agg(F.min("least").alias("least"))
    return known.drop("least").join(least, "group")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(key, n_links, class_id, kept) for every row of ``docs``.

    ``n_links``: other rows with a Jaccard similarity of at least 0.8 on five-word shingles, copies included.
    ``class_id``: smallest key reachable by links, itself included; ``kept``: this row has it. Null or wordless
    texts link with nothing and keep themselves. Repeated rows are copies of each other and share a key, so all
    of them are ``kept`` if one is; ``one_of_each`` then leaves one. Texts of any length are read whole. Other columns
    are ignored.
    """
    rows = written(classed(docs, key, text), "signatures")
    near = near_classes(docs, rows, key, text, limit, block, tile)
    placed = rows.select(key, F.coalesce("cls", F.xxhash64(F.lit("none"), key)).alias("cls")).join(near, "cls", "left")
    class_id = F.when(F.col("least").isNull(), F.col(key)).otherwise(F.col("least"))
    return placed.select(
        key,
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        class_id.alias("class_id"),
        class_id.eqNullSafe(F.col(key)).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest key, of equal keys the first stored.

    Rows without words all stay. All columns are kept as they are.
    """
    columns = docs.columns
    stored = written(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*columns).alias("__doc")), "numbered")
    order = F.struct(F.col("__doc").getField(key).alias("key"), F.col("__row").alias("row"))
    body = stored.select("__row", F.col("__doc").getField(text).alias("__text"))
    rows = written(classed(body, "__row", "__text"), "signatures")
    keyed = rows.join(stored.select("__row", order.alias("__order")), "__row")
    near = near_classes(body, keyed, "__order", "__text")
    gone = keyed.join(near, "cls").where(F.col("__order") != F.col("least")).select("__row")
    return stored.join(gone, "__row", "left_anti").select(*[F.col("__doc").getField(c).alias(c) for c in columns])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rid, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE p.c >= 0.8 * (x.n + y.n - p.c) - 1e-9),
r AS (SELECT rid, rid AS c FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, (SELECT count(*) FROM l WHERE l.a = d.rid) AS n_links, m.class_id, m.class_id = d.doc_id AS kept
FROM d JOIN (SELECT r.rid, min(t.doc_id) AS class_id FROM r JOIN d t ON t.rid = r.c GROUP BY r.rid) m ON m.rid = d.rid
"""


@query("op10_jaccard_join", SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
