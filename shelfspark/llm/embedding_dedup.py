"""Near-duplicate vectors by a PCA-ordered, tiled comparison.

Equal vectors of one label are one class. Classes are dealt into tiles within their label, and every
unordered pair of tiles is compared in one task. Vectors are rotated to the principal axes of all data; the
leading dimensions are multiplied first, and what the others can still add is bounded by the product of
the suffix norms. Pairs that cannot reach the threshold stop there; survivors go on, block by block, and are
verified in double precision on the vectors as they are. A tile pair leaves link counts and a spanning
forest, never its pairs, so dense groups stay small.

The comparison within a label is exact and therefore quadratic in the worst case; tiles spread a hot label
over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.components import components
from shelfspark.llm.forest import forest
from shelfspark.llm.jaccard_join import _changes, _grouped, block_pairs
from shelfspark.llm.registry import query, table
from shelfspark.session import written

THRESHOLD = 0.98
TILE = 512
#: Leading dimensions multiplied before the first bound, and in each later block.
BLOCK = 16
#: Covers rounding of the rotated products; never decides a pair.
SLACK = 1e-9
#: Vectors of more dimensions keep their own axes.
MAX_ROTATED = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def moments(classes: DataFrame) -> dict[int, np.ndarray]:
    """Sums of x_i * x_j of the unit vectors, by dimension: at most dim * dim numbers of each come back."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch.column(1).to_numpy()
            for d in np.unique(size).tolist():
                if d <= MAX_ROTATED:
                    x = _unit(_vectors(batch.column(0).filter(pa.array(size == d)), d))
                    total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(m.ravel())], ["d", "k", "v"])

    sums = classes.select("vector", "dim").mapInArrow(run, "d int, k int, v double").groupBy("d", "k").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, own in sums.groupby("d"):
        m = np.zeros(d * d)
        m[own["k"].to_numpy()] = own["v"].to_numpy()
        out[int(d)] = m.reshape(d, d)
    return out


def axes(moment: np.ndarray) -> np.ndarray:
    """Principal axes, the strongest first, as columns."""
    return np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1].copy()


def near_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray | None, threshold: float = THRESHOLD, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) with a cosine of at least ``threshold``; of a tile with itself only i < j."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ua, ub = _unit(a), _unit(b)
    x, y = (ua, ub) if rotation is None else (ua @ rotation, ub @ rotation)
    dim = x.shape[1]
    rest = [np.sqrt(np.maximum(0, np.cumsum((v * v)[:, ::-1], 1)[:, ::-1])) for v in (x, y)]
    upto = min(BLOCK, dim)
    sums = x[:, :upto] @ y[:, :upto].T
    reach = sums + (np.outer(rest[0][:, upto], rest[1][:, upto]) if upto < dim else 0)
    i, j = np.nonzero(reach >= threshold - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    part = sums[i, j]
    while upto < dim and len(i):
        to = min(upto + BLOCK, dim)
        part = part + np.einsum("ij,ij->i", x[i, upto:to], y[j, upto:to])
        upto = to
        bound = part + (rest[0][i, upto] * rest[1][j, upto] if upto < dim else 0)
        ok = bound >= threshold - SLACK
        i, j, part = i[ok], j[ok], part[ok]
    keep = [np.einsum("ij,ij->i", ua[i[k : k + 65536]], ub[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def _tile_links(rotations, threshold):
    def run(batches):
        for rows in _grouped(batches, 2, 1 << 11):
            cuts = np.r_[0, _changes(rows, 2), rows.num_rows]
            pair, cls, own, blocks, copies, dims = (rows.column(k).to_numpy() for k in range(1, 7))
            vector = rows.column(7).combine_chunks()
            out_cls, out_n, out_low = [], [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x = _vectors(vector.slice(s, e - s), int(dims[s]))
                left = pair[s] // blocks[s]
                at = np.arange(s, e)
                if left == pair[s] % blocks[s]:
                    ia = ib = at
                else:
                    ia, ib = at[own[s:e] == left], at[own[s:e] != left]
                i, j = near_pairs(x[ia - s], x[ib - s], rotations.value.get(int(dims[s])), threshold, ia is ib)
                i, j = ia[i], ib[j]
                n = np.bincount(i - s, copies[j], e - s) + np.bincount(j - s, copies[i], e - s)
                node, low = forest(cls[i], cls[j])
                to = dict(zip(node.tolist(), low.tolist(), strict=True))
                linked = cls[s:e][n > 0].tolist()
                out_cls += linked
                out_n += n[n > 0].astype(np.int64).tolist()
                out_low += [to.get(c, c) for c in linked]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (out_cls, out_n, out_low)], ["cls", "n", "low"])

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and not null, their vectors have the same length and a cosine of at
    least ``threshold`` in double precision. Null, empty and zero vectors and those with null or non-finite
    components link with nothing, not even their copies. Repeated rows are rows of their own and link. A row
    without links has its own key as component. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("vector")
    fine = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.transform(F.col(vector), lambda x: x.cast("double") + 0.0).alias("vector"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # the class of a row: its label and vector
    digest = F.when(F.col("fine"), F.xxhash64("label", "vector"))
    rows = written(rows.withColumn("cls", digest), "vectors")
    held = rows.where("fine")
    classes = held.groupBy("cls").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    bodies = held.select("cls", "label", "vector").dropDuplicates(["cls"])
    classes = written(bodies.join(classes, "cls").withColumn("dim", F.size("vector")), "vector-classes")
    rotations = spark.sparkContext.broadcast({d: axes(m) for d, m in moments(classes).items()})
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).alias("blocks"), F.xxhash64("label", "dim").alias("unit"))
    tiled = classes.join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("cls", F.lit("tile")), F.col("blocks")))
    tiled = tiled.select("unit", F.explode(block_pairs(F.col("own"), F.col("blocks"))).alias("pair"), "cls", "own", "blocks", "copies", "dim", "vector")
    tiled = tiled.repartition("unit", "pair").sortWithinPartitions("unit", "pair")
    found = written(tiled.mapInArrow(_tile_links(rotations, threshold), "cls long, n long, low long"), "vector-links")
    groups = components(found.where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b")), "vector-groups")
    links = found.groupBy("cls").agg(F.sum("n").alias("links"))
    known = classes.select("cls", "copies", "least").join(links, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    known = written(known.select("cls", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("group")), "vector-known")
    known = known.drop("least").join(known.groupBy("group").agg(F.min("least").alias("least")), "group")
    placed = rows.select("key", F.coalesce("cls", F.xxhash64(F.lit("none"), "key")).alias("cls")).join(known, "cls", "left")
    component = F.when(F.col("copies").isNull(), F.col("key")).otherwise(F.col("least"))
    return placed.select(
        F.col("key").alias(key),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("key")).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e, row_number() OVER (ORDER BY vec_id) AS rid FROM embeddings),
f AS (SELECT *, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0),
l AS (
  SELECT a.rid AS a, b.rid AS b FROM f a JOIN f b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT rid, rid AS c FROM v UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.c)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.rid) AS n_links, m.component_id, m.component_id = v.vec_id AS kept
FROM v JOIN (SELECT r.rid, min(t.vec_id) AS component_id FROM r JOIN v t ON t.rid = r.c GROUP BY r.rid) m ON m.rid = v.rid
"""


@query("op3_embedding_dedup", SQL)
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
