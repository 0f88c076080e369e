"""Merkle manifest of a dataset: a postorder append log of its trees, and proofs taken from it.

A tree hashes its leaves in runs of eight, level by level. Every node has a place in the tree's postorder: the order in
which nodes are complete if leaves are appended one after another. The place follows from subtree sizes alone
(:func:`position`), so builders need no common counter. One aligned builder owns ``8 ** LEVELS`` consecutive leaves and
appends their nodes in completion order; the tops of the builders are the leaves of the next round, until a tree has one
top. A complete subtree keeps its places when leaves are appended behind it.

Proofs are read from the log from the top round down: a builder's nodes are one array, the siblings of a node are
addressed in it by their places, and the path above the builder's top is known from the round above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.registry import query, table
from shelfspark.operators.ranking import distributed_row_number
from shelfspark.session import scratch_path, written

ARITY = 8
#: Levels of one builder: 512 leaves, at most 585 nodes in one task at a time.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """Lower-case hex sha256 of the parts, put together."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def position(n: int, level: int, index):
    """Place in the postorder of node ``index`` (a number or an array) of a level, in a tree of ``n`` leaves.

    Before it lie the other nodes of its own subtree, all nodes up to its level that are complete by then, and the
    nodes of higher levels whose leaves all lie left of it.
    """
    first = index * ARITY**level
    end = np.minimum(first + ARITY**level, n)
    place = -1 + sum(-(-end // ARITY**k) for k in range(level + 1))
    return place + sum(first // ARITY**k for k in range(level + 1, height(n) + 1))


def _builder(base: int):
    """Nodes above one aligned stretch of nodes of level ``base``, in completion order."""

    def build(key, rows):
        rows = rows.sort_by("at")
        n, at = rows["n"][0].as_py(), rows["at"].to_numpy()
        top = min(base + LEVELS, height(n))
        level, index, hashes = [np.full(len(at), base)], [at], [rows["digest"].to_pylist()]
        for k in range(base + 1, top + 1):
            below, own = hashes[-1], index[-1]
            starts = np.flatnonzero(np.r_[True, own[1:] // ARITY != own[:-1] // ARITY])
            hashes.append([digest(*below[s:e]) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(below)], strict=True)])
            index.append(own[starts] // ARITY)
            level.append(np.full(len(starts), k))
        place = np.concatenate([np.atleast_1d(position(n, int(v[0]), i)) for v, i in zip(level, index, strict=True)])
        order = np.argsort(place)
        flat = [h for hs in hashes for h in hs]
        level, index = np.concatenate(level)[order], np.concatenate(index)[order]
        size = len(order)
        return pa.table(
            {
                "tree": pa.array([key[0].as_py()] * size, pa.string()),
                "unit": pa.array([key[1].as_py()] * size, pa.int64()),
                "n": pa.array(np.full(size, n), pa.int64()),
                "pos": pa.array(place[order], pa.int64()),
                "level": pa.array(level, pa.int32()),
                "at": pa.array(index, pa.int64()),
                "digest": pa.array([flat[i] for i in order.tolist()], pa.string()),
                "is_top": pa.array(level == top),
                "is_root": pa.array((level == top) & (top == height(n))),
            }
        )

    return build


LOG = "tree string, unit long, n long, pos long, level int, at long, digest string, is_top boolean, is_root boolean"


def build_log(leaves: DataFrame, path: str) -> list[DataFrame]:
    """Append log of every tree below ``path``, one folder a round: (tree, unit, n, pos, level, at, digest, is_top, is_root).

    ``leaves`` has tree (text), n (leaves of the tree), at (place in the tree from 0) and digest. The leaves of a round
    are the tops of the round before, so its rows shrink by ``8 ** LEVELS``.
    """
    spark, rounds, nodes = leaves.sparkSession, [], leaves
    while True:
        base = LEVELS * len(rounds)
        units = nodes.select("tree", F.shiftright("at", 3 * LEVELS).alias("unit"), "n", "at", "digest")
        folder = f"{path}/round={len(rounds)}"
        units.groupBy("tree", "unit").applyInArrow(_builder(base), LOG).write.parquet(folder)
        rounds.append(spark.read.schema(LOG).parquet(folder))
        nodes = rounds[-1].where("is_top AND NOT is_root")
        if nodes.isEmpty():
            return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree in the log."""
    found = [r.where("is_root").select("tree", F.col("digest").alias("root")) for r in rounds]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _siblings(nodes: pa.Table):
    """Reader of one builder's stretch of the log: path of the node ``at`` up to the top, and the path above the top.

    A path holds, level by level, the digests left of the node in its run and those right of it.
    """
    above = nodes.filter(pc.is_null(nodes["pos"]))
    own = nodes.filter(pc.is_valid(nodes["pos"])).sort_by("pos")
    n, place, held, level = own["n"][0].as_py(), own["pos"].to_numpy(), own["digest"].to_pylist(), own["level"].to_numpy()
    base, top = int(level.min()), int(level.max())
    upper = above["path"][0].as_py() if len(above) else []
    count = [-(-n // ARITY**k) for k in range(top + 1)]

    def path(at: int) -> list[str]:
        out = []
        for k in range(base, top):
            first = at - at % ARITY
            run = np.arange(first, min(first + ARITY, count[k]))
            rows = np.searchsorted(place, position(n, k, run))
            left = at - first
            hashes = [held[r] for r in rows.tolist()]
            out += ["".join(hashes[:left]), "".join(hashes[left + 1 :])]
            at //= ARITY
        return out + upper

    return own, base, path


def _extend(key, nodes):
    """Paths of the lowest nodes of a builder."""
    own, base, path = _siblings(nodes)
    at = own.filter(pc.equal(own["level"], base))["at"].to_pylist()
    tree = [key[0].as_py()] * len(at)
    return pa.table({"tree": pa.array(tree, pa.string()), "unit": pa.array(at, pa.int64()), "path": pa.array([path(a) for a in at], pa.list_(pa.string()))})


def _with_paths(log: DataFrame, paths: DataFrame | None) -> DataFrame:
    nodes = log.select("tree", "unit", "n", "pos", "level", "at", "digest", F.lit(None).cast("array<string>").alias("path"))
    return nodes if paths is None else nodes.unionByName(paths.select("tree", "unit", "path"), allowMissingColumns=True)


def upper_paths(rounds: list[DataFrame], root_paths: DataFrame | None = None) -> DataFrame | None:
    """(tree, unit, path): path above the top of every builder of the first round; None where no builder has one.

    ``root_paths`` (tree, path) is what lies above the root of each tree, where the trees are themselves leaves of another.
    """
    paths = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = None
        if root_paths is not None:
            ends = rounds[k].where("is_root").select("tree", "unit").join(root_paths, "tree")
        paths = ends if paths is None else paths if ends is None else paths.unionByName(ends)
        if k:
            above = _with_paths(rounds[k], paths)
            paths = written(above.groupBy("tree", "unit").applyInArrow(_extend, "tree string, unit long, path array<string>"), "merkle-paths")
    return paths


def fold(leaf: str, path: list[str]) -> str:
    """Root that follows from a leaf and its path."""
    for k in range(0, len(path), 2):
        leaf = digest(path[k], leaf, path[k + 1])
    return leaf


PROOF = "row string, tree string, at long, leaf string, proof array<string>, proof_sha256 string, folded string"


def _prove(whole: bool):
    def run(key, rows, nodes):
        size = len(rows)
        own, base, path = _siblings(nodes) if size else (None, 0, None)
        paths = [path(a) for a in rows["at"].to_pylist()]
        shown = rows["shown"].to_pylist()
        leaves = own.filter(pc.equal(own["level"], base)).sort_by("at") if size else None
        return pa.table(
            {
                "row": rows["row"].cast(pa.string()),
                "tree": pa.array([key[0].as_py()] * size, pa.string()),
                "at": rows["at"].cast(pa.int64()),
                "leaf": leaves["digest"].take(pc.subtract(rows["at"], leaves["at"][0])) if size else pa.array([], pa.string()),
                "proof": pa.array(paths if whole else [None] * size, pa.list_(pa.string())),
                "proof_sha256": pa.array([digest(*p) for p in paths], pa.string()),
                "folded": pa.array([fold(h, p) for h, p in zip(shown, paths, strict=True)], pa.string()),
            }
        )

    return run


def prove(asked: DataFrame, rounds: list[DataFrame], paths: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """Proof of every asked leaf: its path (``whole``), the digest of all siblings, and the root that ``shown`` leads to.

    ``asked`` has tree, at (place in the tree), shown (the digest to be checked) and row (text that is handed through).
    """
    units = asked.select("tree", F.shiftright("at", 3 * LEVELS).alias("unit"), "at", "shown", "row")
    log = _with_paths(rounds[0], paths)
    return units.groupBy("tree", "unit").cogroup(log.groupBy("tree", "unit")).applyInArrow(_prove(whole), PROOF)


def record(*fields: Column) -> Column:
    """Digest of a record: each field as its UTF-8 byte count, a colon and the value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _lowered(text: Column) -> Column:
    letters = "".join(chr(c) for c in range(65, 91))
    return F.translate(text, letters, letters.lower())


def tampered_every_third(docs: DataFrame) -> Column:
    """Digest of the record as a tamperer left it: text in lower case where 3 divides the key's CRC, else the record's own."""
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").isNotNull()
    return F.when(hit, record(*[_lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]))


def manifest(docs: DataFrame, path: str, shown=None) -> DataFrame:
    """Log of the dataset below ``path`` and a checked proof of every row.

    Every row is a leaf (:func:`record` of ``FIELDS``); rows of one ``lang`` form a tree, ascending by doc_id (null first,
    equal ids by leaf digest, so repeated rows have leaves of their own); the roots of these trees, by lang (null first,
    bytewise), form the top tree. ``shown(docs)`` gives the digest that is checked against the proof, the leaf itself where
    it is null. Returns doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified. Null and empty texts have
    digests of their own; long texts are hashed whole. An empty table gives no rows and an empty log. Other columns are
    ignored, whatever their names.
    """
    own = docs.select(*[F.col(c) for c in FIELDS])
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # sorts as lang does, null first
    checked = F.lit(None).cast("string") if shown is None else shown(own)
    leaves = written(own.select(tree.alias("tree"), "doc_id", record(*[F.col(c) for c in FIELDS]).alias("leaf"), checked.alias("shown")), "merkle-leaves")
    ranked = distributed_row_number(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], keys=["tree"], name="rn")
    placed = written(ranked.select("tree", (F.col("rn") - 1).alias("at"), "doc_id", "leaf", F.coalesce("shown", "leaf").alias("shown")), "merkle-placed")
    sizes = written(placed.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    rounds = build_log(placed.join(sizes, "tree").select("tree", "n", "at", F.col("leaf").alias("digest")), f"{path}/trees")
    subroots = written(roots(rounds), "merkle-roots")
    trees = subroots.count()
    tops = distributed_row_number(subroots.withColumnRenamed("tree", "name"), [F.col("name").asc()], name="rn")
    tops = written(tops.select(F.lit("").alias("tree"), "name", F.lit(trees).cast("long").alias("n"), (F.col("rn") - 1).alias("at"), F.col("root").alias("digest")), "merkle-tops")
    over = build_log(tops.drop("name"), f"{path}/top")
    asked = tops.select("tree", "at", F.col("digest").alias("shown"), F.col("name").alias("row"))
    root_paths = written(prove(asked, over, upper_paths(over)).select(F.col("row").alias("tree"), F.col("proof").alias("path")), "merkle-root-paths")
    asked = placed.select("tree", "at", "shown", F.col("doc_id").cast("string").alias("row"))
    found = prove(asked, rounds, upper_paths(rounds, root_paths), whole=False)
    top = roots(over).first()  # one row
    root = F.lit(top["root"] if top else None).cast("string")
    return found.join(subroots.withColumnRenamed("root", "subroot"), "tree").select(
        F.col("row").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.when(F.col("tree") != "", F.col("tree").substr(F.lit(2), F.length("tree"))).alias("lang"),
        "leaf",
        "subroot",
        root.alias("root"),
        "proof_sha256",
        F.col("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )


def _climb(name: str, leaves: str) -> str:
    """Nodes, runs and roots of the trees whose leaves are (tree, i, n, h, hit)."""
    return f"""
{name}_nodes AS (
  SELECT 0 AS lvl, tree, i, n, h FROM {leaves}
  UNION ALL
  SELECT lvl + 1, tree, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY lvl, tree, i // 8, n),
{name}_runs AS (SELECT lvl, tree, i // 8 AS run, list(h ORDER BY i) AS hs FROM {name}_nodes WHERE n > 1 GROUP BY ALL),
{name}_roots AS (SELECT tree, h FROM {name}_nodes WHERE n = 1)"""


def _paths(name: str, start: str) -> str:
    """Siblings and folded digest of every start (rid, tree, i, h, proof) at the root of its tree."""
    return f"""
{name}_up AS (
  SELECT rid, tree, 0 AS lvl, i, h, proof FROM {start}
  UNION ALL
  SELECT u.rid, u.tree, u.lvl + 1, u.i // 8,
    sha256(array_to_string(r.hs[1:u.i % 8], '') || u.h || array_to_string(r.hs[u.i % 8 + 2:], '')),
    u.proof || array_to_string(r.hs[1:u.i % 8], '') || array_to_string(r.hs[u.i % 8 + 2:], '')
  FROM {name}_up u JOIN {name}_runs r ON r.lvl = u.lvl AND r.tree = u.tree AND r.run = u.i // 8),
{name}_end AS (SELECT rid, tree, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM {name}_up GROUP BY rid, tree)"""


def _sql() -> str:
    letters = "".join(chr(c) for c in range(65, 91))
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: {step})) AS t),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {field("text")}) AS h,
    CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295], {codes}),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 0
    THEN sha256({head} || {field(f"translate(text, '{letters}', '{letters.lower()}')")}) END AS hit
  FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_climb("low", "l")},
t AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM low_roots),
{_climb("top", "t")},
low_start AS (SELECT rid, tree, i, coalesce(hit, h) AS h, '' AS proof FROM l),
{_paths("low", "low_start")},
top_start AS (SELECT e.rid, t.tree, t.i, e.h, e.proof FROM low_end e JOIN t ON t.name = e.tree),
{_paths("top", "top_start")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM top_end e JOIN l USING (rid) JOIN low_roots s ON s.tree = l.tree JOIN top_roots r ON r.tree = e.tree
"""


@query("op13_manifest", _sql())
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; every third one is checked as a tamperer left it, against the untampered log."""
    found = manifest(table(spark, sf_dir, "documents"), scratch_path(spark, "manifest"), tampered_every_third)
    return found.drop("lang")
