"""Merkle manifest against a plain recursion, and the places of its log against real appending."""

import hashlib
import zlib

import numpy as np
import pytest

from shelfspark.llm import manifest as m
from shelfspark.session import scratch_path


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])])


def climb(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i, own):
    out = ""
    for level in levels[:-1]:
        run = level[i - i % 8 : i - i % 8 + 8]
        left, right = "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
        out, own, i = out + left + right, h(left, own, right), i // 8
    return out, own


def plain(rows, shown=leaf):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root) of rows (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {t: climb([leaf(r) for r in trees[t]]) for t in order}
    top = climb([built[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for i, r in enumerate(trees[t]):
            low, own = siblings(built[t], i, shown(r))
            high, own = siblings(top, k, own)
            out.append((r[0], leaf(r), built[t][-1][0], top[-1][0], h(low + high), own))
    return sorted(out, key=str)


def tampered(r):
    if r[0] is None or r[1] is None or zlib.crc32(str(r[0]).encode()) % 3:
        return leaf(r)
    return leaf((r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:]))


def found(spark, docs):
    rows = m.manifest(docs, scratch_path(spark, "test-manifest"), m.tampered_every_third).collect()
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in rows)
    return sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in rows], key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_equals_the_plain_manifest_over_two_rounds(spark):
    rows = [(k * 7 % 1300, f"Text {k} ÄA" if k % 5 else None, "en" if k % 13 else None, f"s{k % 3}", k) for k in range(1300)]
    assert found(spark, spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows, tampered)


def test_nulls_repeated_rows_ties_long_texts_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(3, "A", "de", "x", 1)] * 20 + [(3, "b", "de", "x", 1), (None, None, None, None, None), (None, "Q", "", "x", 2), (-4, "", "de", None, 0)]
    rows += [(9, "Long Text " * 200_000, "fr", "x", 5), (10, "Ü", "=", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs = docs.select("*", *[F.lit("clash").alias(c) for c in ("tree", "at", "n", "leaf", "shown", "row", "unit", "pos", "path", "root", "name")])
    assert found(spark, docs) == plain(rows, tampered)


def test_one_row_and_none(spark):
    one = [(5, "Only", "en", "s", 4)]
    (r,) = found(spark, spark.createDataFrame(one, SCHEMA))
    assert [r] == plain(one, tampered) and r[4] == h("") and r[1] == r[2] == r[3]
    assert found(spark, spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 513, 700])
def test_places_are_those_of_appending(n):
    place, want, done = 0, {}, [0] * 5
    height = m.height(n)
    for i in range(n):
        want[0, i] = place
        place += 1
        done[0] = i + 1
        for k in range(1, height + 1):  # a node is complete with its last leaf
            if done[0] % 8**k == 0 or done[0] == n:
                want[k, i // 8**k] = place
                place += 1
    count = [-(-n // 8**k) for k in range(height + 1)]
    assert {(k, i): int(m.position(n, k, i)) for k in range(height + 1) for i in range(count[k])} == want
    assert all((m.position(n, k, np.arange(c)) == [want[k, i] for i in range(c)]).all() for k, c in enumerate(count))


def test_complete_subtrees_keep_their_places():
    for n in (64, 100, 600):
        for k in range(m.height(n)):
            whole = np.arange(n // 8**k)
            assert (m.position(n, k, whole) == m.position(10 * n, k, whole)).all()


def test_log_is_in_completion_order_and_a_changed_leaf_is_found(spark):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(600)]
    path = scratch_path(spark, "test-log")
    docs = spark.createDataFrame(rows, SCHEMA)
    checked = m.manifest(docs, path, lambda d: m.F.when(m.F.col("doc_id") == 77, m.F.lit("0" * 64)))
    assert [r["doc_id"] for r in checked.where("NOT verified").collect()] == [77]
    log = [spark.read.parquet(f"{path}/trees/round={k}").collect() for k in range(2)]
    places = sorted(r["pos"] for r in log[0]) + [r["pos"] for r in log[1] if r["level"] > m.LEVELS]
    assert sorted(places) == list(range(len(places)))
    for unit in (0, 1):
        own = [r["pos"] for r in log[0] if r["unit"] == unit]
        assert own == sorted(own)
