"""Vector codes against plain nested loops in Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from shelfspark.llm import vector_codes as v


def floored(x):
    return math.floor(Fraction(x) * 1024)


def plain(rows):
    """{rid: (code, error)} and the digest, of (key, vector) rows of one length; rid is the place in the rows."""
    fill = -len(rows[0][1]) % 4
    whole = [[floored(x) for x in vec] + [0] * fill for _, vec in rows]
    d = len(whole[0]) // 4
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1]))[:256]
    cut = lambda r, p: whole[r][p * d : p * d + d]
    books = [[cut(r, p) for r in order] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda r, p: min((far(cut(r, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(4):
        held = [[[] for _ in b] for b in books]
        for r in range(len(rows)):
            for p in range(4):
                held[p][best(r, p)[1]].append(cut(r, p))
        books = [[[sum(c) // len(c) for c in zip(*h, strict=True)] if h else e for h, e in zip(held[p], books[p], strict=True)] for p in range(4)]
    found = [[best(r, p) for p in range(4)] for r in range(len(rows))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f)) for f in found], digest


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in ("key", "vector", "code", "error", "books", "of", "dim", "part", "entry")])


@pytest.mark.parametrize("size", [1, 2, 4, 8, 32])
def test_transform_is_orthogonal_and_in_sequency_order(size):
    basis = v.transform(np.eye(size, dtype=np.int64))
    assert (basis @ basis.T == size * np.eye(size, dtype=np.int64)).all()
    changes = (np.diff(basis, axis=0) != 0).sum(0)
    assert (changes == np.arange(size)).all()


@pytest.mark.parametrize("scale", [3, 2000, 10**30])
@pytest.mark.parametrize("dim", [1, 3, 16, 24])
def test_nearest_is_exact_with_ties(scale, dim):
    rng = np.random.default_rng(dim)
    x, e = rng.integers(-2, 3, (300, dim)).astype(object) * scale, rng.integers(-2, 3, (60, dim)).astype(object) * scale
    e[30:45] = e[:15]
    index, error, _ = v.nearest(x, e)
    far = ((x[:, None] - e[None]) ** 2).sum(2)
    assert index.tolist() == far.argmin(1).tolist() and error.tolist() == far.min(1).tolist()


def test_entries_are_eliminated_early():
    rng = np.random.default_rng(5)
    e = rng.normal(0, 1000, (256, 1)).astype(np.int64) + rng.integers(-5, 5, (256, 16))  # most lies in the leading coefficient
    x = e[rng.integers(0, 256, 500)] + rng.integers(-3, 4, (500, 16))
    index, _, whole = v.nearest(x, e)
    assert (index == ((x[:, None] - e[None]) ** 2).sum(2).argmin(1)).all() and whole < 0.1 * 500 * 256


def test_integers_are_floors_of_any_size():
    for values in ([0.1, -0.1, 5e-324, -5e-324, 1023.999], [1e300, -1e300, 1.5, -(2.0**43) - 0.5, 2.0**52 - 0.5, 2.0**60]):
        assert v.integers(np.array(values)).tolist() == [floored(x) for x in values]


def rows_of(found, digest, rows):
    total = {}
    for (_, label, _), (_, e) in zip(rows, found, strict=True):
        total[label] = total.get(label, 0) + e
    fit = lambda x: x if x < 1 << 63 else None
    whole = {b: all(e < 1 << 63 for (_, a, _), (_, e) in zip(rows, found, strict=True) if a == b) for b in total}
    return [(k, c, fit(e), fit(total[b]) if whole[b] else None, digest) for (k, b, _), (c, e) in zip(rows, found, strict=True)]


@pytest.mark.parametrize("dim,scale", [(8, 1.0), (6, 1.0), (8, 1e200)])
def test_equals_the_plain_version(spark, dim, scale):
    rng = np.random.default_rng(dim)
    points = np.round(rng.normal(0, 1, (330, dim)), 1) * scale
    rows = [(k // 2 if k < 20 else k, k % 3 or None, points[k].tolist()) for k in range(330)]  # equal ids
    rows += rows[100:110] + [(None, 1, points[3].tolist())] + [(1000 + k, 2, points[40].tolist()) for k in range(150)]
    bad = [(1, 1, None), (2, 1, []), (3, 1, [None] + [1.0] * (dim - 1)), (4, None, [float("nan")] * dim), (5, 1, [float("-inf")] * dim)]
    got = [tuple(r) for r in v.compress(frame(spark, rows + bad)).collect()]
    assert sorted(got, key=str) == sorted(rows_of(*plain([(k, x) for k, _, x in rows]), rows), key=str)


def test_lengths_are_sets_of_their_own_and_none_is_fine(spark):
    rows = [(k, 1, [float(k), 1.0, 2.0, -float(k)]) for k in range(9)]
    more = [(k, None, [0.5 * k] * 5) for k in range(7)]
    got = sorted(tuple(r) for r in v.compress(frame(spark, rows + more)).collect())
    assert got == sorted(rows_of(*plain([(k, x) for k, _, x in rows]), rows) + rows_of(*plain([(k, x) for k, _, x in more]), more))
    assert v.compress(frame(spark, [])).collect() == [] and v.compress(frame(spark, [(1, 1, None)])).collect() == []


def test_codes_stand_for_near_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (10, 8))
    x = centres[rng.integers(0, 10, 600)] + rng.normal(0, 0.01, (600, 8))
    rows = frame(spark, [(k, 0, x[k].tolist()) for k in range(600)]).select("vec_id", "label", "embedding").toDF("key", "label", "vector")
    books = v.train(rows)
    found = sorted(v.encode(rows, books).collect())
    assert np.abs(books[8].decoded([r["code"] for r in found]) - x).mean() < 0.02
    assert {r["books"] for r in found} == {books[8].digest()}
