"""Jaccard join, embedding near-duplicates and connected components against brute force."""

import random

import numpy as np
import pytest
from test_decontaminate import words_of

from shelfspark.llm.components import components
from shelfspark.llm.embedding_dedup import axes, near_pairs, near_vectors
from shelfspark.llm.jaccard_join import LIKELY, ROOT, THRESHOLD, T, intersections, jaccard_join, miss_chance, one_of_each


def grouped(keys, links):
    """Links and smallest key reachable of each place."""
    label = list(range(len(keys)))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    least = {}
    for k, g in enumerate(label):
        least[g] = min(least.get(g, keys[k]), keys[k])
    degree = [0] * len(keys)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, [least[g] for g in label]


def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = words_of(t)
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(pick.choices(vocabulary, k=40))
    out = [None, "", " . ", "one", "One!", "one two three four", "one two three", "a b c d e", "a b c d e", "A b c d f"]
    for size in (30, 60, 200, 2000):
        base = pick.choices(vocabulary, k=size)
        for _ in range(25):
            w = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 5]) * max(1, size // 100)):
                w[pick.randrange(size)] = pick.choice(vocabulary)
            out.append(" ".join(w[pick.randint(0, 2) :]))
    out += [passage + " " + " ".join(pick.choices(vocabulary, k=pick.randint(5, 60))) for _ in range(80)]
    out += ["the same text copied many times over and over"] * 60
    return out


@pytest.mark.parametrize(("limit", "block", "tile"), [(2048, 512, 256), (16, 8, 8)])
def test_jaccard_against_brute_force(spark, documents, texts, limit, block, tile):
    degree, least = grouped(list(range(len(texts))), brute_jaccard(texts))
    got = {r["doc_id"]: r for r in jaccard_join(documents(texts), limit=limit, block=block, tile=tile).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert (got[k]["n_links"], got[k]["class_id"], got[k]["kept"]) == (degree[k], least[k], least[k] == k), k


def test_one_of_each(spark, documents, texts):
    _, least = grouped(list(range(len(texts))), brute_jaccard(texts))
    frame = documents(texts)
    kept = one_of_each(frame)
    assert kept.dtypes == frame.dtypes
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least))
    # repeated rows with one id, null ids, no rows
    same = "five words at least here"
    rows = [(5, same), (5, same), (None, same), (6, None), (6, None), (None, None)]
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in one_of_each(documents(rows)).collect())
    assert got in ([(-1, ""), (-1, same), (6, ""), (6, "")], [(-1, ""), (5, same), (6, ""), (6, "")])
    assert one_of_each(documents([])).count() == 0
    assert jaccard_join(documents([])).count() == 0
    assert jaccard_join(documents([None, ""])).where("kept and n_links = 0").count() == 2


@pytest.mark.parametrize("n", [3, 40])
def test_intersections(n):
    pick = np.random.default_rng(2)
    sets = [np.unique(pick.integers(0, 20_000, pick.integers(1, 3000)).astype(np.uint64)) for _ in range(n)]
    got = intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n))


def test_components(spark):
    pick = random.Random(4)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(200)] + [(2000, 2001 + k) for k in range(150)] + [(7, 7)]
    nodes = sorted({x for link in links for x in link})
    place = {x: k for k, x in enumerate(nodes)}
    _, least = grouped(nodes, [(place[a], place[b]) for a, b in links])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: least[place[x]] for a, b in links if a != b for x in (a, b)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 0, 1, None):
        for _ in range(6):
            base = rng.normal(size=24)
            for _ in range(12):
                rows.append((label, (base + rng.normal(size=24) * rng.choice([0, 0.02, 0.05, 0.1, 0.2])).tolist()))
    rows += [(0, rows[0][1])] * 30 + [(0, [0.0] * 24), (0, None), (0, []), (0, [float("nan")] * 24), (0, [float("inf")] + [1.0] * 23), (0, [None] + [1.0] * 23)]
    rows += [(1, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (1, [2.0, -0.0]), (1, [1e200, 1e190]), (1, [1e-200, 0.0])]
    return [(k, v, label) for k, (label, v) in enumerate(rows)]


@pytest.mark.parametrize("tile", [512, 16])
def test_vectors_against_brute_force(spark, tile):
    rows = vectors()
    unit = []
    for _, v, label in rows:
        ok = v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
        x = np.array(v, float) / np.max(np.abs(v)) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    ]
    degree, least = grouped([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'clash' as cls", "'clash' as copies").repartition(4)
    got = {r["vec_id"]: r for r in near_vectors(df, tile=tile).collect()}
    assert len(links) > 100 and len(got) == len(rows)
    for k in range(len(rows)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (degree[k], least[k], least[k] == k), k
    assert near_vectors(df.limit(0)).count() == 0


def test_bounds_lose_nothing():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(150, 64)), np.repeat(rng.normal(size=(10, 64)), 5, 0) + rng.normal(size=(50, 64)) * 0.12])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if u[i] @ u[j] >= 0.98}
    for rotation in (None, axes(u.T @ u)):
        i, j = near_pairs(x, x, rotation, same=True)
        assert set(zip(i.tolist(), j.tolist())) == want and want


def test_chance_to_miss_a_pair_at_the_threshold():
    assert miss_chance() < 1e-11 and miss_chance(0.9) < miss_chance()
    # the formula against drawn agreements, at a similarity where misses are frequent
    draw = np.random.default_rng(4).random((200_000, T)) < 0.5
    missed = (draw.sum(1) < LIKELY * T).mean() + (~draw[:, ROOT].any(1)).mean()
    assert missed == pytest.approx(miss_chance(0.5), rel=0.05) and THRESHOLD == 0.8
