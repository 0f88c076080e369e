import random
import re

import pytest

from shelfspark.llm.decontaminate import contamination, drop_contaminated, item_blocks, op9_decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(t):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, body in items:
            b = words_of(body)
            n = min(10, len(b))
            for i in range(len(b) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add("null" if item is None else str(item))
        out[key] = (len(w), len(hit), sorted(found))
    return out


@pytest.fixture(scope="module")
def cases():
    pick = random.Random(5)
    say = lambda n: " ".join(pick.choices(["a", "b", "C", "dé", "e1"], k=n))
    items = [(k, say(n)) for k, n in enumerate([1, 2, 3, 9, 10, 11, 25, 40])] + [(None, say(12)), (3, say(12)), (9, None), (10, " . "), (11, "é")]
    rare = " ".join(f"w{k}" for k in range(30))
    items.append((12, rare))
    docs = [(k, say(pick.randint(0, 80))) for k in range(30)] + [(30, None), (31, ""), (32, rare[: len(rare) // 2].upper() + "!"), (33, "x " + rare.replace(" ", " -- ")), (34, "w1 w2 w3 w4"), (35, (rare + " ") * 3000), (36, "É")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_against_brute_force(spark, documents, cases, block):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    if block == 150:
        assert len(list(item_blocks(bench, block_bytes=block))) > 2
    got = contamination(documents([*docs, docs[33]]), bench, block_bytes=block).collect()
    assert len(got) == len(docs) + 1
    want = brute([d for d in docs if d[0] != 35], items)
    for r in got:
        if r["doc_id"] == 35:
            assert r["n_hit"] == r["n_words"] == 90_000 and "12" in r["items"]
            continue
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]], r["doc_id"]
        assert sum(x["end"] - x["start"] for x in r["hit_runs"]) == r["n_hit"]


def test_drop_keeps_columns(spark, documents, cases):
    docs, items = cases
    frame = documents(docs)
    bench = spark.createDataFrame(items[6:8], "item_id long, text string")
    want = brute([d for d in docs if d[0] != 35], items[6:8])
    kept = drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([k for k, v in want.items() if not v[1]] + [35])


def test_empty_sides(spark, documents, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(documents([]), bench).count() == 0
    assert drop_contaminated(documents(docs[:5]), bench.limit(0)).count() == 5


def test_query_columns(spark, sf):
    assert op9_decontaminate(spark, sf).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
