import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm.forest import forest
from shelfspark.llm.words import ALNUM, NONSPACE, chunks, inside_text, shingles, words

PATTERNS = [(ALNUM, re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")), (NONSPACE, re.compile("[^\x20\x09-\x0d]+"))]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abZ9 .\t\n\x00é漢🙂_-"), max_size=30)), max_size=8))
def test_words_equal_the_expression(texts):
    for table, pattern in PATTERNS:
        w = words(pa.array(texts, pa.string()), table)
        want = [pattern.findall(lower(t or "")) for t in texts]
        got = [[w.bytes_of(k).decode() for k in range(a, b)] for a, b in zip(w.ptr[:-1], w.ptr[1:])]
        assert got == want
        flat = [x for own in want for x in own]
        assert len(set(w.hash.tolist())) == len(set(flat))
        same = {}
        for x, h in zip(flat, w.hash.tolist()):
            assert same.setdefault(x, h) == h


def test_hash_does_not_depend_on_the_chunk():
    text = " ".join(random.Random(1).choices(["one", "Two", "drei", "quatré"], k=5000))
    batch = pa.RecordBatch.from_arrays([pa.array([text, None, "one Two", ""] * 3)], ["text"])
    whole = words(batch.column(0)).hash
    parts = [words(p.column(0)).hash for p in chunks(batch, limit=10_000)]
    assert len(parts) > 1 and np.array_equal(np.concatenate(parts), whole)
    assert list(chunks(batch.slice(0, 0))) == []


def test_shingles_stay_inside_texts():
    w = words(pa.array(["a b c", "", "d", "a b c d"]))
    ok = inside_text(w.ptr, len(w.hash), 3)
    assert ok.tolist() == [True, False, False, False, True, True]
    s = shingles(w.hash, 3)
    assert s[0] == s[4] != s[5]
    assert len(shingles(w.hash[:2], 3)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_forest_keeps_components(links):
    a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    node, low = forest(a, b)
    group = {x: {x} for x in range(31)}
    for x, y in links:
        if group[x] is not group[y]:
            group[x] |= group[y]
            for z in group[y]:
                group[z] = group[x]
    want = {x: min(g) for x, g in group.items() if min(g) != x}
    assert dict(zip(node.tolist(), low.tolist())) == want
