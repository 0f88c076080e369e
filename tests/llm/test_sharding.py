import zlib

import pytest

from shelfspark.llm.sharding import SlotMap, load_map, moved_share, op1_sharding, shard_documents, store_map, write_shards


def test_all_rows_near_equal_gapless(spark, sf):
    got = op1_sharding(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"]
    assert sorted(got.doc_id) == sorted(docs.index)
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(8)) and load.max() - load.min() < 0.01 * load.mean()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert got.grown_shard.isna().all() and set(got.law) == {"bytes"}


def test_nulls_repeats_clashes_and_empty(spark, documents):
    rows = [(None, "x"), (1, None), (1, None), (2, ""), (3, "é" * 50_000)] + [(7, "hot")] * 300
    placed, slot_map = shard_documents(documents(rows), 4, slots=64)
    got = placed.toPandas()
    assert len(got) == len(rows) and slot_map.version == 1
    assert got["size"].max() == 100_001 and (got[got.doc_id == 1]["size"] == 1).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert shard_documents(documents([]), 4)[0].count() == 0


def test_rows_of_one_key_and_of_none_are_spread(spark, documents):
    """The law holds where keys repeat or are missing: sizes differ by less than one record."""
    rows = [(None, f"text {k:06}") for k in range(2000)] + [(7, f"body {k:06}") for k in range(1000)] + [(k, f"some {k:06}") for k in range(1000)]
    placed, _ = shard_documents(documents(rows), 8)
    load = placed.groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(load) == 8 and load.max() - load.min() <= 12 * 5


def test_map_versions(spark, tmp_path):
    start = SlotMap.even(3, 12)
    edited = start.rebalanced({s: 10 if s < 4 else 1 for s in range(12)})
    grown = edited.rebalanced(dict.fromkeys(range(12), 1), shards=4)
    assert (start.version, edited.version, grown.version) == (0, 1, 2)
    assert 0 < moved_share(start, edited) < 1 and set(grown.shard_of) == {0, 1, 2, 3}
    # slots that move go to the new shard only
    even = SlotMap.even(3, 12).rebalanced(dict.fromkeys(range(12), 1), shards=4)
    assert all(a == b or b == 3 for a, b in zip(SlotMap.even(3, 12).shard_of, even.shard_of))
    assert set(grown.rebalanced(dict.fromkeys(range(12), 1), shards=2).shard_of) == {0, 1}
    path = str(tmp_path / "map")
    store_map(spark, path, edited)
    assert load_map(spark, path, 1) == edited
    with pytest.raises(Exception, match="(?i)exist"):
        store_map(spark, path, edited)


def test_files(spark, documents, tmp_path):
    docs = documents([f"text {k}" for k in range(40)])
    _, slot_map = shard_documents(docs, 3)
    write_shards(docs, slot_map, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}
