"""Sharding by fixed virtual slots and an edited slot-to-shard map.

A record's hash puts it into one of ``SLOTS`` virtual slots, for ever. A versioned table
maps slots to shards. Rebalancing sums the bytes of every slot and edits the map: slots
move from the heaviest shard to the lightest, so only their records move.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.registry import query, table
from shelfspark.session import scratch_path, written

SLOTS = 4096
#: Parts of a slot that are numbered apart, so that a hot id or text does not meet in one task.
PARTS = 16


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]`` for a number of shards; ``version`` rises with every edit."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 0: equal runs of slots."""
        if shards < 1 or slots < 1:
            raise ValueError("shards and slots must be at least 1")
        return SlotMap(0, shards, tuple(s * shards // slots for s in range(slots)))

    def rebalanced(self, slot_bytes: dict[int, int], shards: int | None = None) -> SlotMap:
        """Next version: moves of one slot or swaps of none, from the heaviest shard to the lightest, while that narrows their gap.

        Each step moves the slot whose bytes come closest to half the gap, so the gap ends below the smallest slot
        of the heaviest shard. More shards than before start empty; slots of removed shards go to the lightest.
        """
        n = shards or self.shards
        load = [0] * n
        held: list[dict[int, int]] = [{} for _ in range(n)]
        homeless = []
        for slot, shard in enumerate(self.shard_of):
            size = slot_bytes.get(slot, 0)
            if shard < n:
                held[shard][slot] = size
                load[shard] += size
            else:
                homeless.append((size, slot))
        for size, slot in sorted(homeless, reverse=True):
            to = load.index(min(load))
            held[to][slot] = size
            load[to] += size
        while True:
            high, low = load.index(max(load)), load.index(min(load))
            gap = load[high] - load[low]
            fit = [(abs(gap - 2 * size), slot, size) for slot, size in held[high].items() if 0 < size < gap]
            if not fit:
                break
            _, slot, size = min(fit)
            del held[high][slot]
            held[low][slot] = size
            load[high] -= size
            load[low] += size
        shard_of = [0] * len(self.shard_of)
        for shard, own in enumerate(held):
            for slot in own:
                shard_of[slot] = shard
        return replace(self, version=self.version + 1, shards=n, shard_of=tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(map_version, virtual_slot, shard): as many rows as there are slots."""
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "map_version int, virtual_slot int, shard int")


def store_map(spark: SparkSession, path: str, slot_map: SlotMap) -> None:
    """Write one version of the map; an existing version is never overwritten."""
    slot_map.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
    shard_of = tuple(r["shard"] for r in rows)
    return SlotMap(version, max(shard_of) + 1, shard_of)


def _slot(key: str, text: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slot"), F.col(key), F.col(text)), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow rows: key, bytes, CRC and virtual slot of every record. Null text: no bytes; null key: hashed as such.

    The slot depends on the key and the text, so different records of one key, or of none, are spread; only copies of a whole
    record share a slot, and the sizes of the shards differ by no more than the largest slot holds. Texts are read whole. The part within the slot depends on the key, the text and the row's place in the scan, so equal rows are
    dealt to all parts of their slot.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.monotonically_increasing_id()
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        _slot(key, text, slots).alias("virtual_slot"),
        F.pmod(F.xxhash64(F.lit("part"), place), F.lit(PARTS)).cast("int").alias("part"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Rows and bytes of each part of each slot: at most slots * PARTS rows."""
    return rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, key: str = "doc_id", text: str = "text", map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Every record with its shard and its place in it, and the map that decided.

    Returns doc_id, size, text_crc32, shard, slot (place in the shard, from 0 without gaps), virtual_slot,
    map_version. Empty input gives no rows. Repeated rows are each placed. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = written(slotted(docs, key, text, slots), "shard-rows")
    sizes = written(slot_sizes(rows), "shard-sizes")
    per_slot = sizes.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect()  # one row per slot
    path = map_path or scratch_path(spark, "slot-map")
    start = SlotMap.even(shards, slots)
    store_map(spark, path, start)
    edited = start.rebalanced({r["virtual_slot"]: r["bytes"] for r in per_slot})
    store_map(spark, path, edited)
    mapped = F.broadcast(edited.frame(spark))  # `slots` rows
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(mapped, "virtual_slot").select(
        "virtual_slot", "part", "shard", "map_version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")
    )
    place = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("at", F.row_number().over(place) - 1).join(F.broadcast(offsets), ["virtual_slot", "part"])  # slots * PARTS rows
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), "virtual_slot", "map_version"), edited


def moved_share(old: SlotMap, new: SlotMap) -> float:
    """Share of slots whose shard differs between two versions."""
    return sum(a != b for a, b in zip(old.shard_of, new.shard_of, strict=True)) / len(old.shard_of)


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write whole records below ``path/shard=N`` by the map. A column named shard is replaced."""
    spark, slots = docs.sparkSession, len(slot_map.shard_of)
    mapped = F.broadcast(slot_map.frame(spark).select(F.col("virtual_slot").alias("__slot"), F.col("shard").alias("__shard")))
    rows = docs.withColumn("__slot", _slot(key, text, slots))
    rows.join(mapped, "__slot").withColumn("shard", F.col("__shard")).drop("__slot", "__shard").write.partitionBy("shard").parquet(path)


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 shards by bytes: sizes near equal."""
    placed, _ = shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
