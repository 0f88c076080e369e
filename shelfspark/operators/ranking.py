"""Row numbers and newest-of-group without a hot task.

A winner can be found in two ways. Where the order fits a fixed-width rank (:func:`packed_rank`), the aggregate is a
``min`` over one number in a hash table, and the winner's row is fetched by its rank afterwards, so wide rows are neither
sorted nor carried through the aggregate (:func:`first_by_rank`). Any other order takes ``min_by`` over a struct.

``row_number()`` over a window sends each group to one task, and a window
without a partition sends everything to one. The helpers here give the same
numbers from a range-partitioned sort, or the same winner from an aggregate
with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import col
from shelfspark.session import scratch_path, written


# rows of (partition, key) offsets that may be broadcast: three longs and the keys, some 50 MB
BROADCAST_ROWS = 500_000


def distributed_row_number(
    df: DataFrame,
    order_by: Sequence[Column],
    keys: Sequence[str] = (),
    name: str = "rn",
    partitions: int | None = None,
) -> DataFrame:
    """Exact ``row_number()`` per ``keys`` (or overall), spread over range partitions.

    The sort key must be unique. Rows are range-partitioned on keys and order, so
    one hot key spans many partitions; the position inside a partition comes from
    its sorted order, and a small table of rows per (partition, key) gives the
    offset. The placed rows are written to the shared folder, so both reads see the
    same layout even if an executor is lost in between. The offsets are counted, and
    broadcast only while they are few; beyond that they are joined with a shuffle.
    """
    spark = df.sparkSession
    order = [*[F.col(k).asc() for k in keys], *order_by]
    path = scratch_path(spark, "ranked")
    # without a number AQE joins small neighbouring ranges, which keeps their order
    ranges = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    (
        ranges.sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    # the upper bits of the id are the range partition, the lower 33 the position in it
    placed = spark.read.parquet(path).withColumn("_pid", F.shiftright("_mid", 33).cast("int"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = (
        placed.groupBy("_pid", *keys)
        .agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
        # at most one row per (range partition, key with rows in it) reaches this window
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(by.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .select(
            F.col("_pid").alias("_opid"),
            *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)],
            "_first",
            "_before",
        )
    )
    # without keys there is one row per partition
    if not keys or placed.select("_pid", *keys).distinct().count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    same = F.col("_pid") == F.col("_opid")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    return placed.join(offsets, same).select(
        *df.columns, (F.col("_mid") - F.col("_first") + F.col("_before") + 1).alias(name)
    )


#: A decimal of 38 digits, the widest number a hash aggregate updates in place, holds 126 bits.
RANK_BITS = 124


def packed_rank(*fields: tuple[str | Column, int] | tuple[str | Column, int, str]) -> Column:
    """One number that orders rows as the fields do, from left to right.

    A field is ``(whole number, bits)``, or ``(whole number, bits, "down")`` for descending order. Values lie between 0 and
    ``2**bits - 2``, others raise; null comes before 0 (behind it in descending order). Up to 62 bits in all make a long, up to
    124 a decimal of 38 digits; both are buffers that ``min`` and ``max`` update in place in a hash aggregate.
    """
    words: list[tuple[Column, int]] = []
    for value, bits, *down in fields:
        if not 1 <= bits <= 62:
            raise ValueError(f"a field has 1 to 62 bits, not {bits}")
        most = (1 << bits) - 1
        v = col(value).cast("long")
        fine = F.when(v.between(0, most - 1), v + 1).otherwise(F.raise_error(F.concat(F.lit(f"does not fit {bits} bits: "), v.cast("string"))).cast("long"))
        v = F.when(v.isNull(), F.lit(0).cast("long")).otherwise(fine)
        v = F.lit(most) - v if down else v
        if words and words[-1][1] + bits <= 62:
            last, width = words.pop()
            words.append((F.shiftleft(last, bits) + v, width + bits))
        else:
            words.append((v, bits))
    if sum(w for _, w in words) > RANK_BITS:
        raise ValueError(f"more than {RANK_BITS} bits")
    if len(words) == 1:
        return words[0][0]
    whole = lambda v: v.cast("decimal(38,0)")
    return reduce(lambda high, low: (high * F.lit(Decimal(1 << low[1])).cast("decimal(20,0)") + whole(low[0])).cast("decimal(38,0)"), words[1:], whole(words[0][0]))


def first_by_rank(df: DataFrame, keys: Sequence[str | Column], rank: Column) -> DataFrame:
    """First row of every key by a rank that no two rows of ``df`` share.

    The aggregate sees keys and ranks only; the whole rows of the winners are fetched by rank, which spreads a hot key over
    all tasks of that join. Null keys are a key of their own.
    """
    winners = df.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(rank).alias("_first"))
    return df.withColumn("_rank", rank).join(winners.select(F.col("_first").alias("_rank")), "_rank", "left_semi").select(*[f"`{c}`" for c in df.columns])


def ordinals(df: DataFrame, column: str, name: str) -> DataFrame:
    """``(column, name)``: place of every different value in ascending order, from 0; a small written table.

    For facts of files, batches and the like: all values together are one array (a million names are some 60 MB).
    """
    values = df.agg(F.array_sort(F.collect_set(column)).alias("v"))  # partial sets in the tasks, nulls left out
    return written(values.select(F.posexplode("v").alias(name, column)), "ordinals")


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key by ascending ``order``, from a combinable ``min_by``."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column | str]) -> DataFrame:
    """Last row of every key by ascending ``order``, from a combinable ``max_by``."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys, order, pick) -> DataFrame:
    key_cols = [col(k) for k in keys]
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key_cols)]).agg(pick(row, rank).alias("_row"))
    return picked.select("_row.*")
