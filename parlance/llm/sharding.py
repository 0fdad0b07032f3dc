"""A reproducible shuffle of rows into shards by a Feistel permutation of their row numbers.

Rows are numbered from 0 in the order of their key columns, whatever the partitioning. A keyed Feistel network permutes the
smallest even-bit domain that holds all numbers; a number that lands outside the table walks on through the network until it
lands inside, which keeps the map a permutation of 0..n-1. Position p goes to shard p mod shards, slot p div shards, so
shard sizes differ by one at most, slots have no gaps, and both follow from the row number alone; `row_number_at` inverts.

Cases: a null text has 16 bytes of size and checksum 0; equal keys are numbered by checksum and size, and rows equal in all
of these are interchangeable; an empty table gives an empty result; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import stored

ROUNDS = 6
ROW_OVERHEAD = 16


def _round_key(seed: int, number: int) -> np.uint64:
    value = np.array([(seed * 0x9E3779B97F4A7C15 + number + 1) % (1 << 64)], dtype=np.uint64)
    return _scramble(value)[0]


def _scramble(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def half_bits(count: int) -> int:
    return max(1, (max(count - 1, 1).bit_length() + 1) // 2)


def _network(values: np.ndarray, bits: int, seed: int, backwards: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = values >> shift, values & mask
    for number in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        if backwards:
            left, right = right ^ (_scramble(left ^ _round_key(seed, number)) & mask), left
        else:
            left, right = right, left ^ (_scramble(right ^ _round_key(seed, number)) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, count: int, seed: int, backwards: bool = False) -> np.ndarray:
    """The permutation of 0..count-1 chosen by the seed, or its inverse."""
    bits = half_bits(count)
    moved = _network(np.asarray(numbers, dtype=np.uint64), bits, seed, backwards)
    outside = np.flatnonzero(moved >= count)
    while len(outside):
        moved[outside] = _network(moved[outside], bits, seed, backwards)
        outside = outside[moved[outside] >= count]
    return moved.astype(np.int64)


def row_number_at(shard: int, slot: int, shards: int, count: int, seed: int) -> int:
    """The row number that sits in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), count, seed, backwards=True)[0])


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Number rows from 0 in the given order, without gathering them in one task.

    The frame is sorted by ranges and written once, with each row's place in its range. Counts of ranges, one row per
    task, then give each range its first number.
    """
    placed = stored(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "sorted-rows")
    part = F.shiftrightunsigned("_place", 33)
    counts = sorted((row["part"], row["n"]) for row in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    firsts, total = [], 0
    for number, n in counts:
        firsts.append((number, total))
        total += n
    offsets = df.sparkSession.createDataFrame(firsts or [(0, 0)], "_part bigint, _first bigint")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_first") + inside).drop("_place", "_part", "_first")
    )


def feistel_shards(
    df: DataFrame, shards: int, seed: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row: id, size, text_crc32, row_number, shard and slot."""
    text = F.coalesce(df[text_column].cast("string"), F.lit(""))
    slim = df.select(
        df[id_column].alias("_id"),
        (F.octet_length(text).cast("bigint") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = numbered(slim, [F.col("_id"), F.col("text_crc32"), F.col("size")])
    count = rows.count()

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                places = permute(batch.column("row_number").to_numpy(), count, seed)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array((places % shards).astype(np.int32)), pa.array(places // shards)],
                    [*batch.schema.names, "shard", "slot"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"_id {kind}, size bigint, text_crc32 bigint, row_number bigint, shard int, slot bigint"
    return rows.mapInArrow(deal, schema).withColumnRenamed("_id", id_column)
