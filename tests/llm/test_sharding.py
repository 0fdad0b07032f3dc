"""Feistel shards: a permutation, reproducible, with even shards."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import sharding
from parlance.llm.queries import op3_feistel_shards

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("count", [1, 2, 3, 5, 16, 17, 1000, 4096, 4097])
def test_permutation_and_inverse(count):
    numbers = np.arange(count)
    moved = sharding.permute(numbers, count, seed=3)
    assert sorted(moved.tolist()) == numbers.tolist()
    assert sharding.permute(moved, count, seed=3, backwards=True).tolist() == numbers.tolist()
    if count > 100:
        assert moved.tolist() != sharding.permute(numbers, count, seed=4).tolist()


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = {row["doc_id"]: row for row in op3_feistel_shards(spark, FOLDER).collect()}
    assert len(found) == len(docs)
    places = sharding.permute(np.arange(len(docs)), len(docs), 0).tolist()
    shards: dict = {}
    for (key, text), place in zip(docs, places, strict=True):
        row, data = found[key], text.encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        assert (row["shard"], row["slot"]) == (place % 40, place // 40)
        shards.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_partitioning_does_not_matter_and_places_invert(spark):
    rows = [(i, f"t{i}") for i in range(97)]
    results = []
    for parts in (1, 3, 11):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts).withColumn("size", F.lit("x"))
        results.append(sorted(tuple(row) for row in sharding.feistel_shards(df, 7, seed=5).collect()))
    assert results[0] == results[1] == results[2]
    for key, _, _, number, shard, slot in results[0]:
        assert key == number == sharding.row_number_at(shard, slot, 7, 97, 5)


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "é"), (2, "")], "doc_id bigint, text string")
    found = sharding.feistel_shards(df, 10).collect()
    assert sorted((row["size"], row["text_crc32"]) for row in found) == [(16, 0), (16, 0), (16, 0), (18, zlib.crc32("é".encode()))]
    assert sorted(row["row_number"] for row in found) == [0, 1, 2, 3]
    assert sharding.feistel_shards(df.limit(0), 10).collect() == []
