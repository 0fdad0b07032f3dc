"""Nearest neighbours against all distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import block_neighbours

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def distance(left, right):
    total = 0.0
    for a, b in zip(left, right, strict=True):
        gap = float(a) - float(b)
        total += gap * gap
    return math.sqrt(total)


def plain(rows, k):
    held = [
        (i, vec_id, [float(np.float32(x)) for x in vector]) for i, (vec_id, vector) in enumerate(rows)
        if vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
    ]
    found = []
    for i, query, vector in held:
        if query is None or query % 100:
            continue
        others = [
            (distance(vector, other), vec_id is None, vec_id or 0) for j, vec_id, other in held
            if i != j and len(other) == len(vector)
        ]
        found += [
            (query, rank, None if missing else vec_id, score) for rank, (score, missing, vec_id) in enumerate(sorted(others)[:k], 1)]
    return sorted(found, key=repr)


def nearest(spark, rows, k, **options):
    df = spark.createDataFrame([(vec_id, vector, "x") for vec_id, vector in rows], SCHEMA)
    return sorted((tuple(r) for r in block_neighbours.nearest(df, F.col("vec_id") % 100 == 0, k, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"group_bytes": 600, "slice_bytes": 2000}, {"tile": 50}])
def test_against_all_distances(spark, options):
    chance = np.random.default_rng(3)
    rows = [(i, chance.normal(size=6).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)]
    rows += [(2000, [0.5] * 6), (2000, [0.5] * 6), (2100, (chance.normal(size=6) * 1e-30).astype(np.float32).tolist())]
    assert nearest(spark, rows, 10, **options) == plain(rows, 10)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (None, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (200, None), (300, [1e38, -3e38]), (8, [1.0]),
    ]
    found = nearest(spark, rows, 3)
    assert found == plain(rows, 3)
    assert [row[2] for row in sorted(r for r in found if r[0] == 0)] == [7, None, None]
    assert nearest(spark, [(1, [1.0])], 3) == [] == nearest(spark, [(0, [1.0])], 3) == nearest(spark, [], 3)


def test_bounds_hold():
    chance = np.random.default_rng(4)
    vectors = chance.normal(size=(300, 1500)) * 10.0 ** chance.integers(-12, 12, size=(300, 1))
    codes, scales, squares, left_out = block_neighbours._coded(vectors)
    near = squares[:, None] + squares - 2 * scales[:, None] * scales * block_neighbours._products(codes, codes)
    true = np.sqrt(((vectors[:, None] - vectors) ** 2).sum(axis=2))
    slack, reach = 1e-12 * (squares[:, None] + squares), left_out[:, None] + left_out
    assert (np.sqrt(np.maximum(near - slack, 0)) - reach <= true).all()
    assert (np.sqrt(np.maximum(near, 0) + slack) + reach >= true).all()
    assert (codes.astype(int) @ codes.T.astype(int) == block_neighbours._products(codes, codes)).all()


def test_double_vectors(spark):
    rows = [(100 * i, [float(i) * 1e200, 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = block_neighbours.nearest(df, F.col("vec_id") == 0, 2).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found] == [(1, 100, math.inf), (2, 200, math.inf)]
