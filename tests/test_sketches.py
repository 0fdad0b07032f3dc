"""Sketches of columns: what they settle is exact, what they estimate is close, and parts merge."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import profile as prof
from parlance.operators import sketches as sk


@pytest.fixture(scope="module")
def skewed(spark):
    """A unique column, one with few heavy values and a long tail, a sparse one, and an empty one."""
    return spark.range(60000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.concat(F.lit("w"), (F.col("id") % 11).cast("string")))
        .otherwise(F.concat(F.lit("tail"), F.col("id").cast("string"))).alias("mixed.name"),
        F.when(F.col("id") % 100 == 0, (F.col("id") % 5).cast("double")).alias("sparse"),
        F.lit(None).cast("int").alias("empty"),
        F.when(F.col("id") % 2 == 0, "none").otherwise("x").alias("flag"),
    ).repartition(6)


@pytest.fixture(scope="module")
def sketches(skewed):
    return sk.column_sketches(skewed, "t", tracked=1000).cache()


def test_distinct_counts(skewed, sketches):
    found = {row["column_name"]: row for row in sk.distinct_counts(skewed, "t", sketches, many=1000).collect()}
    exact = {row["column_name"]: row["distinct_count"] for row in prof.distinct_counts(prof.value_counts(skewed, "t")).collect()}
    assert set(found) == set(exact) and "empty" not in found
    for name, row in found.items():
        if exact[name] <= 1000:
            assert (row["distinct_count"], row["distinct_count_mode"], row["distinct_size"]) == (exact[name], "exact", "few")
        else:
            assert abs(row["distinct_count"] - exact[name]) <= 0.03 * exact[name] and row["distinct_count_mode"] == "estimate"


def test_top_values_and_samples_are_exact(skewed, sketches):
    statistics = prof.column_statistics(skewed, "t")
    whole = prof.value_counts(skewed, "t")
    for limit, in_full in ((5, ["id"]), (20, ["id", "mixed.name"])):
        counts, counted_in_full = sk.frequent_value_counts(skewed, "t", sketches, limit, proposed=30, tracked=1000)
        assert sorted(counted_in_full) == in_full
        got, want = (sorted(map(tuple, prof.top_values(c, statistics, limit).collect())) for c in (counts, whole))
        assert got == want
    near = sk.sampled_value_counts(skewed, "t", sketches)
    assert near.where("column_name = 'id'").count() < 200
    assert sorted(map(tuple, prof.hashed_samples(near).collect())) == sorted(map(tuple, prof.hashed_samples(whole).collect()))


def test_merged_parts(skewed):
    parts = [sk.column_sketches(skewed.where(F.col("id") % 4 == part), "t", tracked=1000) for part in range(4)]
    merged = sk.merge_sketches(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), tracked=1000).cache()
    estimates = {row["column_name"]: row for row in sk.distinct_estimates(merged).collect()}
    assert estimates["id"]["value_count"] == 60000 and abs(estimates["id"]["distinct_estimate"] - 60000) < 1800
    assert (estimates["empty"]["value_count"], estimates["empty"]["distinct_estimate"]) == (0, 0)
    for row in sk.quantile_estimates(merged).where("column_name = 'id'").collect():
        assert abs(row["quantile"] - row["probability"] * 60000) < 1200
    counts, _ = sk.frequent_value_counts(skewed, "t", merged, 2, proposed=30, tracked=1000)
    assert counts.where("column_name = 'mixed.name'").agg(F.max("n")).first()[0] == 20000


def test_no_rows_and_awkward_columns(spark):
    df = spark.createDataFrame([], "a int, b string, c array<int>, d map<string,int>")
    made = sk.column_sketches(df, "t")
    assert [row["distinct_estimate"] for row in sk.distinct_estimates(made).collect()] == [0, 0, 0, 0]
    assert sk.quantile_estimates(made).count() == 0
    full = spark.createDataFrame([(1, "x", [1], {"k": 1}), (1, "y", [2], {"k": 1})], df.schema)
    made = sk.column_sketches(full, "t")
    assert {row["column_name"]: row["distinct_estimate"] for row in sk.distinct_estimates(made).collect()} == {"a": 1, "b": 2, "c": 2, "d": 1}
    assert sk.sampled_value_counts(full.select("a", "b", "c"), "t", made.where("column_name <> 'd'")).count() == 5


def test_values_of_a_table_without_any(spark):
    """Nothing is proposed for a table without values; only the kinds asked for are made."""
    empty = spark.createDataFrame([], "a int, b string")
    made = sk.column_sketches(empty, "t", kinds=("distinct", "frequent"))
    assert made.columns == ["table_name", "column_name", "value_count", "distinct_sketch", "frequent_sketch"]
    counts, whole = sk.frequent_value_counts(empty, "t", made)
    assert (counts.count(), whole) == (0, [])
    assert sk.sampled_value_counts(empty, "t", made).count() == 0
