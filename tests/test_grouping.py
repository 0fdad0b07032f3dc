import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parlance.functions import dates
from parlance.operators import binding
from parlance.operators import evidence as ev
from parlance.operators import grouping as grp
from parlance.operators.filters import Filter, apply_filters, condition
from parlance.operators.grouping import Grouping, GroupLimitError
from parlance.operators.rules import base

ROWS = [
    (1, "2024-01-31", "a", 1.0),
    (2, "2024-02-01T00:30:00+02:00", "a", 2.0),
    (3, "bad", "b", float("nan")),
    (4, None, None, float("inf")),
    (5, "2024-02-29", "", -3.0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, day string, kind string, v double")


def counts(df, grouping):
    states = {**grp.counters(F.lit(True), F.col("v") > 0), **grp.moments("v", F.col("v"))}
    found = grp.measure(df, grouping, states).collect()
    return {(row["is_overall"], *[row[key] for key in grouping.keys]): row for row in found}


def test_unknown_buckets(rows):
    found = counts(rows, Grouping("day", "month", {"kind": "kind"}))
    assert set(found) == {
        (True, None, None), (False, "2024-01", "a"), (False, "__UNKNOWN_TIME__", "b"),
        (False, "__UNKNOWN_TIME__", "__UNKNOWN__"), (False, "2024-02", ""),
    }
    overall = found[(True, None, None)]
    assert (overall["row_count"], overall["v_count"], overall["v_sum"], overall["v_min"], overall["v_max"]) == (5, 3, 0.0, -3.0, 2.0)
    assert overall["v_invalid"] == 2


def test_excluded_rows_count_overall_only(rows):
    found = counts(rows, Grouping("day", "month", {"kind": "kind"}, invalid_time="exclude", null_dimension="exclude"))
    assert found[(True, None, None)]["row_count"] == 5
    assert sum(row["row_count"] for key, row in found.items() if not key[0]) == 3


@pytest.mark.parametrize("options", [{"invalid_time": "fail"}, {"null_dimension": "fail"}])
def test_fail_policies(rows, options):
    with pytest.raises(PySparkException):
        counts(rows, Grouping("day", "month", {"kind": "kind"}, **options))


def test_group_limit(rows):
    with pytest.raises(GroupLimitError):
        counts(rows, Grouping(dimensions={"kind": "kind"}, grain="none", maximum_groups=3))
    found = counts(rows, Grouping(dimensions={"kind": "kind"}, grain="none", maximum_groups=3, overflow="other"))
    assert {key[1]: row["row_count"] for key, row in found.items() if not key[0]} == {"a": 2, "": 1, "__OTHER__": 2}


def test_without_keys_or_overall(rows):
    assert set(counts(rows, Grouping(grain="none"))) == {(True,)}
    found = counts(rows, Grouping(dimensions={"kind": "kind"}, grain="none", include_overall=False))
    assert all(not key[0] for key in found) and len(found) == 4


def test_partition_count_does_not_matter(rows):
    one = counts(rows.coalesce(1), Grouping("day", "day", {"kind": "kind"}))
    many = counts(rows.repartition(7), Grouping("day", "day", {"kind": "kind"}))
    assert one == many


def test_too_many_dimensions():
    with pytest.raises(ValueError):
        Grouping(dimensions={name: name for name in "abcd"})


@pytest.mark.parametrize(
    ("grain", "label"),
    [("day", "2024-12-30"), ("week", "2024-12-30/P7D"), ("month", "2024-12"), ("quarter", "2024-Q4"), ("year", "2024")],
)
def test_buckets(spark, grain, label):
    moment = F.lit(datetime.datetime(2024, 12, 30, 23, 0)).cast("timestamp_ntz")
    assert spark.range(1).select(dates.bucket(moment, grain)).first()[0] == label


def test_instants_move_to_the_zone(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 2, 0),)], "t timestamp")
    shifted = dates.wall_clock(F.col("t"), df.schema["t"].dataType, "America/New_York")
    assert df.select(dates.bucket(shifted, "day")).first()[0] == "2023-12-31"


def test_category_tail_is_exact(spark):
    df = spark.createDataFrame([("g", f"c{i}", i) for i in range(1, 11)], "k string, category string, n bigint")
    kept = {row["category"]: row["n"] for row in grp.category_counts(df, ["k"], "category", "n", 3).collect()}
    assert kept == {"c10": 10, "c9": 9, "c8": 8, "__OTHER__": 28}


@pytest.mark.parametrize(
    ("item", "wanted"),
    [
        (Filter("kind", "equals", ["a"]), [1, 2]),
        (Filter("kind", "not_equals", ["a"]), [3, 4, 5]),
        (Filter("kind", "in", ["a", None]), [1, 2, 4]),
        (Filter("kind", "not_in", ["a", None]), [3, 5]),
        (Filter("kind", "not_in", ["a"]), [3, 4, 5]),
        (Filter("kind", "is_null"), [4]),
        (Filter("v", "is_null"), [3, 4]),
        (Filter("v", "is_not_null"), [1, 2, 5]),
        (Filter("v", "greater_than", [1.0]), [2]),
        (Filter("v", "less_than_or_equal", [1]), [1, 5]),
        (Filter("v", "between", [-3.0, 1.0]), [1, 5]),
        (Filter("v", "greater_than", ["1"]), []),
        (Filter("kind", "greater_than", [1]), []),
        (Filter("kind", "not_equals", [1]), [1, 2, 3, 4, 5]),
        (Filter("v", "equals", [None]), [3, 4]),
    ],
)
def test_filters(rows, item, wanted):
    assert sorted(row["id"] for row in apply_filters(rows, [item]).collect()) == wanted


def test_filter_errors(rows):
    with pytest.raises(ValueError):
        condition(rows, Filter("kind", "like", ["a"]))
    with pytest.raises(ValueError):
        apply_filters(rows, [Filter("kind", "is_null")] * 11)


def test_roles(spark):
    df = spark.createDataFrame([("t", 5)], "Transcript string, duration_ms int")
    assert binding.resolve_role("transcript", df.columns) == "Transcript"
    assert binding.resolve_role("transcript", df.columns, {"transcript": "DURATION_MS"}) == "duration_ms"
    domains = [binding.ColumnDomain("duration_ms", "x", "transcript")]
    assert binding.resolve_role("transcript", df.columns, domains=domains) == "duration_ms"
    twice = domains + [binding.ColumnDomain("Transcript", "transcript")]
    with pytest.raises(binding.BindingError):
        binding.resolve_role("transcript", df.columns, domains=twice)
    with pytest.raises(binding.BindingError):
        binding.resolve_role("topic", df.columns, required=True)
    with pytest.raises(binding.BindingError):
        binding.resolve_role("topic", ["a", "A"])
    assert binding.bind_roles(df, ["transcript", "duration", "topic"]).columns == ["transcript", "duration"]


def test_group_columns(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1), "x", "2024-01-05")], "happened date, direction string, noted string")
    assert binding.bind_group_column(df, "direction") == "direction"
    assert binding.bind_group_column(df, "interaction_date", temporal=True) == "happened"
    assert binding.bind_group_column(df, "way", aliases=("direction",)) == "direction"
    retyped = binding.apply_declared_temporal(df, {"noted": "timestamp"})
    assert dict(retyped.dtypes)["noted"] == "timestamp_ntz"
    by_domain = binding.apply_declared_temporal(df, {}, [binding.ColumnDomain("noted", "interaction.time")])
    assert dict(by_domain.dtypes)["noted"] == "date"


def test_names_with_dots(spark):
    """A column's whole name is meant, in filters, dimensions, time and evidence alike."""
    df = spark.createDataFrame([(1, "x", "2024-01-05", "hi"), (2, "y", "2024-02-05", None)], ["row.key", "a.b", "on.day", "said.text"])
    assert [row["row.key"] for row in apply_filters(df, [Filter("a.b", "equals", ("x",))]).collect()] == [1]
    grouping = Grouping("on.day", "month", {"kind": "a.b"})
    keyed = grp.group_keys(df, grouping)
    assert {(row["time_period"], row["kind"]) for row in keyed.collect()} == {("2024-01", "x"), ("2024-02", "y")}
    rule = base.Rule("r", F.lit(True), F.lit(False), lambda state: [])
    failing = ev.failures(keyed, [rule], grouping, "row.key")
    assert ev.collect_evidence(failing, grouping, "row.key", "s", b"salt").count() == 4
    assert ev.stratified_sample(df, "said.text", "row.key", "s", "a.b", "on.day").count() == 1
