import datetime
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.functions import hashing
from parlance.operators import applicability as ap
from parlance.operators import classify, relationships, signals
from parlance.operators import profile as prof
from parlance.sources.readers import logical_type, normalize_dictionary

ROWS = [
    (i, None if i % 10 == 0 else float(i), "NA" if i % 4 == 0 else f"t{i % 3}", datetime.date(2024, 1, 1 + i % 5), "Agent: hi | a@b.org")
    for i in range(200)
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "call_id int, duration double, topic string, call_date date, transcript string")


@pytest.fixture(scope="module")
def profiles(table):
    return prof.profile(table, "calls").cache()


def test_statistics(profiles):
    found = {row["column_name"]: row for row in profiles.collect()}
    duration = found["duration"]
    values = [float(i) for i in range(200) if i % 10]
    assert (duration["non_null_count"], duration["null_count"], duration["fill_rate"]) == (180, 20, 0.9)
    assert duration["numeric"]["mean"] == pytest.approx(statistics.mean(values))
    assert duration["numeric"]["standard_deviation"] == pytest.approx(statistics.stdev(values))
    topic = found["topic"]
    assert (topic["non_null_count"], topic["distinct_count"], topic["inferred_type"]) == (150, 3, "string")
    assert sum(entry["count"] for entry in topic["top_values"]) == 150
    assert topic["top_values"][0]["percentage"] == pytest.approx(topic["top_values"][0]["count"] / 1.5)
    assert found["call_date"]["temporal"]["maximum"] == datetime.datetime(2024, 1, 5)
    assert found["transcript"]["detected_patterns"] == ["email_like", "speaker_labels", "pipe_delimited"]
    assert found["transcript"]["text"]["average_length"] == 19.0
    assert len(found["call_id"]["safe_samples"]) == 10 and len(found["call_id"]["top_values"]) == 20


def test_single_and_no_values(spark):
    df = spark.createDataFrame([(5.0, None), (None, None)], "a double, b string")
    found = {row["column_name"]: row for row in prof.profile(df, "t").collect()}
    assert found["a"]["numeric"]["standard_deviation"] == 0.0
    assert (found["b"]["inferred_type"], found["b"]["type_confidence"], found["b"]["distinct_count"]) == ("unknown", 0.0, 0)


def test_distinct_cap(table):
    found = {row["column_name"]: row for row in prof.distinct_counts(prof.value_counts(table, "t"), many=3).collect()}
    assert (found["topic"]["distinct_count"], found["topic"]["distinct_size"]) == (3, "few")
    assert found["call_id"]["distinct_count"] > 3 and found["call_id"]["distinct_size"] == "many"


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 10]], "v double")
    exact = {r["probability"]: r["quantile"] for r in prof.quantiles(df, "t", (0.0, 0.25, 0.5, 0.9, 1.0), exact=True).collect()}
    assert exact == pytest.approx({0.0: 1.0, 0.25: 1.0, 0.5: 1.0, 0.9: 5.8, 1.0: 10.0})
    distinct = {r["probability"]: r["quantile"] for r in prof.quantiles(df, "t", (0.25, 0.5, 0.75), distinct=True).collect()}
    assert distinct == pytest.approx({0.25: 1.75, 0.5: 2.5, 0.75: 4.75})
    near = {r["probability"]: r["quantile"] for r in prof.quantiles(df, "t", (0.5,)).collect()}
    assert near == {0.5: 1.0}
    big = spark.range(100_000).select(F.col("id").cast("double").alias("v"))
    approx = {r["probability"]: r["quantile"] for r in prof.quantiles(big, "t").collect()}
    assert all(abs(value - probability * 100_000) <= 20 for probability, value in approx.items())


def test_logical_types(spark):
    df = spark.sql("select 1 i, 1.5D d, 1.5 c, 'x' s, true b, current_date() t, timestamp_ntz'2024-01-01' n, array(1) a, map(1, 2) m, struct(1) r, interval 1 hour h")
    assert [logical_type(item.dataType) for item in df.schema.fields] == [
        "integer", "float", "float", "string", "boolean", "date", "datetime", "array", "json", "json", "duration",
    ]


def test_classification(spark, profiles):
    raw = spark.createDataFrame(
        [(1, "transcript", "cleaned transcript text", "string"), (2, "duration", "duration of the call in seconds", "float"), (3, "call_date", "date", "date")],
        "line int, name string, description string, type string",
    )
    domains = classify.classify_columns(profiles, normalize_dictionary(raw, "line"))
    found = {row["column_name"]: row for row in domains.collect()}
    # name 1 of 2 words, description 2 of 2, pattern matched, type matched, and its share of related columns
    related = 0.05 * 1 / 6
    assert found["transcript"]["confidence"] == pytest.approx(0.15 + 0.35 + 0.2 + 0.1 + related, abs=1e-6)
    assert (found["transcript"]["domain"], found["transcript"]["confidence_level"]) == ("conversation.transcript", "high")
    assert (found["duration"]["domain"], found["duration"]["semantic_type"]) == ("interaction.duration", "media_duration")
    assert (found["call_id"]["domain"], found["call_id"]["requires_review"]) == ("unknown", True)
    guard = {row["column_name"]: row["allowed"] for row in classify.grouping_guard(profiles, domains).collect()}
    assert guard["topic"] and not guard["transcript"]
    related = relationships.discover(profiles, domains)
    kinds = {(row["relationship_type"], row["source_column"], row["target_column"]) for row in related.collect()}
    assert kinds == {
        ("identifier", "call_id", None), ("identifier", "duration", None), ("categorical_dimension", "topic", None),
        ("categorical_dimension", "call_date", None), ("transcript_duration", "transcript", "duration"),
    }


def test_signals(spark):
    names = "table_name string, column_name string, domain string, value double, sample_size bigint, confidence double, exact boolean, distinct_topics bigint"
    data = [
        ("t", "low", "x", 0.79, 10, 1.0, True, None), ("t", "edge", "x", 0.8, 10, 1.0, True, None), ("t", "fine", "x", 0.99, 10, 1.0, True, None),
    ]
    fill = spark.createDataFrame(data, names).withColumn("check_name", F.lit("fill_rate")).withColumn("metric_name", F.lit("fill_rate"))
    topic = spark.createDataFrame(
        [("t", "a", "conversation.topic", 0.96, 100, 0.75, False, 2), ("t", "b", "conversation.topic", 0.96, 99, 0.75, False, 2),
         ("t", "c", "conversation.topic", 0.96, 100, 0.75, False, 1), ("t", "d", "other", 0.96, 100, 0.75, False, 2)], names,
    ).withColumn("check_name", F.lit("topic_distribution")).withColumn("metric_name", F.lit("dominant_topic_share"))
    matched = signals.with_policies(fill.unionByName(topic), signals.policy_table(spark))
    strong, weak = signals.suppress_weak(matched)
    ranked = signals.rank_signals(signals.apply_bands(strong)).collect()
    assert [(row["column_name"], row["severity"]) for row in ranked] == [("low", "critical"), ("edge", "high"), ("a", "high")]
    assert ranked[0]["message"] == "Column low is filled at 79.00%, below the expected 80.00%."
    assert {row["column_name"]: row["suppressed_because"] for row in weak.collect()} == {
        "b": "the sample is too small", "c": "distinct-topic coverage is insufficient",
    }


def test_outside_band(spark):
    rows = [("t", "x", "conversation.transcript", v, 200, 1.0, True, None, "speech_per_duration_rate", "speech_words_per_minute") for v in (29.0, 30.0, 59.0, 60.0, 301.0)]
    names = "table_name string, column_name string, domain string, value double, sample_size bigint, confidence double, exact boolean, distinct_topics bigint, check_name string, metric_name string"
    for row, severity in zip(rows, ("high", "medium", "medium", None, "high")):
        matched = signals.with_policies(spark.createDataFrame([row], names), signals.policy_table(spark))
        found = [item["severity"] for item in signals.apply_bands(matched).collect()]
        assert found == ([severity] if severity else [])


def test_own_extractor(spark, profiles):
    def lengths(profiled, domains):
        return profiled.select(
            F.lit("length").alias("check_name"), F.lit("average_length").alias("metric_name"), "table_name", "column_name", F.lit("x").alias("domain"),
            F.col("text.average_length").alias("value"), F.col("row_count").alias("sample_size"), F.lit(1.0).alias("confidence"), F.lit(True).alias("exact"),
            F.lit(None).cast("bigint").alias("distinct_topics"),
        ).where("value is not null")

    domains = classify.classify_columns(profiles)
    observed = signals.observe(profiles, domains, (signals.profile_observations, lengths))
    assert observed.where("check_name = 'length'").count() == 2
    coverage = {row["check_name"]: row["available"] for row in signals.check_coverage(observed).collect()}
    assert coverage["fill_rate"] and not coverage["pii_detection"] and len(coverage) == 7


def test_applicability_modes(spark, profiles):
    schema = "table_name string, column_name string, domain string, semantic_type string, confidence double"
    domains = spark.createDataFrame([("calls", "transcript", "d", "s", 0.5), ("calls", "topic", "d", "z", 0.9)], schema)
    none = spark.createDataFrame([], "table_name string, relationship_type string, source_column string, target_column string")

    def targets(**options):
        decided = ap.rule_applicability([ap.Selector("r", **options)], profiles, domains, none).collect()
        return decided[0]["status"], decided[0]["target_columns"]

    assert targets(required_domains=("d",)) == ("applicable", ["topic", "transcript"])
    assert targets(required_domains=("d",), semantic_types=("s",), match_mode="all") == ("applicable", ["transcript"])
    assert targets(required_domains=("d",), minimum_domain_confidence=0.6) == ("applicable", ["topic"])
    assert targets(column_name_patterns=("^call_",), excluded_column_patterns=("date",)) == ("applicable", ["call_id"])
    assert targets(required_relationship_types=("identifier",)) == ("not_applicable", [])
    assert targets(required_domains=("d",), enabled=False)[0] == "disabled"
    assert targets(required_domains=("d",), approved=False)[0] == "needs_review"


def test_awkward_column_names(spark):
    df = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], ["it's", "dotted.name", "back`tick"])
    found = {row["column_name"]: row for row in prof.profile(df, "t").collect()}
    assert set(found) == {"it's", "dotted.name", "back`tick"}
    assert found["it's"]["null_count"] == 1 and found["dotted.name"]["numeric"]["maximum"] == 2.0
    assert found["back`tick"]["distinct_count"] == 2


def test_texts_are_counted_before_they_are_hashed(spark):
    """Marks, long, padded and escaped texts keep the hash of their JSON form; what is missing is asked after counting."""
    texts = ["", "s", "#", "#s", "s1", "1", " none ", "\tNULL", "say \"so\"", "a\nb", "é" * 64, "é" * 65, "s" * 65, " " * 70, "none" + " " * 70, None] * 3
    df = spark.createDataFrame([(text, [text], 1.5, True) for text in texts], "t string, a array<string>, d double, b boolean")
    found = {(row["column_name"], row["value_hash"]): row["n"] for row in prof.value_counts(df, "t").collect()}
    each = df.select(*[F.struct(F.lit(i.name).alias("c"), F.when(
        ~prof.is_missing(F.col(i.name), i.dataType), hashing.value_hash(F.col(i.name), logical_type(i.dataType))).alias("h")).alias(i.name) for i in df.schema.fields])
    want = Counter((row[name]["c"], row[name]["h"]) for row in each.collect() for name in df.columns if row[name]["h"])
    assert found == want and sum(n for (name, _), n in want.items() if name == "t") == 30
    plan = prof.value_counts(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Aggregate [column_name" in line and "sha2" in line]


def _below_the_count(counts):
    """Lines of the optimised plan under the aggregate that counts forms."""
    lines = counts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return lines[next(i for i, line in enumerate(lines) if "Aggregate [column_name" in line and "form" in line) + 1 :]


def test_no_cell_is_hashed_or_inspected_before_the_count(spark):
    """A filter on what follows from the counted form alone would be moved below the count."""
    df = spark.createDataFrame([("a", 1.5), ("none", None)], "t string, d double")
    filters = [line for line in _below_the_count(prof.value_counts(df, "t")) if "Filter" in line]
    assert not any("sha2" in line or "RLIKE" in line for line in filters)
    found = prof.value_counts(df, "t", {"t": F.col("d") > 1, "d": F.lit(False)}).collect()
    assert [(row["column_name"], row["n"]) for row in found] == [("t", 1)]
    assert prof.value_counts(df, "t", {}).count() == 0
