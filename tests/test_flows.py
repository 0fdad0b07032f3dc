"""Whole flows: incremental results, the assessment, and the shape of plans."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from harness import tables as tb
from parlance.operators import evidence as ev
from parlance.operators import grouping as grp
from parlance.operators import binding, classify, columns, signals
from parlance.operators.applicability import Selector
from parlance.operators.features import text_features
from parlance.operators.filters import Filter, apply_filters
from parlance.operators.grouping import Grouping
from parlance.operators.rules import base, fill_rate, topics
from parlance.operators.rules import transcript_rules as tr
from parlance.plans import assessment
from parlance.sources.segments import SegmentLog
from parlance.streaming import incremental

FOLDER = "/root/testdata/sf0.001"
BY_DAY = Grouping("day", "month", {"site": "site"})
BY_NONE = Grouping()


def batch(spark, first, last):
    text = F.when(F.col("id") % 3 == 0, "Agent: a@b.org").otherwise("Agent: x Customer: y")
    return spark.range(first, last).select(
        "id", text.alias("t"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
        F.when(F.col("id") % 2 == 0, "n").otherwise("s").alias("site"), F.col("id").cast("double").alias("length"),
    )


def rules(df):
    return [tr.speaker_tag_rule(), tr.pii_rule(), tr.speech_rate_rule("length", "seconds", 1.0)]


def prepare(df):
    return text_features(df, "t")


def test_batches_equal_one_shot(spark, tmp_path):
    source, partials, progress = (str(tmp_path / name) for name in ("in", "partials", "progress"))
    schema = batch(spark, 0, 1).schema

    def run():
        incremental.start_incremental(
            spark, source, schema, "parquet", partials, progress, BY_DAY, rules, prepare, files_per_batch=1
        ).awaitTermination()

    batch(spark, 0, 40).coalesce(2).write.mode("append").parquet(source)
    run()
    batch(spark, 40, 70).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert len(list((tmp_path / "partials").glob("segment-*"))) >= 2
    made = rules(prepare(batch(spark, 0, 70)))
    stored = incremental.stored_metrics(spark, partials, BY_DAY, made).drop("value_map", "dims").collect()
    whole = base.run_rules(prepare(batch(spark, 0, 70)), made, BY_DAY).drop("value_map", "dims").collect()
    assert sorted(map(repr, stored)) == sorted(map(repr, whole))


def test_a_batch_of_one_file_is_prepared_by_all_cores(spark, tmp_path):
    source, partials, progress, parts = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), []
    batch(spark, 0, 40).coalesce(1).write.parquet(source)

    def prepare(df):
        parts.append(df.rdd.getNumPartitions())
        return text_features(df, "t")

    incremental.start_incremental(
        spark, source, batch(spark, 0, 1).schema, "parquet", partials, progress, BY_DAY, rules, prepare, spread=True).awaitTermination()
    assert parts == [spark.sparkContext.defaultParallelism]
    whole = base.run_rules(text_features(batch(spark, 0, 40), "t"), rules(None), BY_DAY)
    assert incremental.stored_metrics(spark, partials, BY_DAY, rules(None)).count() == whole.count()


def test_incremental_evidence_and_topics_under_a_group_limit(spark, tmp_path):
    """Batches, folded and replayed, give what one run over all rows gives, groups beyond the limit folded."""
    grouping = Grouping("day", "month", {"site": "site"}, overflow="other", maximum_groups=3)
    ready = prepare(batch(spark, 0, 90)).withColumn("topic", F.concat_ws(";", "site", (F.col("id") % 4).cast("string")))
    evidence = incremental.EvidenceSource("id", "calls", b"salt", per_group=2)
    topic = incremental.TopicSource("topic")
    log = SegmentLog(spark, str(tmp_path / "store"), fanout=2)
    folding = incremental.folds(grouping, rules(ready), 2)
    for number in range(5):
        part = ready.where(F.col("id") % 5 == number)
        tables = incremental.partial_tables(part, grouping, rules(part), topic, evidence)
        assert log.commit(number, tables)
        log.fold(folding)
        assert not log.commit(number, tables)
    assert [(s.first, s.last, s.level) for s in log.segments()] == [(0, 3, 2), (4, 4, 0)]
    assert incremental.compact(spark, log.root, grouping, rules(ready), 2) == 2
    assert [(s.first, s.last) for s in log.segments()] == [(0, 4)] and not log.commit(3, {})
    assert len(list((tmp_path / "store").glob("segment-*"))) == 1 and len(list((tmp_path / "store").glob("manifest-*"))) == 1
    records, totals = incremental.stored_evidence(spark, log.root, grouping, rules(ready), 2, 40)
    keyed = grp.limit_groups(grp.group_keys(ready, grouping), grouping)
    failing = ev.failures(keyed, rules(ready), grouping, "id")
    whole = ev.collect_evidence(failing, grouping, "id", "calls", b"salt", 2, 40)
    assert sorted(map(tuple, records.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    summed = ev.evidence_summary(failing, whole, grouping)
    assert sorted(map(tuple, totals.collect()), key=repr) == sorted(map(tuple, summed.collect()), key=repr)
    tables = incremental.stored_topics(spark, log.root, grouping, 3)
    one = topics.topic_states(ready, "topic", grouping, limit=3)
    for left, right in zip(tables, one, strict=True):
        assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))


def test_store_keeps_one_writer(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "store"))
    assert log.segments() == [] and log.committed() == -1 and log.read("t") is None and log.fold({}) == 0
    log.commit(3, {"t": spark.range(2)})
    with pytest.raises(RuntimeError):
        log._publish([], 1)
    assert log.committed() == 3 and log.read("t").count() == 2
    (tmp_path / "store" / "segment-lost").mkdir()
    assert log.read("t").count() == 2


def test_category_counts_of_batches(spark):
    first = spark.createDataFrame([("k", "a", 2), ("k", "b", 1)], "k string, category string, n bigint")
    merged = incremental.merge_category_counts([first, first], ["k"], "category", "n").collect()
    assert {(row["category"], row["n"]) for row in merged} == {("a", 4), ("b", 2)}


def test_assessment(spark):
    calls = tb.calls(spark, FOLDER).withColumn("topic", F.concat_ws(";", "source", "lang"))
    words = spark.createDataFrame([(f"w{i}",) for i in range(600)], "word string")
    columns = assessment.TranscriptColumns("call_id", "transcript", "duration_ms", "topic", ("call_id", "transcript", "lang"))
    settings = assessment.Settings("documents", b"salt", tb.LEXICON, allow_partial=True)
    grouping = Grouping("call_day", "month", {"lang": "lang"})
    made = assessment.assess(calls, columns, grouping, settings, [Filter("lang", "is_not_null")], words)
    summary = made["check_summary"].collect()
    assert len(summary) == 7 and all(row["grouped_result_count"] > 0 for row in summary)
    assert made["run_status"].first()[0] == "completed"
    run = made["run_summary"].first()
    assert (run["rows_read"], run["rules_requested"], run["rules_failed"]) == (200, 7, 0) and run["groups_created"] > 1
    assert made["aggregate_score"].first()["availability"] == "available"
    assert 0 < made["confidence"].first()["confidence"] <= 1
    assert made["evidence"].count() == run["evidence_retained"]
    for name in ("patterns", "root_causes", "impact_hypotheses", "recommendations", "facts"):
        assert made[name].count() > 0, name
    for table in made.values():
        assert "transcript" not in table.columns and "tokens" not in table.columns


def test_a_rule_that_raises_leaves_the_others(spark):
    """Only the raising rule fails, whatever its place; a failure that is not a rule's own is raised."""
    df = spark.createDataFrame([(1, "x", "2024-01-01"), (2, "7", "2024-01-02")], "id int, c string, day string")
    good = [base.Rule(f"r{i}", F.lit(True), F.col("id") > i, lambda state: [base.Metric("m", state("passed_count"))]) for i in range(5)]
    bad = base.Rule("bad", F.lit(True), F.col("c").cast("int") > 0, lambda state: [])
    named = base.Rule("named", F.lit(True), F.col("id") > 1, lambda state: [], failure_category=F.concat(F.lit("c"), F.col("c").cast("int").cast("string")))
    lost = base.Rule("lost", F.col("nowhere") > 0, None, lambda state: [])
    keyed = grp.group_keys(df, BY_NONE)
    states, running, failing = base.measure_apart(keyed, [good[0], bad, *good[1:], named, lost], BY_NONE)
    assert [rule.rule_id for rule in running] == ["r0", "r1", "r2", "r3", "r4"]
    assert failing == {"bad": "CAST_INVALID_INPUT", "named": "CAST_INVALID_INPUT", "lost": "UNRESOLVED_COLUMN.WITH_SUGGESTION"}
    assert states.agg(F.sum("r0__passed_count"), F.sum("r1__passed_count")).first() == (2, 1)
    states, running, failing = base.measure_apart(keyed, [bad], BY_NONE)
    assert running == [] and states.first()["row_count"] == 2 and set(failing) == {"bad"}
    assert base.metric_table(grp.roll_up(states, BY_NONE, {"row_count": "sum"}), [], BY_NONE).count() == 0
    broken = keyed.withColumn("id", F.raise_error(F.lit("no input")).cast("int"))
    with pytest.raises(PySparkException):
        base.measure_apart(broken.withColumn("in_group", F.col("id") > 0), good, BY_NONE)


def test_roles_found_for_an_assessment(spark):
    df = spark.createDataFrame([(1, "hi", "2024-01-05T10:00:00+02:00", "a", "b")], "k int, Transcript string, day string, theme string, topic_name string")
    known = [binding.ColumnDomain("theme", "conversation.topic"), binding.ColumnDomain("topic_name", "conversation.topic")]
    table, columns = assessment.bind(df, "k", domains=known, declared={"DAY": "Date"})
    assert (columns.transcript, columns.duration, columns.topic) == ("Transcript", None, "topic_name")
    assert dict(table.dtypes)["day"] == "date"
    assert assessment.bind(df, "k", {"topic": "theme"}, known)[1].topic == "theme"
    assert assessment.bind(df.drop("topic_name"), "k", domains=known[:1])[1].topic == "theme"
    with pytest.raises(binding.BindingError):
        assessment.bind(df.drop("Transcript"), "k")


def test_notes_travel_with_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "2024-05-01"), ("b", "y", "soon")], "plain string, secret_part string, day string")
    guard = spark.createDataFrame([("t", "secret_part", False, True, False), ("t", "plain", True, False, False), ("other", "plain", False, True, False)],
                                  "table_name string, column_name string, allowed boolean, sensitive boolean, free_text boolean")
    noted = columns.annotated(df, "t", guard, declared={"Day": "DATE"})
    noted.where("plain <> ''").join(df.select(F.col("plain").alias("p")), F.col("plain") == F.col("p")).drop("p").write.parquet(f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    for frame in (noted, back):
        with pytest.raises(columns.UnsafeColumnError):
            apply_filters(frame, [Filter("secret_part", "is_null")])
        with pytest.raises(columns.UnsafeColumnError):
            grp.group_keys(frame, Grouping(dimensions={"s": "secret_part"}))
        assert apply_filters(frame, [Filter("plain", "equals", ("a",))]).count() == 1
        assert [r["plain"] for r in apply_filters(frame, [Filter("day", "less_than", (datetime.date(2025, 1, 1),))]).collect()] == ["a"]
        assert {r["d"] for r in grp.group_keys(frame, Grouping(dimensions={"d": "day"})).collect()} == {"2024-05-01", "__UNKNOWN__"}


def test_chosen_rules(spark):
    calls = tb.calls(spark, FOLDER)
    columns = assessment.TranscriptColumns("call_id", "transcript", targets=("lang",))
    settings = assessment.Settings("documents", b"salt")
    made = assessment.assess(calls, columns, Grouping("call_day", "month"), settings, only=("fill_rate", "Privacy Detection"))
    assert {row["rule_id"] for row in made["metrics"].select("rule_id").distinct().collect()} == {"fill_rate", "pii_detection"}
    assert made["aggregate_score"].first()["score"] is None
    with pytest.raises(ValueError):
        base.measured_name("nothing")


def test_options_own_and_failing_rules(spark):
    calls = tb.calls(spark, FOLDER)
    columns = assessment.TranscriptColumns("call_id", "transcript", targets=("lang",))
    own = base.Rule("long_text", F.col("text_present"), F.col("token_count") > 20, lambda state: [
        base.Metric("long_share", state("passed_count") / state("eligible_count"), "ratio")])
    broken = base.Rule("broken", F.col("no_such_column") > 0, None, lambda state: [])
    settings = assessment.Settings(
        "documents", b"salt", rule_options={"pii_detection": {"maximum_record_rate": 1.0}}, own_rules=(own, broken))
    made = assessment.assess(calls, columns, Grouping(), settings)
    metrics = {row["metric_name"]: row for row in made["metrics"].where("is_overall").collect()}
    assert metrics["pii_record_rate"]["outcome"] == "passed" and 0 < metrics["long_share"]["value"] <= 1
    assert made["run_status"].first()[0] == "partial" and made["run_summary"].first()["rules_failed"] == 1
    with pytest.raises(ValueError):
        assessment.assess(calls, columns, Grouping(), assessment.Settings("d", b"s", rule_options={"x": {}}))


def test_unsafe_columns_are_refused(spark):
    guard = spark.createDataFrame([("lang", True), ("transcript", False)], "column_name string, allowed boolean")
    calls = tb.calls(spark, FOLDER)
    columns = assessment.TranscriptColumns("call_id", "transcript", targets=("lang",))
    settings = assessment.Settings("documents", b"salt")
    for grouping, filters in ((Grouping(dimensions={"t": "transcript"}), []), (Grouping(), [Filter("transcript", "is_not_null")])):
        with pytest.raises(classify.UnsafeColumnError):
            assessment.assess(calls, columns, grouping, settings, filters, guard=guard)
    classify.enforce_guard(guard, ["lang", None])


def test_understanding(spark):
    tables = {name: tb.load(spark, FOLDER, name) for name in ("orders", "conversations")}
    made = assessment.understand(tables, signals.policy_table(spark), [Selector("fill_rate", column_name_patterns=("key$",))])
    assert made["profile"].count() == 10 and made["domains"].count() == 10
    found = {row["table_name"]: row["target_columns"] for row in made["applicable_rules"].collect()}
    assert found == {"orders": ["o_custkey", "o_orderkey"], "conversations": []}
    assert made["check_coverage"].where("available").count() >= 1


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_scan_once_without_text_in_the_shuffle(spark):
    rows = prepare(spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("t", F.col("text")))
    table = base.run_rules(rows, [tr.speaker_tag_rule(), tr.pii_rule()], Grouping(dimensions={"lang": "lang"}, grain="none"))
    plan = physical(table)
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
    reduced = plan.index("HashAggregate", plan.index("Expand"))
    assert reduced < plan.index("FileScan") and "Expand" not in plan[reduced:]


def test_filters_and_columns_reach_the_scan(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    kept = apply_filters(events, [Filter("event_type", "equals", ["click"]), Filter("value", "greater_than", [5.0])])
    table = base.run_rules(kept, [fill_rate.fill_rate_rule(kept, ["user_id"])], Grouping("ts", "month"))
    plan = physical(table)
    assert "GreaterThan(value,5.0)" in plan and "EqualNullSafe(event_type,click)" in plan
    assert "props" not in plan and "event_id" not in plan


def test_ranking_keeps_few_rows_before_the_shuffle(spark):
    keyed = grp.group_keys(prepare(batch(spark, 0, 10)), BY_DAY)
    failing = ev.failures(keyed, rules(keyed), BY_DAY, "id")
    plan = physical(ev.collect_evidence(failing, BY_DAY, "id", "src", b"salt"))
    assert plan.count("WindowGroupLimit") == 2
    samples = physical(ev.stratified_sample(batch(spark, 0, 10), "t", "id", "src", "site", "day"))
    assert samples.count("WindowGroupLimit") == 2


SAMPLE = (
    "fill_rate_by_month", "group_overflow_folded", "category_frequencies", "transcript_rules_in_one_pass", "topic_distribution_rule", "unknown_words",
    "evidence_totals", "review_samples", "column_top_values", "exchange_speaker_turns", "metric_scores", "rule_applicability", "transcript_duration_pairs",
)


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cross_joins(spark, name):
    plan = physical(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["transcript_rules_in_one_pass", "token_counts", "column_top_values", "spelling_rule"])
def test_no_python_in_the_plan(spark, name):
    plan = physical(entry.queries()[name](spark, FOLDER))
    assert "Python" not in plan and "InPandas" not in plan
