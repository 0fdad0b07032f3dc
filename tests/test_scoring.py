import pytest
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import ramps
from parlance.operators import patterns, runs, scoring
from parlance.operators.rules.base import METRIC_TYPE

SCHEMA = (
    "rule_id string, is_overall boolean, time_period string, dims map<string,string>, row_count bigint, eligible_count bigint, passed_count bigint, "
    "failed_count bigint, skipped_count bigint, metric_name string, value double, value_map map<string,double>, unit string, numerator double, "
    "denominator double, threshold string, outcome string"
)


def metric(rule, name, value, outcome="passed", overall=True, period=None, site=None, rows=10, eligible=10, top=1.0, bottom=10.0):
    dims = {"site": site} if site else {}
    return (rule, overall, period, dims, rows, eligible, eligible, 0, rows - eligible, name, value, None, "ratio", top, bottom, None, outcome)


def score_all(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA)
    return scoring.score_metrics(scoring.primary_metrics(table), scoring.metric_availability(table), **options)


@pytest.mark.parametrize(
    ("value", "score"), [(0.69, 0.0), (0.7, 0.0), (0.8, 50.0), (0.9, 100.0), (0.95, 100.0)],
)
def test_rising_ramp(spark, value, score):
    found = spark.range(1).select(ramps.higher_is_better_linear(F.lit(value), F.lit(0.7), F.lit(0.9))).first()[0]
    assert found == pytest.approx(score)


@pytest.mark.parametrize(("value", "score"), [(0.0, 100.0), (0.01, 100.0), (0.055, 50.0), (0.1, 0.0), (1.0, 0.0)])
def test_falling_ramp(spark, value, score):
    assert spark.range(1).select(ramps.lower_is_better_linear(F.lit(value), F.lit(0.01), F.lit(0.1))).first()[0] == pytest.approx(score)


@pytest.mark.parametrize(
    ("value", "score"), [(29.0, 0.0), (30.0, 0.0), (35.0, 50.0), (40.0, 100.0), (250.0, 100.0), (275.0, 50.0), (300.0, 0.0), (301.0, 0.0)],
)
def test_range_ramp(spark, value, score):
    bounds = [F.lit(b) for b in (30.0, 40.0, 250.0, 300.0)]
    assert spark.range(1).select(ramps.inside_range_linear(F.lit(value), *bounds)).first()[0] == pytest.approx(score)


@pytest.mark.parametrize(
    ("score", "band"),
    [(100.0, "excellent"), (90.0, "excellent"), (89.99, "acceptable"), (75.0, "acceptable"), (60.0, "watch"), (40.0, "poor"), (39.9, "critical"), (None, "not_evaluated")],
)
def test_bands(spark, score, band):
    assert spark.range(1).select(ramps.score_band(F.lit(score).cast("double"))).first()[0] == band


def test_population_is_never_mixed(spark):
    rows = [
        metric("fill_rate", "fill_rate", 0.8, "warning"), metric("fill_rate", "fill_rate", 0.1, "failed", False, "2024-01"),
        metric("pii_detection", "pii_record_rate", None, "not_evaluated"), metric("pii_detection", "pii_record_rate", 0.01, "failed", False, "2024-01"),
        metric("topic_distribution", "jensen_shannon_divergence", 0.05, "warning", False, "2024-02", bottom=None, top=None),
        metric("topic_distribution", "dominant_topic_share", 0.5), metric("unknown", "x", 0.5),
    ]
    found = scoring.primary_metrics(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(row["rule_id"], row["is_overall"], row["value"]) for row in found} == {
        ("fill_rate", True, 0.8), ("pii_detection", False, 0.01), ("topic_distribution", False, 0.05),
    }


def test_partial_and_missing_availability(spark):
    rows = [metric("fill_rate", "fill_rate", 0.8, eligible=9), metric("pii_detection", "pii_record_rate", 0.0, eligible=0)]
    strict = {row["rule_id"]: row for row in score_all(spark, rows).collect()}
    assert (strict["fill_rate"]["availability"], strict["fill_rate"]["score"], strict["fill_rate"]["band"]) == ("partial", None, "not_evaluated")
    assert strict["pii_detection"]["availability"] == "unavailable"
    loose = {row["rule_id"]: row for row in score_all(spark, rows, allow_partial=True).collect()}
    assert (loose["fill_rate"]["availability"], loose["fill_rate"]["score"]) == ("available", pytest.approx(50.0))


def test_rule_score_weighs_groups(spark):
    rows = [
        metric("pii_detection", "pii_record_rate", 0.0, "passed", False, "2024-01", bottom=30.0, top=0.0),
        metric("pii_detection", "pii_record_rate", 0.01, "failed", False, "2024-02", bottom=10.0, top=2.0),
        metric("pii_detection", "other", 0.0),
    ]
    scores = score_all(spark, rows)
    row = scoring.rule_scores(scores).first()
    assert (row["score"], row["population"], row["records_evaluated"], row["records_affected"]) == (pytest.approx(87.5), "groups", 40, 2)
    assert scoring.group_scores(scores).count() == 2


def full(spark, names, value=1.0):
    weights = {rule: weight for rule, _, weight, *_ in fixed.SCORE_CATALOGUE}
    rows = [(rule, weights[rule], 50.0 * value, "available") for rule in names]
    return spark.createDataFrame(rows, "rule_id string, weight double, score double, availability string")


def test_aggregate_needs_coverage(spark):
    names = [rule for rule, *_ in fixed.SCORE_CATALOGUE]
    whole = scoring.aggregate_score(full(spark, names)).first()
    assert (whole["score"], whole["availability"], whole["contributing_rules"]) == (pytest.approx(50.0), "available", 7)
    few = scoring.aggregate_score(full(spark, ["fill_rate", "pii_detection"])).first()
    assert (few["score"], few["band"]) == (None, "not_evaluated") and few["coverage_ratio"] == pytest.approx(0.35)
    left = {row["rule_id"] for row in scoring.unscored_rules(full(spark, names[:5])).collect()}
    assert left == set(names[5:])


def test_confidence(spark):
    names = [rule for rule, *_ in fixed.SCORE_CATALOGUE]
    completed = spark.createDataFrame([(name,) for name in names], "rule_id string")
    evidence = spark.createDataFrame([("a", False), ("b", True)], "rule_id string, truncated boolean")

    def value(**options):
        return scoring.assessment_confidence(full(spark, names), completed, evidence, **{"provenance_matches": True, **options}).first()["confidence"]

    kept = 2 / 3 - 0.1
    assert value() == pytest.approx((0.3 + 0.25 + 0.15 * kept + 0.15) / 0.85, abs=1e-4)
    assert value(external_context_required=True) == pytest.approx(0.3 + 0.25 + 0.15 * kept + 0.15, abs=1e-4)
    assert value(external_context_required=False) == pytest.approx(0.3 + 0.25 + 0.15 * kept + 0.3, abs=1e-4)
    nothing = scoring.assessment_confidence(full(spark, names).limit(0), completed, evidence, True).first()
    assert nothing["confidence"] is None and nothing["factor_weight"] == pytest.approx(0.15)


EVIDENCE = "rule_id string, is_overall boolean, time_period string, site string, observed_count bigint, retained_count bigint, truncated boolean"


def test_patterns(spark):
    rows = [
        ("a", True, None, None, 5, 5, False), ("b", True, None, None, 2, 2, False), ("a", False, "2024-01", "x", 3, 3, False),
        ("a", False, "2024-02", "x", 2, 2, False), ("b", False, "2024-01", "y", 2, 2, False), ("c", False, "2024-01", "x", 0, 0, False),
    ]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    together = patterns.cooccurring_failures(evidence, ["site"]).collect()
    assert [(row["rule_ids"], row["observed_failures"]) for row in together] == [(["a", "b"], 7)]
    repeated = patterns.repeated_failures(evidence, ["site"]).collect()
    assert [(row["rule_ids"], row["time_periods"], row["observed_failures"]) for row in repeated] == [(["a"], ["2024-01", "2024-02"], 5)]
    causes = patterns.root_cause_candidates(patterns.failure_patterns(evidence, ["site"])).collect()
    assert {row["category"] for row in causes} == {"aggregate_technical_cooccurrence", "repeated_technical_pattern"}
    assert not any(row["causal_claim"] for row in causes)


def test_impact_and_recommendations(spark):
    scores = score_all(spark, [metric("pii_detection", "pii_record_rate", 0.5, "failed"), metric("fill_rate", "fill_rate", 0.95, "passed")])
    impact = patterns.impact_hypotheses(scores).collect()
    assert {(row["impact_dimension"], row["review"]) for row in impact} == {("privacy_and_data_handling", "required"), ("data_integrity", "required")}
    advice = patterns.recommendations(scores).collect()
    assert [(row["catalogue_id"], row["priority"], row["review"]) for row in advice] == [("rec-privacy-controlled-review", "critical", "required")]


def test_facts_are_capped_with_a_count(spark):
    table = spark.createDataFrame([metric("fill_rate", f"m{i}", 0.5) for i in range(7)], SCHEMA)
    evidence = spark.createDataFrame([("a", True, None, None, 5, 5, False)], EVIDENCE)
    kept, dropped = patterns.fact_table(table, evidence, ["site"], limit=3)
    assert kept.count() == 3 and dropped.first()[0] == 5


def test_run_status(spark):
    def status(*names, warnings=0):
        df = spark.createDataFrame([(str(i), name) for i, name in enumerate(names)], "rule_id string, status string")
        return runs.run_status(df, warnings).first()[0]

    assert status("completed") == "completed"
    assert status("completed", warnings=1) == "completed_with_warnings"
    assert status("completed", "skipped") == "completed_with_warnings"
    assert status("completed", "failed", "skipped") == "partial"
    assert status("implementation_pending") == "partial"


def test_metric_type_is_the_table_schema():
    assert "value_map:map<string,double>" in METRIC_TYPE


def test_texts_are_inspected_once_for_metrics_and_failures(spark, monkeypatch):
    from harness import scoring_queries, text_queries

    asked, inspect = [], text_queries.calls_features
    monkeypatch.setattr(scoring_queries, "_known", {})
    monkeypatch.setattr(text_queries, "calls_features", lambda *args, **options: asked.append(1) or inspect(*args, **options))
    folder = "/root/testdata/sf0.001"
    assert scoring_queries.metrics(spark, folder).count() > 0 and scoring_queries.failures(spark, folder).count() > 0
    assert len(asked) == 1
