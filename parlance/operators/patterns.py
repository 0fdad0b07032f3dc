"""Patterns across rules, their possible impact, and the fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import hashing


def scope_id(dims: Sequence[str], with_time: bool = True, time: str = "time_period") -> Column:
    """Anonymous name of an aggregate scope; the parts are written as one JSON document."""
    parts = [F.struct(*[F.col(name).alias(name) for name in dims]).alias("dimensions")] if dims else []
    parts.append(F.col("is_overall").alias("overall"))
    if with_time:
        parts.append(F.col(time).alias("time_period"))
    document = F.to_json(F.struct(*parts))
    return F.concat(F.lit("scope-"), F.substring(F.sha2(document, 256), 1, 24))


def cooccurring_failures(evidence: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Scopes in which at least two rules fail. ``evidence`` is an evidence summary."""
    failing = evidence.where(F.col("observed_count") > 0).withColumn("scope_id", scope_id(dims))
    per_rule = failing.groupBy("scope_id", "rule_id").agg(F.sum("observed_count").alias("failures"))
    # The rules of a scope are at most as many as there are rules.
    return per_rule.groupBy("scope_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.sum("failures").alias("observed_failures")
    ).where(F.size("rule_ids") >= 2).select(
        hashing.stable_id("corr-", 24, F.lit("aggregate_cooccurrence"), F.col("scope_id"), F.array_join("rule_ids", "|")).alias("pattern_id"),
        F.lit("aggregate_cooccurrence").alias("pattern_type"),
        "scope_id",
        "rule_ids",
        F.array().cast("array<string>").alias("time_periods"),
        "observed_failures",
    )


def repeated_failures(evidence: DataFrame, dims: Sequence[str], minimum_periods: int = 2) -> DataFrame:
    """Rules that fail in several periods of one dimension tuple."""
    timed = evidence.where((F.col("observed_count") > 0) & F.col("time_period").isNotNull())
    scoped = timed.withColumn("scope_id", scope_id(dims, with_time=False))
    # Periods are bounded by the group limit.
    return scoped.groupBy("scope_id", "rule_id").agg(
        F.array_sort(F.collect_set("time_period")).alias("time_periods"), F.sum("observed_count").alias("observed_failures")
    ).where(F.size("time_periods") >= minimum_periods).select(
        hashing.stable_id("corr-", 24, F.lit("repeated_period_pattern"), F.col("scope_id"), F.col("rule_id"), F.array_join("time_periods", "|")).alias("pattern_id"),
        F.lit("repeated_period_pattern").alias("pattern_type"),
        "scope_id",
        F.array("rule_id").alias("rule_ids"),
        "time_periods",
        "observed_failures",
    )


def failure_patterns(evidence: DataFrame, dims: Sequence[str], limit: int | None = None) -> DataFrame:
    """All patterns of both kinds; with a limit, the first ones, co-occurrences before repetitions."""
    both = cooccurring_failures(evidence, dims).unionByName(repeated_failures(evidence, dims))
    ordered = both.orderBy("pattern_type", "rule_ids", "scope_id", "time_periods")
    return ordered if limit is None else ordered.limit(limit)


def root_cause_candidates(patterns: DataFrame, limit: int = fixed.ROOT_CAUSES_KEPT) -> DataFrame:
    """First patterns by identifier, typed for review; none claims a cause."""
    kind = F.when(F.col("pattern_type") == "repeated_period_pattern", "repeated_technical_pattern").otherwise(
        "aggregate_technical_cooccurrence"
    )
    return patterns.orderBy("pattern_id").limit(limit).select(
        hashing.stable_id("root-cause-", 24, F.col("pattern_id")).alias("candidate_id"),
        "pattern_id",
        kind.alias("category"),
        F.lit(True).alias("requires_review"),
        F.lit(False).alias("causal_claim"),
    )


# A condition: its name, rule, metric, outcomes, impact dimensions, classification and whether it needs review.
Conditions = Sequence[tuple[str, str, str, Sequence[str], Sequence[str], str, bool]]
# A recommendation: its name, condition, priority, whether it needs review, and title.
Recommendations = Sequence[tuple[str, str, str, bool, str]]


def _conditions(conditions: Conditions) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("condition_id"), F.lit(rule).alias("rule_id"), F.lit(metric).alias("metric_name"),
                F.array(*[F.lit(o) for o in outcomes]).alias("outcomes"),
                F.array(*[F.lit(d) for d in sorted(dimensions)]).alias("dimensions"),
                F.lit(kind).alias("classification"), F.lit(review).alias("review"),
            )
            for name, rule, metric, outcomes, dimensions, kind, review in conditions
        ]
    )


def matched_conditions(scores: DataFrame, conditions: Conditions = fixed.IMPACT_CONDITIONS) -> DataFrame:
    """Metric outcomes with the impact conditions they meet."""
    met = F.filter(
        _conditions(conditions),
        lambda item: (item["rule_id"] == F.col("rule_id"))
        & (item["metric_name"] == F.col("metric_name"))
        & F.array_contains(item["outcomes"], F.col("outcome")),
    )
    kept = ["rule_id", "metric_name", "is_overall", "time_period", "dims", "outcome"]
    return scores.withColumn("condition", F.explode(met)).select(*kept, "condition.condition_id", "condition.dimensions", "condition.classification", "condition.review")


def _fact() -> list[Column]:
    return [F.col("rule_id"), F.col("metric_name"), F.col("time_period"), F.to_json("dims")]


def impact_hypotheses(scores: DataFrame, conditions: Conditions = fixed.IMPACT_CONDITIONS) -> DataFrame:
    """One row per met condition and impact dimension."""
    each = matched_conditions(scores, conditions).withColumn("impact_dimension", F.explode("dimensions"))
    return each.select(
        hashing.stable_id("impact-", 24, F.col("condition_id"), F.col("impact_dimension"), *_fact()).alias("hypothesis_id"),
        "condition_id", "impact_dimension", "classification", "rule_id", "metric_name", "is_overall", "time_period", "dims", "outcome",
        F.when(F.col("review"), "required").otherwise("not_required").alias("review"),
    )


def recommendations(
    scores: DataFrame, conditions: Conditions = fixed.IMPACT_CONDITIONS, listed: Recommendations = fixed.RECOMMENDATIONS
) -> DataFrame:
    """The catalogued recommendation of every met condition."""
    catalogue = F.array(
        *[
            F.struct(
                F.lit(name).alias("catalogue_id"), F.lit(condition).alias("condition_id"), F.lit(priority).alias("priority"),
                F.lit(review).alias("review"), F.lit(title).alias("title"),
            )
            for name, condition, priority, review, title in listed
        ]
    )
    matching = F.filter(catalogue, lambda item: item["condition_id"] == F.col("condition_id"))
    met = matched_conditions(scores, conditions).drop("review").withColumn("entry", F.explode(matching))
    return met.select(
        hashing.stable_id("rec-", 24, F.col("condition_id"), *_fact()).alias("recommendation_id"),
        "entry.catalogue_id", "condition_id", "rule_id", "metric_name", "is_overall", "time_period", "dims", "entry.title", "entry.priority",
        F.when(F.col("entry.review"), "required").otherwise("not_required").alias("review"),
    )


def fact_table(metrics: DataFrame, evidence: DataFrame, dims: Sequence[str], limit: int = fixed.FACTS_KEPT) -> tuple[DataFrame, DataFrame]:
    """Metric facts and evidence summaries in identifier order, and how many were left out."""
    from_metrics = metrics.select(
        hashing.stable_id("fact-", 24, F.lit("metric"), *_fact()).alias("fact_id"),
        F.lit("execution_metric").alias("kind"), "rule_id", "metric_name", F.col("value"), "time_period",
    )
    from_evidence = evidence.select(
        hashing.stable_id("fact-", 24, F.lit("evidence"), F.col("rule_id"), scope_id(dims)).alias("fact_id"),
        F.lit("execution_evidence_summary").alias("kind"), "rule_id", F.lit("observed_failure_count").alias("metric_name"),
        F.col("observed_count").cast("double").alias("value"), "time_period",
    )
    everything = from_metrics.unionByName(from_evidence)
    kept = everything.orderBy("fact_id").limit(limit)
    dropped = everything.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - limit).alias("dropped_facts"))
    return kept, dropped
