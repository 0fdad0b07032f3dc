"""Scores from rule metrics.

Input is the standard metric table. It holds at most a few thousand groups, so
everything here is cheap next to the scan that made it; the score catalogue is a
short list and travels inside the expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import hashing, ramps

AVAILABLE, PARTIAL, UNAVAILABLE, NOT_EVALUATED = "available", "partial", "unavailable", "not_evaluated"


def metric_availability(metrics: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """Per rule: whether all, some or no rows could be judged, from the overall rows."""
    overall = metrics.where("is_overall").groupBy("rule_id").agg(
        F.max("row_count").alias("rows"), F.max("eligible_count").alias("eligible")
    )
    if rules is not None:
        asked = metrics.sparkSession.createDataFrame([(name,) for name in rules], "rule_id string")
        overall = asked.join(overall, "rule_id", "left")
    eligible, rows = F.coalesce("eligible", F.lit(0)), F.coalesce("rows", F.lit(0))
    return overall.select(
        "rule_id",
        F.when(eligible == 0, UNAVAILABLE).when(eligible < rows, PARTIAL).otherwise(AVAILABLE).alias("availability"),
        eligible.alias("eligible_count"),
        (rows - eligible).alias("unavailable_count"),
        F.coalesce(ramps.ratio(eligible, rows), F.lit(0.0)).alias("coverage"),
    )


# A catalogue entry: rule, metric, weight, formula, bounds and scope.
Catalogue = Sequence[tuple[str, str, float, str, Sequence[float], str]]


def _catalogue(catalogue: Catalogue) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule_id"), F.lit(metric).alias("metric_name"), F.lit(weight).alias("weight"),
                F.lit(formula).alias("formula"), F.array(*[F.lit(float(b)) for b in bounds]).alias("bounds"),
                F.lit(scope).alias("scope"),
            )
            for rule, metric, weight, formula, bounds, scope in catalogue
        ]
    )


def primary_metrics(metrics: DataFrame, catalogue: Catalogue = fixed.SCORE_CATALOGUE) -> DataFrame:
    """The catalogued metric of each rule, from one population only.

    Overall is used when it has a value, otherwise the groups, never both;
    metrics that exist only per group use the groups.
    """
    entry = F.element_at(
        F.filter(
            _catalogue(catalogue),
            lambda item: (item["rule_id"] == F.col("rule_id")) & (item["metric_name"] == F.col("metric_name")),
        ),
        1,
    )
    known = [(rule, metric) for rule, metric, *_ in catalogue]
    listed = F.lit(False)
    for rule, metric in known:
        listed = listed | ((F.col("rule_id") == rule) & (F.col("metric_name") == metric))
    candidates = metrics.where(listed).withColumn("entry", entry).select(*metrics.columns, "entry.weight", "entry.formula", "entry.bounds", "entry.scope")
    usable = (F.col("outcome") != NOT_EVALUATED) & _numeric(F.col("value"))
    per_rule = candidates.groupBy("rule_id").agg(
        F.max(F.col("is_overall") & usable).alias("overall_usable"), F.max(~F.col("is_overall")).alias("has_groups")
    )
    grouped_only = F.col("scope") == "grouped_required"
    wanted = F.when(grouped_only, ~F.col("is_overall")).when(
        F.col("overall_usable") | ~F.col("has_groups"), F.col("is_overall")
    ).otherwise(~F.col("is_overall"))
    return candidates.join(per_rule, "rule_id").where(wanted).drop("overall_usable", "has_groups")


def _numeric(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def score_metrics(primary: DataFrame, availability: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Score, band and availability of every primary metric."""
    rule_availability = availability.select("rule_id", F.col("availability").alias("rule_availability"))
    joined = primary.join(rule_availability, "rule_id", "left")
    usable = (F.col("outcome") != NOT_EVALUATED) & _numeric(F.col("value"))
    state = F.coalesce("rule_availability", F.lit(UNAVAILABLE))
    available = (
        F.when(~usable, NOT_EVALUATED).when(state == AVAILABLE, AVAILABLE)
        .when(state == PARTIAL, AVAILABLE if allow_partial else PARTIAL).otherwise(UNAVAILABLE)
    )

    def bound(position: int) -> Column:
        return F.try_element_at(F.col("bounds"), F.lit(position))

    raw = (
        F.when(F.col("formula") == "higher_is_better_linear", ramps.higher_is_better_linear(F.col("value"), bound(1), bound(2)))
        .when(F.col("formula") == "lower_is_better_linear", ramps.lower_is_better_linear(F.col("value"), bound(1), bound(2)))
        .when(
            F.col("formula") == "inside_range_linear",
            ramps.inside_range_linear(F.col("value"), bound(1), bound(2), bound(3), bound(4)),
        )
    )
    scored = joined.withColumn("availability", available)
    scored = scored.withColumn("score", F.when(F.col("availability") == AVAILABLE, raw))
    return scored.select(
        hashing.stable_id("score-", 32, F.col("rule_id"), F.col("metric_name"), F.col("time_period"), F.to_json("dims"), F.col("formula")).alias("score_id"),
        "rule_id", "metric_name", "is_overall", "time_period", "dims", "value", "numerator", "denominator", "outcome",
        "availability", "score", ramps.score_band(F.col("score")).alias("band"), "weight", "formula",
    )


def rule_scores(scores: DataFrame) -> DataFrame:
    """One score per rule: its overall score, else the denominator-weighted mean of its groups."""
    per_rule = scores.groupBy("rule_id").agg(F.max("is_overall").alias("has_overall"))
    chosen = scores.join(per_rule, "rule_id").where(F.col("is_overall") | ~F.col("has_overall"))
    counted = (F.col("availability") == AVAILABLE) & F.col("score").isNotNull()
    zero_free = F.when(F.col("denominator").isNull() | (F.col("denominator") == 0), 1.0).otherwise(F.col("denominator"))
    weight = F.when(counted, zero_free)
    order = {NOT_EVALUATED: 0, UNAVAILABLE: 1, PARTIAL: 2, AVAILABLE: 3}
    rank = F.lit(0)
    for name, position in order.items():
        rank = F.when(F.col("availability") == name, position).otherwise(rank)
    positive = {name: F.sum(F.when(F.col(name) >= 0, F.floor(name)).otherwise(0)) for name in ("denominator", "numerator")}
    summed = chosen.groupBy("rule_id").agg(
        F.max("weight").alias("weight"),
        F.first("has_overall").alias("has_overall"),
        F.count_if(counted).alias("scored_metrics"),
        F.try_divide(F.sum(F.col("score") * weight), F.sum(weight)).alias("score"),
        F.min(rank).alias("worst"),
        positive["denominator"].cast("bigint").alias("records_evaluated"),
        positive["numerator"].cast("bigint").alias("records_affected"),
    )
    worst = F.element_at(F.array(*[F.lit(name) for name in order]), F.col("worst") + 1)
    return summed.select(
        "rule_id", "weight", "score",
        ramps.score_band(F.col("score")).alias("band"),
        F.when(F.col("scored_metrics") > 0, AVAILABLE).otherwise(worst).alias("availability"),
        F.when(F.col("has_overall"), "overall").otherwise("groups").alias("population"),
        "records_evaluated", "records_affected",
    )


def group_scores(scores: DataFrame) -> DataFrame:
    """Scores of the single groups, for rules without an overall score."""
    per_rule = scores.groupBy("rule_id").agg(F.max("is_overall").alias("has_overall"))
    return scores.join(per_rule, "rule_id").where(~F.col("has_overall")).select(
        "rule_id", "time_period", "dims", "score", "band", "availability",
        F.coalesce(F.col("denominator").cast("bigint"), F.lit(0)).alias("records_evaluated"),
        F.coalesce(F.col("numerator").cast("bigint"), F.lit(0)).alias("records_affected"),
    )


def aggregate_score(
    rules: DataFrame, minimum_coverage: float = fixed.MINIMUM_WEIGHT_COVERAGE, catalogue: Catalogue = fixed.SCORE_CATALOGUE
) -> DataFrame:
    """One score over the rules that have one, null when too little weight is covered."""
    total = sum(weight for _, _, weight, *_ in catalogue)
    if abs(total - 1.0) > 1e-6:
        raise ValueError("rule weights must sum to one")
    counted = (F.col("availability") == AVAILABLE) & F.col("score").isNotNull()
    summed = rules.agg(
        F.coalesce(F.sum(F.when(counted, F.col("weight"))), F.lit(0.0)).alias("coverage_ratio"),
        F.sum(F.when(counted, F.col("weight") * F.col("score"))).alias("weighted"),
        F.count_if(counted).alias("contributing_rules"),
    )
    score = F.when(F.col("coverage_ratio") >= minimum_coverage, F.try_divide("weighted", "coverage_ratio"))
    return summed.select(
        score.alias("score"),
        ramps.score_band(score).alias("band"),
        F.when(score.isNull(), NOT_EVALUATED).otherwise(AVAILABLE).alias("availability"),
        "coverage_ratio",
        F.lit(minimum_coverage).alias("minimum_coverage_ratio"),
        "contributing_rules",
    )


def unscored_rules(rules: DataFrame, catalogue: Catalogue = fixed.SCORE_CATALOGUE) -> DataFrame:
    """Catalogued rules that lack an available score."""
    scored = rules.where((F.col("availability") == AVAILABLE) & F.col("score").isNotNull()).select("rule_id")
    catalogued = rules.sparkSession.createDataFrame([(rule,) for rule, *_ in catalogue], "rule_id string")
    return catalogued.join(scored, "rule_id", "left_anti")


def assessment_confidence(
    rules: DataFrame,
    completed: DataFrame,
    evidence: DataFrame,
    provenance_matches: bool,
    external_context_required: bool | None = None,
    verified_citations: int = 0,
    weights: Mapping[str, float] = fixed.CONFIDENCE_WEIGHTS,
) -> DataFrame:
    """How complete the assessment is: a weighted mean of its coverage factors.

    ``completed`` lists rules that ran to the end; ``evidence`` is an evidence
    summary. A factor that does not apply is left out, and the result is null
    when the remaining weight is too small.
    """
    done = completed.select("rule_id").distinct().withColumn("is_complete", F.lit(True))
    judged = rules.join(done, "rule_id", "left")
    counted = (F.col("availability") == AVAILABLE) & F.col("score").isNotNull()
    coverage = judged.agg(
        F.count(F.lit(1)).alias("selected"),
        F.try_divide(F.sum(F.when(F.col("is_complete"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("rule_coverage"),
        F.try_divide(F.sum(F.when(counted, F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("metric_coverage"),
    )
    kept = evidence.agg(
        F.count(F.lit(1)).alias("collections"), F.coalesce(F.max("truncated"), F.lit(False)).alias("any_truncated")
    )
    share = F.least(F.lit(1.0), F.col("collections") / fixed.CONFIDENCE_EVIDENCE_COLLECTIONS)
    reduced = F.greatest(F.lit(0.0), share - F.when(F.col("any_truncated"), fixed.CONFIDENCE_TRUNCATION_PENALTY).otherwise(0.0))
    single_rows = coverage.unionByName(kept, allowMissingColumns=True)
    facts = single_rows.agg(*[F.max(name).alias(name) for name in single_rows.columns])
    has_rules = F.col("selected") > 0
    factors = {
        "rule_coverage": F.when(has_rules, F.col("rule_coverage")),
        "metric_coverage": F.when(has_rules, F.col("metric_coverage")),
        "evidence_coverage": F.when(has_rules, reduced),
        "source_provenance": F.lit(1.0 if provenance_matches else 0.0),
    }
    if external_context_required is not None:
        cited = min(1.0, verified_citations / fixed.CONFIDENCE_MINIMUM_CITATIONS)
        factors["external_context_coverage"] = F.lit(cited if external_context_required else 1.0)
    weight = sum((F.when(value.isNotNull(), weights[name]).otherwise(0.0) for name, value in factors.items()), F.lit(0.0))
    total = sum((F.coalesce(value * weights[name], F.lit(0.0)) for name, value in factors.items()), F.lit(0.0))
    measured = facts.select(*[value.alias(name) for name, value in factors.items()], weight.alias("factor_weight"), total.alias("total"))
    confidence = F.when(
        F.col("factor_weight") >= fixed.CONFIDENCE_MINIMUM_WEIGHT,
        F.bround(F.col("total") / F.col("factor_weight"), fixed.CONFIDENCE_DECIMALS),
    )
    return measured.withColumn("confidence", confidence).drop("total")

