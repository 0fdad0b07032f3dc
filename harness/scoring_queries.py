"""Queries over scores, patterns, impact and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import grouping_queries as gq
from harness import rule_queries as rq
from harness import tables as tb
from harness import text_queries as tq
from parlance import fixed_values as fixed
from parlance.functions import ramps
from parlance.operators import evidence as ev
from parlance.operators import patterns, runs, scoring
from parlance.operators.filters import Filter, apply_filters
from parlance.operators.rules import base, fill_rate, topics
from parlance.operators.rules import transcript_rules as tr
from parlance.sources.storage import materialize

_known: dict = {}
DIMS = ["lang"]


def _once(spark, folder, name, make):
    """A table several queries read, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _known:
        _known[key] = materialize(make(), name).inputFiles()[0].rsplit("/", 1)[0]
    return spark.read.parquet(_known[key])


def features(spark, folder):
    """Features of the calls with unknown-word counts, and the vocabulary size: texts are inspected once for metrics and failures."""
    key = (spark.sparkContext.applicationId, folder, "vocabulary size")

    def make():
        rows, _known[key] = rq.call_rows(spark, folder)
        return rows

    return _once(spark, folder, "features", make), _known[key]


def metrics(spark, folder):
    """Metrics of all seven rules over events, calls and orders."""

    def make():
        events = tb.events_fill(spark, folder)
        rows, size = features(spark, folder)
        return runs.union_results([
            base.run_rules(events, [fill_rate.fill_rate_rule(events, gq.TARGETS)], gq.BY_MONTH, decimals=None),
            base.run_rules(rows, [*rq.evidence_rules(), tr.spelling_rule(size)], rq.BY_CALL_MONTH, decimals=None),
            topics.topic_metrics(rq.topic_states(spark, folder), rq.BY_ORDER_YEAR, decimals=None),
        ])

    return _once(spark, folder, "metrics", make)


def failures(spark, folder):
    return _once(spark, folder, "failures", lambda: rq.call_failures(spark, folder, features(spark, folder)[0]))


def evidence(spark, folder):
    failing = failures(spark, folder)
    kept = ev.collect_evidence(failing, rq.BY_CALL_MONTH, "call_id", tb.SOURCE, tb.SALT)
    return ev.evidence_summary(failing, kept, rq.BY_CALL_MONTH)


def scores(spark, folder, allow_partial=True):
    table = metrics(spark, folder)
    return scoring.score_metrics(scoring.primary_metrics(table), scoring.metric_availability(table), allow_partial)


def _dim():
    return F.coalesce(*[F.try_element_at("dims", F.lit(name)) for name in ("event_type", "lang", "parity")]).alias("dim")


# ---- comparison tables --------------------------------------------------------------------------


def _metric(rule: str, name: str, source: str, dim: str, value: str, top: str, bottom: str, outcome: str) -> str:
    return (
        f"select '{rule}' as rule_id, '{name}' as metric_name, is_overall, time_period, {dim} as dim, row_count, eligible_count, passed_count, failed_count, "
        f"cast({value} as double) as value, cast({top} as double) as numerator, cast({bottom} as double) as denominator, {outcome} as outcome from {source}"
    )


FAILED_SHARE = rq.ratio("failed_count", "eligible_count")
CALL_METRICS = " union all ".join([
    _metric("agent_speaker_tag_validation", "invalid_speaker_tag_rate", "g1", "lang", FAILED_SHARE, "failed_count", "eligible_count", rq.at_most(FAILED_SHARE, 0.01)),
    _metric("speech_per_duration_rate", "speech_words_per_minute", "g2", "lang", rq.OVERALL_RATE, "words", "seconds", rq.RANGE_OUTCOME),
    _metric("pii_detection", "pii_record_rate", "g3", "lang", FAILED_SHARE, "failed_count", "eligible_count", rq.at_most(FAILED_SHARE, 0.0)),
    _metric("mistranslated_rate", "mistranslated_rate", "g4", "lang", rq.ratio(rq.LEX_HITS, "tokens"), rq.LEX_HITS, "tokens", rq.at_most(rq.ratio(rq.LEX_HITS, "tokens"), 0.02)),
    _metric("non_english_spelling", "unknown_token_rate", "g5", "lang", rq.SPELL_RATE, "unknown", "tokens", rq.at_most(rq.SPELL_RATE, 0.05)),
])
METRICS_CTE = f"""
call_metrics as (
  with {rq.FEATURES_SQL}, {rq.SPEECH_RATED_SQL}, g1 as ({rq.speaker_group_sql('feat')}), g2 as ({rq.SPEECH_GROUP_SQL}), g3 as ({rq.PII_GROUP_SQL}),
       g4 as ({rq.LEX_GROUP_SQL}), g5 as ({rq.SPELL_GROUP_SQL})
  {CALL_METRICS}),
fill_metrics as (
  select rule_id, 'fill_rate' as metric_name, is_overall, time_period, event_type as dim, row_count, eligible_count, passed_count, failed_count, value, numerator, denominator, outcome
  from ({gq.FILL_RATE_SQL})),
drift_metrics as (
  with {rq.PARTS_SQL}, {rq.topic_distribution_sql('category')}, {rq.DRIFT_SQL}
  select 'topic_distribution' as rule_id, 'jensen_shannon_divergence' as metric_name, false as is_overall, d.time_period, d.parity as dim, row_count, eligible_count,
         passed_count, failed_count, jsd as value, cast(null as double) as numerator, cast(null as double) as denominator,
         case when jsd < 0.05 then 'passed' when jsd < 0.15 then 'warning' else 'failed' end as outcome
  from drift d join g on not g.is_overall and g.parity = d.parity and g.time_period = d.time_period),
m as (select * from call_metrics union all select * from fill_metrics union all select * from drift_metrics),
population as (select rule_id, row_count as all_rows, eligible_count as eligible_rows from m where is_overall
               union all select 'topic_distribution', count(*), count(*) from orders),
avail as (select rule_id, case when eligible_rows = 0 then 'unavailable' when eligible_rows < all_rows then 'partial' else 'available' end as availability,
          eligible_rows as eligible_count, all_rows - eligible_rows as unavailable_count, coalesce(eligible_rows / nullif(cast(all_rows as double), 0), 0) as coverage from population),
usable as (select rule_id, bool_or(is_overall and outcome <> 'not_evaluated' and value is not null) as overall_usable, bool_or(not is_overall) as has_groups from m group by 1),
chosen as (select m.* from m join usable using (rule_id)
           where case when rule_id = 'topic_distribution' then not is_overall when overall_usable or not has_groups then is_overall else not is_overall end),
catalogue as (select * from (values {', '.join(f"('{rule}', {weight}::double, '{formula}', {[float(b) for b in bounds]}::double[])" for rule, _, weight, formula, bounds, _ in fixed.SCORE_CATALOGUE)})
              c(rule_id, weight, formula, b)),
"""


def scored_cte(partial: str) -> str:
    return METRICS_CTE + f"""
states as (select h.*, weight, formula, b, case when outcome = 'not_evaluated' or value is null then 'not_evaluated' when a.availability = 'partial' then '{partial}'
                  else coalesce(a.availability, 'unavailable') end as availability
           from chosen h join catalogue using (rule_id) left join avail a using (rule_id)),
raw as (select *, case when availability <> 'available' then null
          when formula = 'higher_is_better_linear' then 100.0 * (value - b[1]) / (b[2] - b[1])
          when formula = 'lower_is_better_linear' then 100.0 * (b[2] - value) / (b[2] - b[1])
          when value between b[2] and b[3] then 100.0 when value < b[2] then 100.0 * (value - b[1]) / (b[2] - b[1])
          else 100.0 * (b[4] - value) / (b[4] - b[3]) end as raw_score from states),
scored as (select *, case when raw_score is null then null else least(100.0, greatest(0.0, raw_score)) end as score from raw),
rule_scored as (
  select rule_id, any_value(weight) as weight, round(sum(score * coalesce(nullif(denominator, 0), 1)) / nullif(sum(case when score is not null then coalesce(nullif(denominator, 0), 1) end), 0), 6) as score,
         max(is_overall) as has_overall, count(score) as n,
         min(case availability when 'not_evaluated' then 0 when 'unavailable' then 1 when 'partial' then 2 else 3 end) as worst,
         cast(sum(coalesce(floor(denominator), 0)) as bigint) as records_evaluated, cast(sum(coalesce(floor(numerator), 0)) as bigint) as records_affected
  from scored group by 1)
"""


def band(score: str) -> str:
    steps = " ".join(f"when {score} >= {minimum} then '{name}'" for name, minimum in fixed.SCORE_BANDS)
    return f"case when {score} is null then 'not_evaluated' {steps} end"


# ---- scores ------------------------------------------------------------------------------------------


def metric_availability(spark, folder):
    return scoring.metric_availability(metrics(spark, folder))


AVAILABILITY_SQL = f"with {METRICS_CTE} final as (select 1) select * from avail"


def _metric_scores(allow_partial):
    def query(spark, folder):
        return scores(spark, folder, allow_partial).select(
            "rule_id", "metric_name", "is_overall", "time_period", _dim(), "outcome", "availability", "band", F.round("score", 6).alias("score"), "weight"
        )

    return query


def metric_scores_sql(partial: str) -> str:
    return f"""with {scored_cte(partial)}
select rule_id, metric_name, is_overall, time_period, dim, outcome, availability, {band('score')} as band, round(score, 6) as score, weight from scored"""


def rule_scores(spark, folder):
    return scoring.rule_scores(scores(spark, folder)).withColumn("score", F.round("score", 6))


RULE_SCORES_SQL = f"""with {scored_cte('available')}
select rule_id, weight, score, {band('score')} as band, case when n > 0 then 'available' else ['not_evaluated', 'unavailable', 'partial', 'available'][worst + 1] end as availability,
       case when has_overall then 'overall' else 'groups' end as population, records_evaluated, records_affected from rule_scored"""


def group_scores(spark, folder):
    return scoring.group_scores(scores(spark, folder)).select(
        "rule_id", "time_period", F.try_element_at("dims", F.lit("parity")).alias("parity"), F.round("score", 6).alias("score"), "band", "availability",
        "records_evaluated", "records_affected",
    )


GROUP_SCORES_SQL = f"""with {scored_cte('available')}
select rule_id, time_period, dim as parity, round(score, 6) as score, {band('score')} as band, availability, cast(0 as bigint) as records_evaluated, cast(0 as bigint) as records_affected
from scored where rule_id in (select rule_id from rule_scored where not has_overall)"""


def _aggregate(allow_partial):
    def query(spark, folder):
        made = scoring.aggregate_score(scoring.rule_scores(scores(spark, folder, allow_partial)))
        return made.withColumns({"score": F.round("score", 5), "coverage_ratio": F.round("coverage_ratio", 6)})

    return query


def aggregate_sql(partial: str) -> str:
    return f"""with {scored_cte(partial)},
a as (select round(coalesce(sum(weight) filter (where n > 0), 0), 6) as coverage_ratio, sum(weight * score) filter (where n > 0) as weighted, count(*) filter (where n > 0) as contributing_rules from rule_scored),
s as (select case when coverage_ratio >= 0.7 then round(weighted / coverage_ratio, 5) end as score, coverage_ratio, 0.7::double as minimum_coverage_ratio, contributing_rules from a)
select *, {band('score')} as band, case when score is null then 'not_evaluated' else 'available' end as availability from s"""


# Two rules of the caller's own choice, with weights and bounds of their own.
OWN_CATALOGUE = (
    ("fill_rate", "fill_rate", 0.25, "higher_is_better_linear", (0.2, 1.0), "overall_preferred"),
    ("pii_detection", "pii_record_rate", 0.75, "lower_is_better_linear", (0.0, 0.9), "overall_preferred"),
)


def reweighted_score(spark, folder):
    """The aggregate under a score catalogue of the caller's own."""
    table = metrics(spark, folder)
    scored = scoring.score_metrics(scoring.primary_metrics(table, OWN_CATALOGUE), scoring.metric_availability(table), allow_partial=True)
    made = scoring.aggregate_score(scoring.rule_scores(scored), minimum_coverage=0.5, catalogue=OWN_CATALOGUE)
    return made.withColumns({"score": F.round("score", 5), "coverage_ratio": F.round("coverage_ratio", 6)})


def reweighted_sql() -> str:
    values = ", ".join(f"('{rule}', {weight}::double, '{formula}', {[float(b) for b in bounds]}::double[])" for rule, _, weight, formula, bounds, _ in OWN_CATALOGUE)
    shipped = ", ".join(f"('{rule}', {weight}::double, '{formula}', {[float(b) for b in bounds]}::double[])" for rule, _, weight, formula, bounds, _ in fixed.SCORE_CATALOGUE)
    return aggregate_sql("available").replace(shipped, values).replace(">= 0.7 then", ">= 0.5 then").replace("0.7::double as minimum", "0.5::double as minimum")


def unscored_rules(spark, folder):
    return scoring.unscored_rules(scoring.rule_scores(scores(spark, folder, allow_partial=False)))


UNSCORED_SQL = f"with {scored_cte('partial')} select rule_id from catalogue where rule_id not in (select rule_id from rule_scored where n > 0)"


def assessment_confidence(spark, folder):
    by_rule = scoring.rule_scores(scores(spark, folder))
    completed = runs.rule_statuses(metrics(spark, folder), list(fixed.REPORTING_NAMES)).where("status = 'completed'")
    made = scoring.assessment_confidence(by_rule, completed, evidence(spark, folder), provenance_matches=True)
    return made.select(*[F.round(name, 6).alias(name) for name in made.columns])


CONFIDENCE_SQL = f"""with {scored_cte('available')},
e as ({rq.EVIDENCE_TOTALS_SQL}),
f as (select 1.0::double as rule_coverage, (select sum(weight) filter (where n > 0) / sum(weight) from rule_scored) as metric_coverage,
             (select greatest(0.0, least(1.0, count(*) / 3.0::double) - case when bool_or(truncated) then 0.1 else 0.0 end) from e) as evidence_coverage, 1.0::double as source_provenance)
select rule_coverage, round(metric_coverage, 6) as metric_coverage, cast(round(evidence_coverage, 6) as double) as evidence_coverage, source_provenance, 0.85::double as factor_weight,
       cast(round((0.3 * rule_coverage + 0.25 * metric_coverage + 0.15 * evidence_coverage + 0.15 * source_provenance) / 0.85, 4) as double) as confidence from f"""


def score_ramps(spark, folder):
    """The three ramps and the bands over every order's price."""
    value = F.round(F.col("o_totalprice") / 1000)
    bounds = [F.lit(float(b)) for b in (50, 150, 300, 450)]
    rising = ramps.higher_is_better_linear(value, bounds[0], bounds[2])
    return tb.load(spark, folder, "orders").select(
        "o_orderkey", F.round(rising, 6).alias("rising"), F.round(ramps.lower_is_better_linear(value, bounds[1], bounds[3]), 6).alias("falling"),
        F.round(ramps.inside_range_linear(value, *bounds), 6).alias("inside"), ramps.score_band(rising).alias("band"),
    )


RAMPS_SQL = f"""
with t as (select o_orderkey, round(o_totalprice / 1000) as v from orders),
r as (select *, least(100.0, greatest(0.0, 100.0 * (v - 50) / 250)) as up, least(100.0, greatest(0.0, 100.0 * (450 - v) / 300)) as down,
      case when v < 50 or v > 450 then 0.0 when v between 150 and 300 then 100.0 when v < 150 then 100.0 * (v - 50) / 100 else 100.0 * (450 - v) / 150 end as mid from t)
select o_orderkey, round(up, 6) as rising, round(down, 6) as falling, round(cast(mid as double), 6) as inside, {band('up')} as band from r"""

# ---- patterns, impact, facts ------------------------------------------------------------------------------


def cooccurring_failures(spark, folder):
    found = patterns.cooccurring_failures(evidence(spark, folder), DIMS)
    return found.select("pattern_id", "scope_id", F.array_join("rule_ids", ",").alias("rule_ids"), "observed_failures")


def repeated_failures(spark, folder):
    found = patterns.repeated_failures(evidence(spark, folder), DIMS)
    return found.select("pattern_id", "scope_id", F.array_join("rule_ids", ",").alias("rule_ids"), F.array_join("time_periods", ",").alias("time_periods"), "observed_failures")


def scope_sql(with_time: bool) -> str:
    time = """|| case when time_period is null then '' else ',"time_period":"' || time_period || '"' end""" if with_time else ""
    return f"""'scope-' || substr(sha256('{{"dimensions":{{' || case when lang is null then '' else '"lang":"' || lang || '"' end || '}},"overall":' || is_overall {time} || '}}'), 1, 24)"""


PATTERNS_CTE = f"""e as ({rq.EVIDENCE_TOTALS_SQL}),
c0 as (select {scope_sql(True)} as scope_id, rule_id, sum(observed_count) as n from e group by 1, 2),
c1 as (select scope_id, string_agg(rule_id, '|' order by rule_id) as rules, cast(sum(n) as bigint) as observed_failures, count(*) as k from c0 group by 1),
cooc as (select 'corr-' || substr(sha256('aggregate_cooccurrence|' || scope_id || '|' || rules), 1, 24) as pattern_id, 'aggregate_cooccurrence' as pattern_type, scope_id,
         replace(rules, '|', ',') as rule_ids, '' as time_periods, observed_failures from c1 where k >= 2),
r0 as (select {scope_sql(False)} as scope_id, rule_id, time_period, observed_count from e where time_period is not null),
r1 as (select scope_id, rule_id, string_agg(distinct time_period, '|' order by time_period) as periods, count(distinct time_period) as k, cast(sum(observed_count) as bigint) as observed_failures from r0 group by 1, 2),
rep as (select 'corr-' || substr(sha256('repeated_period_pattern|' || scope_id || '|' || rule_id || '|' || periods), 1, 24) as pattern_id, 'repeated_period_pattern' as pattern_type, scope_id,
        rule_id as rule_ids, replace(periods, '|', ',') as time_periods, observed_failures from r1 where k >= 2),
pat as (select * from cooc union all select * from rep)
"""


def failure_patterns(spark, folder):
    found = patterns.failure_patterns(evidence(spark, folder), DIMS)
    return found.select("pattern_id", "pattern_type", F.array_join("rule_ids", ",").alias("rule_ids"), "observed_failures")


def root_cause_candidates(spark, folder):
    return patterns.root_cause_candidates(patterns.failure_patterns(evidence(spark, folder), DIMS))


ROOT_CAUSES_SQL = f"""with {PATTERNS_CTE}
select 'root-cause-' || substr(sha256(pattern_id), 1, 24) as candidate_id, pattern_id,
       case when pattern_type = 'repeated_period_pattern' then 'repeated_technical_pattern' else 'aggregate_technical_cooccurrence' end as category,
       true as requires_review, false as causal_claim from pat order by pattern_id limit 10"""


def impact_hypotheses(spark, folder):
    return patterns.impact_hypotheses(scores(spark, folder)).select(
        "condition_id", "impact_dimension", "classification", "rule_id", "metric_name", "is_overall", "time_period", _dim(), "outcome", "review"
    )


CONDITIONS_SQL = "conditions as (select * from (values " + ", ".join(
    f"('{name}', '{rule}', '{metric}', {list(outcomes)}::varchar[], {list(dimensions)}::varchar[], '{kind}', {str(review).lower()})"
    for name, rule, metric, outcomes, dimensions, kind, review in fixed.IMPACT_CONDITIONS
) + ") c(condition_id, rule_id, metric_name, outcomes, dims, classification, review))"
MATCHED_CTE = f"""{scored_cte('available')}, {CONDITIONS_SQL},
matched as (select s.rule_id, s.metric_name, is_overall, time_period, dim, outcome, condition_id, dims, classification, review
            from scored s join conditions c on s.rule_id = c.rule_id and s.metric_name = c.metric_name and list_contains(outcomes, outcome))"""
IMPACT_SQL = f"""with {MATCHED_CTE}
select condition_id, unnest(dims) as impact_dimension, classification, rule_id, metric_name, is_overall, time_period, dim, outcome,
       case when review then 'required' else 'not_required' end as review from matched"""


def recommendations(spark, folder):
    return patterns.recommendations(scores(spark, folder)).select(
        "catalogue_id", "condition_id", "rule_id", "is_overall", "time_period", _dim(), "title", "priority", "review"
    )


RECOMMENDATIONS_SQL = f"""with {MATCHED_CTE},
rec as (select * from (values {', '.join(f"('{name}', '{condition}', '{priority}', {str(review).lower()}, '{title}')" for name, condition, priority, review, title in fixed.RECOMMENDATIONS)})
        r(catalogue_id, condition_id, priority, needs_review, title))
select catalogue_id, condition_id, rule_id, is_overall, time_period, dim, title, priority, case when needs_review then 'required' else 'not_required' end as review
from matched join rec using (condition_id)"""


def _facts(spark, folder):
    """As many facts as are kept unless told otherwise, and how many were left out."""
    return patterns.fact_table(scoring.primary_metrics(metrics(spark, folder)), evidence(spark, folder), DIMS)


def facts(spark, folder):
    return _facts(spark, folder)[0].withColumn("value", F.round("value", 6))


def dropped_facts(spark, folder):
    return _facts(spark, folder)[1]


DIMS_JSON = """case when is_overall then '{}' else '{"' || case rule_id when 'fill_rate' then 'event_type' when 'topic_distribution' then 'parity' else 'lang' end || '":"' || dim || '"}' end"""
FACTS_CTE = f"""{METRICS_CTE} e as ({rq.EVIDENCE_TOTALS_SQL}),
facts as (select 'fact-' || substr(sha256('metric|' || rule_id || '|' || metric_name || '|' || coalesce(time_period, '') || '|' || {DIMS_JSON}), 1, 24) as fact_id,
                 'execution_metric' as kind, rule_id, metric_name, round(value, 6) as value, time_period from chosen
          union all
          select 'fact-' || substr(sha256('evidence|' || rule_id || '|' || {scope_sql(True)}), 1, 24), 'execution_evidence_summary', rule_id, 'observed_failure_count', cast(observed_count as double), time_period from e)
"""

FACTS_SQL = f"with {FACTS_CTE} select * from facts order by fact_id limit {fixed.FACTS_KEPT}"
DROPPED_FACTS_SQL = f"with {FACTS_CTE} select greatest(0, count(*) - {fixed.FACTS_KEPT}) as dropped_facts from facts"

# ---- run summaries --------------------------------------------------------------------------------------------


def check_summary(spark, folder):
    return runs.check_summary(metrics(spark, folder)).withColumn("value", F.round("value", 6))


CHECK_SUMMARY_SQL = f"""with {METRICS_CTE}
share as (with {rq.PARTS_SQL}, {rq.topic_distribution_sql('category')} select *, {rq.TOPIC_OUTCOME} as outcome from g),
every as (select rule_id, metric_name, is_overall, row_count, eligible_count, passed_count, failed_count, value, outcome from m where rule_id <> 'topic_distribution'
          union all select 'topic_distribution', 'dominant_topic_share', is_overall, row_count, eligible_count, passed_count, failed_count, dominant / cast(eligible_count as double), outcome from share)
select a.rule_id, case a.rule_id {' '.join(f"when '{k}' then '{v}'" for k, v in fixed.REPORTING_NAMES.items())} end as reporting_name, metric_name, round(value, 6) as value, outcome,
       row_count, eligible_count, passed_count, failed_count, row_count - eligible_count as skipped_count,
       (select count(*) from every b where b.rule_id = a.rule_id and not b.is_overall) as grouped_result_count
from every a where is_overall"""


def run_summary(spark, folder):
    read = tb.calls(spark, folder)
    kept = apply_filters(read, [Filter("lang", "not_in", ["xx"]), Filter("transcript", "is_not_null")])
    table = metrics(spark, folder)
    statuses = runs.rule_statuses(table, [*fixed.REPORTING_NAMES, "unknown_rule"])
    return runs.run_summary(read, kept, table, statuses, evidence(spark, folder))


RUN_SUMMARY_SQL = f"""with {METRICS_CTE} e as ({rq.EVIDENCE_TOTALS_SQL}), c as ({tb.CALLS_SQL}),
topic_groups as (select distinct strftime(o_orderdate, '%Y') as time_period, 'parity' || (o_custkey % 2) as dim from orders)
select (select count(*) from c) as rows_read, (select count(*) from c where transcript is not null) as rows_after_filters,
       (select count(*) from (select distinct time_period, dim from call_metrics where not is_overall
                              union all select distinct time_period, dim from fill_metrics where not is_overall union all select * from topic_groups)) as groups_created,
       cast(8 as bigint) as rules_requested, cast(7 as bigint) as rules_executed, cast(7 as bigint) as rules_completed, cast(1 as bigint) as rules_skipped, cast(0 as bigint) as rules_failed,
       (select cast(sum(observed_count) as bigint) from e) as evidence_observed, (select cast(sum(retained_count) as bigint) from e) as evidence_retained"""


def run_status(spark, folder):
    table = metrics(spark, folder)
    whole = runs.run_status(runs.rule_statuses(table, list(fixed.REPORTING_NAMES))).select(F.lit("all_rules").alias("run"), "status")
    lacking = runs.run_status(runs.rule_statuses(table, ["fill_rate", "unknown_rule"])).select(F.lit("one_skipped").alias("run"), "status")
    return whole.unionByName(lacking)


RUN_STATUS_SQL = f"""with {METRICS_CTE} n as (select count(distinct rule_id) as c from m)
select 'all_rules' as run, case when c = 7 then 'completed' else 'completed_with_warnings' end as status from n union all select 'one_skipped', 'completed_with_warnings'"""

QUERIES = {
    "metric_availability": metric_availability,
    "metric_scores": _metric_scores(True),
    "metric_scores_without_partial": _metric_scores(False),
    "rule_scores": rule_scores,
    "group_scores": group_scores,
    "aggregate_score": _aggregate(True),
    "aggregate_score_below_coverage": _aggregate(False),
    "reweighted_score": reweighted_score,
    "unscored_rules": unscored_rules,
    "assessment_confidence": assessment_confidence,
    "score_ramps": score_ramps,
    "cooccurring_failures": cooccurring_failures,
    "repeated_failures": repeated_failures,
    "failure_patterns": failure_patterns,
    "root_cause_candidates": root_cause_candidates,
    "impact_hypotheses": impact_hypotheses,
    "recommendations": recommendations,
    "fact_table": facts,
    "dropped_facts": dropped_facts,
    "default_fact_table": facts,
    "default_dropped_facts": dropped_facts,
    "check_summary": check_summary,
    "run_summary": run_summary,
    "run_status": run_status,
}
ORACLES = {
    "metric_availability": AVAILABILITY_SQL,
    "metric_scores": metric_scores_sql("available"),
    "metric_scores_without_partial": metric_scores_sql("partial"),
    "rule_scores": RULE_SCORES_SQL,
    "group_scores": GROUP_SCORES_SQL,
    "aggregate_score": aggregate_sql("available"),
    "aggregate_score_below_coverage": aggregate_sql("partial"),
    "reweighted_score": reweighted_sql(),
    "unscored_rules": UNSCORED_SQL,
    "assessment_confidence": CONFIDENCE_SQL,
    "score_ramps": RAMPS_SQL,
    "cooccurring_failures": f"with {PATTERNS_CTE} select pattern_id, scope_id, rule_ids, observed_failures from cooc",
    "repeated_failures": f"with {PATTERNS_CTE} select pattern_id, scope_id, rule_ids, time_periods, observed_failures from rep",
    "failure_patterns": f"with {PATTERNS_CTE} select pattern_id, pattern_type, rule_ids, observed_failures from pat",
    "root_cause_candidates": ROOT_CAUSES_SQL,
    "impact_hypotheses": IMPACT_SQL,
    "recommendations": RECOMMENDATIONS_SQL,
    "fact_table": FACTS_SQL,
    "dropped_facts": DROPPED_FACTS_SQL,
    "default_fact_table": FACTS_SQL,
    "default_dropped_facts": DROPPED_FACTS_SQL,
    "check_summary": CHECK_SUMMARY_SQL,
    "run_summary": RUN_SUMMARY_SQL,
    "run_status": RUN_STATUS_SQL,
}
