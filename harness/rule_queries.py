"""Queries over the seven rules, drift, evidence, samples and incremental results."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import grouping_queries as gq
from harness import tables as tb
from harness import text_queries as tq
from parlance import fixed_values as fixed
from parlance.functions import text as tx
from parlance.operators import evidence as ev
from parlance.operators import grouping as grp
from parlance.operators import binding, runs, vocabulary
from parlance.operators.features import text_features
from parlance.operators.grouping import Grouping
from parlance.operators.rules import base, fill_rate, topics
from parlance.operators.rules import transcript_rules as tr
from parlance.plans import assessment
from parlance.sources.storage import materialize, new_path
from parlance.streaming import incremental

BY_CALL_MONTH = Grouping("call_day", "month", {"lang": "lang"})
BY_ORDER_YEAR = Grouping("o_orderdate", "year", {"parity": "parity"})
INEXACT = ("jensen_shannon_divergence", "population_stability_index", "maximum_cohen_h")
COUNTS = ("row_count", "eligible_count", "passed_count", "failed_count", "skipped_count")


def flat(metrics, dims):
    """The metric table with one scalar value per row."""
    named = [F.try_element_at("dims", F.lit(name)).alias(name) for name in dims]
    each = metrics.select(
        "rule_id", "is_overall", "time_period", *named, *COUNTS, "metric_name", "outcome", "value",
        F.explode_outer("value_map").alias("category", "category_value"),
    ).where(F.col("value").isNotNull() | F.col("category_value").isNotNull())
    value = F.coalesce("value", "category_value")
    rounded = F.when(F.col("metric_name").isin(*INEXACT) | F.col("category").isin("average"), F.round(value, 6)).otherwise(value)
    return each.withColumn("value", rounded).drop("category_value")


def rows_sql(rule: str, source: str, keys: str, metrics: list[tuple]) -> str:
    """Flat metric rows from a table of counters; metrics are (name, category, value, outcome, condition)."""
    selects = []
    for name, category, value, outcome, condition in metrics:
        label = "null" if category is None else f"'{category}'"
        where = f"({value}) is not null" + (f" and {condition}" if condition else "")
        selects.append(
            f"select '{rule}' as rule_id, is_overall, {keys}, row_count, eligible_count, passed_count, failed_count, "
            f"row_count - eligible_count as skipped_count, '{name}' as metric_name, cast({outcome} as varchar) as outcome, "
            f"cast({value} as double) as value, cast({label} as varchar) as category from {source} where {where}"
        )
    return " union all ".join(selects)


def ratio(top: str, bottom: str) -> str:
    return f"(cast({top} as double) / nullif({bottom}, 0))"


def at_most(value: str, limit: float) -> str:
    return f"case when {value} is null then 'not_evaluated' when {value} <= {limit} then 'passed' else 'failed' end"


NOT = "'not_evaluated'"
KEYS = "time_period, lang"


def grouped_sql(rule_source: str, eligible: str, passed: str, sums: dict[str, str], extra: str = "") -> str:
    listed = "".join(f", cast(coalesce(sum(case when {eligible} then {value} else 0 end), 0) as bigint) as {name}" for name, value in sums.items())
    return f"""
select grouping(time_period) = 1 as is_overall, time_period, lang, count(*) as row_count,
       count(*) filter (where {eligible}) as eligible_count, count(*) filter (where {eligible} and {passed}) as passed_count,
       count(*) filter (where {eligible} and not ({passed})) as failed_count {listed} {extra}
from {rule_source} group by grouping sets ((), (time_period, lang))
"""


FEATURES_SQL = f"""
{tq.CALLS}, {tq.WORDS_SQL},
tokenised as (select call_id, coalesce(lang, '__UNKNOWN__') as lang, strftime(call_day, '%Y-%m') as time_period, transcript, text_present, duration_ms,
              case when text_present then {tq.tokens_sql('transcript')} else [] end as tokens from spoken),
turns as ({tq.speaker_sql('spoken', 'call_id')}),
known as (select call_id, count(*) filter (where word is null) as unknown_words
          from (select call_id, unnest(tokens) as token from tokenised) left join words on token = word group by 1),
feat as (
  select t.call_id, t.lang, t.time_period, t.text_present, t.duration_ms, cast(len(t.tokens) as bigint) as token_count,
         s.total_turns, s.agent_turns, s.customer_turns, s.empty_turns, coalesce(k.unknown_words, 0) as unknown_words,
         {', '.join(f"case when t.text_present then {tq.pii_sql(name, 't.transcript')} else 0 end as pii_{name}" for name in tq.PII_COUNTS_SQL)},
         {', '.join(f"case when t.text_present then {tq.lexicon_category_sql(name, 't.transcript')} else 0 end as lexicon_{name}" for name in tb.LEXICON)},
         case when t.text_present then length(regexp_replace(t.transcript, '[^\\pL]', '', 'g')) else 0 end as letter_count,
         case when t.text_present then length(regexp_replace(t.transcript, '[^\\pL]|[A-Za-z]', '', 'g')) else 0 end as non_ascii
  from tokenised t join turns s using (call_id) left join known k using (call_id))
"""


def call_rows(spark, folder):
    """Call features with unknown-word counts, and the vocabulary size."""
    words = tq.english_words(spark, folder)
    size = vocabulary.vocabulary_size(words)
    featured = tq.calls_features(spark, folder, with_tokens=True).drop("transcript")
    return vocabulary.with_unknown_words(featured, "tokens", words, size), size


def run_flat(df, rules, grouping=BY_CALL_MONTH):
    return flat(base.run_rules(df, rules, grouping, decimals=None), list(grouping.dimensions))


# ---- speaker tags -----------------------------------------------------------------


def speaker_tags(spark, folder):
    return run_flat(tq.calls_features(spark, folder), [tr.speaker_tag_rule()])


SPEAKER_VALID = "(total_turns > 0 and agent_turns > 0 and customer_turns > 0 and empty_turns = 0)"
SPEAKER_METRICS = [
    ("invalid_speaker_tag_rate", None, ratio("failed_count", "eligible_count"), at_most(ratio("failed_count", "eligible_count"), 0.01), None),
    *[
        ("speaker_tag_summary", name, value, at_most(ratio("failed_count", "eligible_count"), 0.01), None)
        for name, value in {
            "rows_evaluated": "eligible_count", "rows_with_mismatch": "failed_count", "rows_matching": "passed_count",
            "mismatch_rate": ratio("failed_count", "eligible_count"), "total_utterances": "turns", "mismatched_utterances": "mismatched",
        }.items()
    ],
    *[
        ("speaker_failure_categories", name, name, NOT, f"{name} > 0")
        for name in ("no_speaker_tags", "required_role_missing", "empty_turn")
    ],
    ("average_speaker_turns", None, ratio("turns", "eligible_count"), NOT, None),
]


def speaker_group_sql(source: str) -> str:
    return grouped_sql(source, "text_present", SPEAKER_VALID, {
        "turns": "total_turns", "mismatched": "empty_turns", "no_speaker_tags": "(total_turns = 0)::int",
        "required_role_missing": "(agent_turns = 0 or customer_turns = 0)::int", "empty_turn": "(empty_turns > 0)::int",
    })


SPEAKER_TAGS_SQL = (
    f"with {FEATURES_SQL}, g as ({speaker_group_sql('feat')}) " + rows_sql("agent_speaker_tag_validation", "g", KEYS, SPEAKER_METRICS)
)


def exchange_speaker_tags(spark, folder):
    featured = text_features(tb.exchanges(spark, folder), "transcript").withColumn("lang", F.pmod("turn", F.lit(2)).cast("string"))
    return run_flat(featured, [tr.speaker_tag_rule()], Grouping(dimensions={"lang": "lang"}, grain="none"))


EXCHANGE_TAGS_SQL = (
    f"with ex as (select *, true as text_present from ({tb.EXCHANGES_SQL})), s as ({tq.speaker_sql('ex', 'conv_id, turn')}), "
    "feat as (select *, cast(turn % 2 as varchar) as lang, null::varchar as time_period from s), "
    f"g as ({speaker_group_sql('feat').replace('grouping(time_period)', 'grouping(lang)')}) "
    + rows_sql("agent_speaker_tag_validation", "g", KEYS, SPEAKER_METRICS)
)


# ---- speech rate ------------------------------------------------------------------


def speech_rate(spark, folder):
    return run_flat(tq.calls_features(spark, folder), [tr.speech_rate_rule("duration_ms")])


RATE = "(token_count / (duration_ms / 1000.0 / 60.0))"
SPEECH_ELIGIBLE = "(text_present and duration_ms >= 1000 and token_count > 0)"
OVERALL_RATE = "(words / nullif(seconds / 60.0, 0))"
RANGE_OUTCOME = (
    f"case when {OVERALL_RATE} is null then 'not_evaluated' when {OVERALL_RATE} between 40 and 250 then 'passed' "
    f"when {OVERALL_RATE} between 30 and 300 then 'warning' else 'failed' end"
)
SPEECH_GROUP_SQL = grouped_sql(
    "rated", SPEECH_ELIGIBLE, "status = 'pass'",
    {"words": "token_count", **{f"n_{name}": f"(status = '{name}')::int" for name in ("pass", "warn", "fail")}},
    f", coalesce(sum(duration_ms / 1000.0) filter (where {SPEECH_ELIGIBLE}), 0) as seconds, avg(rate) as rate_avg, min(rate) as rate_min, max(rate) as rate_max",
)
SPEECH_RATED_SQL = (
    f"rated as (select *, case when rate between 40 and 250 then 'pass' when rate between 30 and 300 then 'warn' when rate is not null then 'fail' end as status "
    f"from (select *, case when {SPEECH_ELIGIBLE} then {RATE} end as rate from feat))"
)
SPEECH_METRICS = [
    ("speech_words_per_minute", None, OVERALL_RATE, RANGE_OUTCOME, None),
    ("row_words_per_minute_summary", "average", "round(rate_avg, 6)", NOT, None),
    ("row_words_per_minute_summary", "minimum", "rate_min", NOT, None),
    ("row_words_per_minute_summary", "maximum", "rate_max", NOT, None),
    *[("speech_rate_status_counts", name, f"n_{name}", NOT, f"n_{name} > 0") for name in ("pass", "warn", "fail")],
]
SPEECH_SQL = f"with {FEATURES_SQL}, {SPEECH_RATED_SQL}, g as ({SPEECH_GROUP_SQL}) " + rows_sql("speech_per_duration_rate", "g", KEYS, SPEECH_METRICS)


# ---- personal data, lexicon, spelling ---------------------------------------------------


def personal_data(spark, folder):
    return run_flat(tq.calls_features(spark, folder), [tr.pii_rule()])


PII_NAMES = list(tq.PII_COUNTS_SQL)
PII_TOTAL = "(" + " + ".join(f"pii_{name}" for name in PII_NAMES) + ")"
PII_GROUP_SQL = grouped_sql("feat", "text_present", f"{PII_TOTAL} = 0", {f"n_{name}": f"pii_{name}" for name in PII_NAMES})
PII_METRICS = [
    ("pii_record_rate", None, ratio("failed_count", "eligible_count"), at_most(ratio("failed_count", "eligible_count"), 0.0), None),
    ("pii_occurrence_count", None, " + ".join(f"n_{name}" for name in PII_NAMES), NOT, None),
    *[("pii_category_counts", name, f"n_{name}", NOT, f"n_{name} > 0") for name in PII_NAMES],
]
PII_SQL = f"with {FEATURES_SQL}, g as ({PII_GROUP_SQL}) " + rows_sql("pii_detection", "g", KEYS, PII_METRICS)


def mistranscriptions(spark, folder):
    return run_flat(tq.calls_features(spark, folder), [tr.lexicon_rule(tb.LEXICON)])


LEX_TOTAL = "(" + " + ".join(f"lexicon_{name}" for name in tb.LEXICON) + ")"
LEX_GROUP_SQL = grouped_sql(
    "feat", "(text_present and token_count > 0)", f"{LEX_TOTAL} = 0",
    {"tokens": "token_count", **{f"n_{name}": f"lexicon_{name}" for name in tb.LEXICON}},
)
LEX_HITS = "(" + " + ".join(f"n_{name}" for name in tb.LEXICON) + ")"
LEX_METRICS = [
    ("mistranslated_rate", None, ratio(LEX_HITS, "tokens"), at_most(ratio(LEX_HITS, "tokens"), 0.02), None),
    *[("mistranslation_category_counts", name, f"n_{name}", NOT, f"n_{name} > 0") for name in tb.LEXICON],
]
LEX_SQL = f"with {FEATURES_SQL}, g as ({LEX_GROUP_SQL}) " + rows_sql("mistranslated_rate", "g", KEYS, LEX_METRICS)


def spelling(spark, folder):
    rows, size = call_rows(spark, folder)
    return run_flat(rows, [tr.spelling_rule(size)])


SPELL_ELIGIBLE = "(text_present and token_count > 0 and (select count(*) from words) >= 500)"
SPELL_GROUP_SQL = grouped_sql(
    "feat", SPELL_ELIGIBLE, "unknown_words / cast(token_count as double) <= 0.05", {"tokens": "token_count", "unknown": "unknown_words"},
    ", cast(sum(letter_count) as bigint) as letters, cast(sum(non_ascii) as bigint) as foreign_letters",
)
SPELL_RATE = "(case when tokens >= 20 then cast(unknown as double) / tokens end)"
SPELL_METRICS = [
    ("unknown_token_rate", None, SPELL_RATE, at_most(SPELL_RATE, 0.05), None),
    ("non_ascii_alphabetic_rate", None, ratio("foreign_letters", "letters"), NOT, None),
]
SPELL_SQL = f"with {FEATURES_SQL}, g as ({SPELL_GROUP_SQL}) " + rows_sql("non_english_spelling", "g", KEYS, SPELL_METRICS)


def transcript_rules(spark, folder):
    """All rules over call features in one aggregation."""
    rules = [tr.speaker_tag_rule(), tr.speech_rate_rule("duration_ms"), tr.pii_rule(), tr.lexicon_rule(tb.LEXICON)]
    return run_flat(tq.calls_features(spark, folder), rules)


TRANSCRIPT_RULES_SQL = (
    f"with {FEATURES_SQL}, {SPEECH_RATED_SQL}, g1 as ({speaker_group_sql('feat')}), g2 as ({SPEECH_GROUP_SQL}), "
    f"g3 as ({PII_GROUP_SQL}), g4 as ({LEX_GROUP_SQL}) "
    + " union all ".join([
        rows_sql("agent_speaker_tag_validation", "g1", KEYS, SPEAKER_METRICS),
        rows_sql("speech_per_duration_rate", "g2", KEYS, SPEECH_METRICS),
        rows_sql("pii_detection", "g3", KEYS, PII_METRICS),
        rows_sql("mistranslated_rate", "g4", KEYS, LEX_METRICS),
    ])
)


# ---- topics ------------------------------------------------------------------------------


def topic_states(spark, folder, **options):
    rows = tb.order_topics(spark, folder)
    return topics.topic_states(rows, "topic", BY_ORDER_YEAR, **{"ontology": tb.TOPIC_ONTOLOGY, **options})


def topic_categories(spark, folder):
    """Every part of every topic cell and the category it maps to."""
    rows = tb.order_topics(spark, folder).select(F.explode(tx.split_topics(F.col("topic"))).alias("part"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("occurrences")).select(
        "part", tx.topic_category(F.col("part"), tb.TOPIC_ONTOLOGY).alias("category"), "occurrences"
    )


CATEGORY_SQL = (
    "case " + " ".join(
        f"when regexp_matches(part, '(?i){'|'.join(patterns)}') then '{name}'" for _, name, patterns in tb.TOPIC_ONTOLOGY
    ) + " else 'Other' end"
)
PARTS_SQL = f"""
fx as ({tb.sql(tb.ORDER_TOPICS, "orders")}),
parts as (select o_orderkey, parity, strftime(o_orderdate, '%Y') as time_period, trim(unnest(regexp_split_to_array(topic, '[|;,>]'))) as part from fx),
mapped as (select *, {CATEGORY_SQL} as category from parts where part <> '')
"""
TOPIC_CATEGORIES_SQL = f"with {PARTS_SQL} select part, category, count(*) as occurrences from mapped group by 1, 2"


def topic_distribution(spark, folder):
    return flat(topics.topic_metrics(topic_states(spark, folder), BY_ORDER_YEAR, decimals=None), ["parity"])


def topic_distribution_sql(category: str, cap: int | None = None) -> str:
    source = f"""
counts as (select grouping(time_period) = 1 as is_overall, time_period, parity, {category} as category, count(*) as n from mapped
           group by grouping sets (({category}), (time_period, parity, {category}))),
ranked as (select *, row_number() over (partition by is_overall, time_period, parity order by n desc, category) as p from counts),
kept as (select is_overall, time_period, parity, case when p <= {cap or 1000000} then category else '__OTHER__' end as category, sum(n) as n, min(p) as p
         from ranked group by 1, 2, 3, 4),
rows_of as (select grouping(time_period) = 1 as is_overall, time_period, parity, count(*) as row_count from
            (select strftime(o_orderdate, '%Y') as time_period, parity from fx) group by grouping sets ((), (time_period, parity))),
tops as (select is_overall, time_period, parity, max(n) as dominant, count(*) as distinct_topics from ranked group by 1, 2, 3),
g as (select r.*, r.row_count as eligible_count, cast(0 as bigint) as passed_count, cast(0 as bigint) as failed_count, t.dominant, t.distinct_topics
      from rows_of r join tops t on r.is_overall = t.is_overall and r.time_period is not distinct from t.time_period and r.parity is not distinct from t.parity)
"""
    return source


TOPIC_OUTCOME = "case when dominant / cast(eligible_count as double) <= 0.8 and distinct_topics >= 2 then 'passed' else 'failed' end"
TOPIC_ROWS_SQL = rows_sql("topic_distribution", "g", "time_period, parity", [
    ("dominant_topic_share", None, "dominant / cast(eligible_count as double)", TOPIC_OUTCOME, None),
    ("distinct_topic_count_lower_bound", None, "distinct_topics", TOPIC_OUTCOME, None),
])
DISTRIBUTION_ROWS_SQL = """
select 'topic_distribution' as rule_id, g.is_overall, g.time_period, g.parity, row_count, eligible_count, passed_count, failed_count,
       cast(0 as bigint) as skipped_count, 'topic_distribution' as metric_name, 'not_evaluated' as outcome, cast(n as double) as value, category
from kept k join g on k.is_overall = g.is_overall and k.time_period is not distinct from g.time_period and k.parity is not distinct from g.parity
"""
DRIFT_SQL = """
periods as (select parity, time_period, lag(time_period) over (partition by parity order by time_period) as previous_period
            from g where not is_overall),
pairs as (select p.parity, p.time_period, p.previous_period, c.category from periods p
          join (select distinct parity, time_period, category from kept where not is_overall) c
            on c.parity = p.parity and c.time_period in (p.time_period, p.previous_period)
          where p.previous_period is not null group by all),
joined as (select x.*, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after from pairs x
           left join kept a on not a.is_overall and a.parity = x.parity and a.time_period = x.previous_period and a.category = x.category
           left join kept b on not b.is_overall and b.parity = x.parity and b.time_period = x.time_period and b.category = x.category),
smoothed as (select *, (before + 1e-8) / (greatest(sum(before) over w, 1) + 1e-8 * count(*) over w) as p,
                       (after + 1e-8) / (greatest(sum(after) over w, 1) + 1e-8 * count(*) over w) as q
             from joined window w as (partition by parity, time_period)),
drift as (select parity, time_period, previous_period, 0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))) as jsd,
                 sum((q - p) * ln(q / p)) as psi, max(abs(2 * asin(sqrt(q)) - 2 * asin(sqrt(p)))) as cohen
          from smoothed group by 1, 2, 3)
"""
DRIFT_ROWS_SQL = " union all ".join(
    f"""select 'topic_distribution', false, d.time_period, d.parity, row_count, eligible_count, passed_count, failed_count, cast(0 as bigint),
               '{name}', {outcome}, round({column}, 6), null
        from drift d join g on not g.is_overall and g.parity = d.parity and g.time_period = d.time_period"""
    for name, column, outcome in (
        ("jensen_shannon_divergence", "jsd", "case when jsd < 0.05 then 'passed' when jsd < 0.15 then 'warning' else 'failed' end"),
        ("population_stability_index", "psi", NOT),
        ("maximum_cohen_h", "cohen", NOT),
    )
)
TOPIC_SQL = (
    f"with {PARTS_SQL}, {topic_distribution_sql('category')}, {DRIFT_SQL} "
    + " union all ".join([TOPIC_ROWS_SQL, DISTRIBUTION_ROWS_SQL, DRIFT_ROWS_SQL])
)


def raw_topic_distribution(spark, folder):
    """No ontology and room for five categories: the tail becomes one overflow category."""
    states = topic_states(spark, folder, ontology=(), limit=5)
    return flat(topics.topic_metrics(states, BY_ORDER_YEAR, decimals=None), ["parity"]).where(~F.col("metric_name").isin(*INEXACT))


RAW_TOPIC_SQL = (
    f"with {PARTS_SQL}, {topic_distribution_sql('part', 5)} " + " union all ".join([TOPIC_ROWS_SQL, DISTRIBUTION_ROWS_SQL])
)


BY_SHIP_YEAR = Grouping("l_shipdate", "year")


def topic_drift_of_many_categories(spark, folder):
    """Part keys as topics: far more categories in a year than a result map keeps."""
    lines = tb.load(spark, folder, "lineitem").select("l_shipdate", F.col("l_partkey").cast("string").alias("topic"))
    tables = topics.topic_states(lines, "topic", BY_SHIP_YEAR)
    drifted = topics.topic_drift(tables, BY_SHIP_YEAR)
    return drifted.select(
        "time_period", "previous_period", F.col("distinct_lower_bound").alias("distinct_topics"),
        *[F.round(name, 6).alias(name) for name in INEXACT])


MANY_CATEGORIES_SQL = """
with counts as (select strftime(l_shipdate, '%Y') as time_period, l_partkey as category, count(*) as n from lineitem group by 1, 2),
periods as (select time_period, lag(time_period) over (order by time_period) as previous_period, distinct_topics
            from (select time_period, count(*) as distinct_topics from counts group by 1)),
met as (select p.time_period, c.category, cast(sum(case when c.time_period = p.previous_period then n else 0 end) as double) as before,
               cast(sum(case when c.time_period = p.time_period then n else 0 end) as double) as after
        from periods p join counts c on c.time_period in (p.time_period, p.previous_period) where previous_period is not null group by 1, 2),
smoothed as (select time_period, (before + 1e-8) / (sum(before) over w + 1e-8 * count(*) over w) as p,
                    (after + 1e-8) / (sum(after) over w + 1e-8 * count(*) over w) as q from met window w as (partition by time_period))
select time_period, any_value(previous_period) as previous_period, any_value(distinct_topics) as distinct_topics,
       round(0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))), 6) as jensen_shannon_divergence,
       round(sum((q - p) * ln(q / p)), 6) as population_stability_index,
       round(max(abs(2 * asin(sqrt(q)) - 2 * asin(sqrt(p)))), 6) as maximum_cohen_h
from smoothed join periods using (time_period) group by time_period
"""


def topic_drift(spark, folder):
    drifted = topics.topic_drift(topic_states(spark, folder), BY_ORDER_YEAR)
    return drifted.select("parity", "time_period", "previous_period", *[F.round(name, 6).alias(name) for name in INEXACT])


TOPIC_DRIFT_SQL = f"""
with {PARTS_SQL}, {topic_distribution_sql('category')}, {DRIFT_SQL}
select parity, time_period, previous_period, round(jsd, 6) as jensen_shannon_divergence, round(psi, 6) as population_stability_index,
       round(cohen, 6) as maximum_cohen_h from drift
"""


# ---- evidence and samples ------------------------------------------------------------------


def evidence_rules():
    return [tr.speaker_tag_rule(), tr.speech_rate_rule("duration_ms"), tr.pii_rule(), tr.lexicon_rule(tb.LEXICON)]


def call_failures(spark, folder, rows=None):
    keyed = grp.group_keys(tq.calls_features(spark, folder) if rows is None else rows, BY_CALL_MONTH)
    return ev.failures(keyed, evidence_rules(), BY_CALL_MONTH, "call_id")


FAILURES_SQL = f"""
{FEATURES_SQL}, {SPEECH_RATED_SQL},
failing as (
  select 'agent_speaker_tag_validation' as rule_id, call_id, time_period, lang,
         case when total_turns = 0 then 'no_speaker_tags' when agent_turns = 0 or customer_turns = 0 then 'required_role_missing' else 'empty_speaker_turn' end as category
  from feat where text_present and not {SPEAKER_VALID}
  union all select 'speech_per_duration_rate', call_id, time_period, lang, 'speech_duration_outlier' from rated where {SPEECH_ELIGIBLE} and status <> 'pass'
  union all select 'pii_detection', call_id, time_period, lang, 'pii_category_detected' from feat where text_present and {PII_TOTAL} > 0
  union all select 'mistranslated_rate', call_id, time_period, lang, 'configured_mistranslation' from feat where text_present and token_count > 0 and {LEX_TOTAL} > 0),
scoped as (select rule_id, call_id, false as is_overall, time_period, lang, category from failing
           union all select rule_id, call_id, true, null, null, category from failing)
"""


def failing_rows(spark, folder):
    return call_failures(spark, folder).groupBy("rule_id", "is_overall", "time_period", "lang", "category").agg(
        F.count(F.lit(1)).alias("failures"), F.sum("call_id").alias("id_sum")
    )


FAILING_SQL = f"""with {FAILURES_SQL}
select rule_id, is_overall, time_period, lang, category, count(*) as failures, cast(sum(call_id) as bigint) as id_sum from scoped group by all"""


def evidence_records(spark, folder):
    """As many records as evidence keeps unless told otherwise."""
    kept = ev.collect_evidence(call_failures(spark, folder), BY_CALL_MONTH, "call_id", tb.SOURCE, tb.SALT)
    return kept.drop("failure_type")


EVIDENCE_CTES_SQL = f"""{FAILURES_SQL},
marked as (select *, {tq.fingerprint_sql(tb.SOURCE, 'call_id')} as row_fingerprint from scoped),
first_of as (select *, row_number() over (partition by rule_id, is_overall, time_period, lang order by row_fingerprint) as p from marked),
kept as (select * from first_of where p <= 5 order by p, rule_id, is_overall, time_period nulls first, lang nulls first, row_fingerprint limit {fixed.EVIDENCE_IN_TOTAL})
"""
EVIDENCE_SQL = f"""with {EVIDENCE_CTES_SQL}
select 'ev-' || substr(sha256(rule_id || '|' || is_overall || '|' || coalesce(time_period, '') || '|' || coalesce(lang, '') || '|' || row_fingerprint || '|' || category), 1, 24) as evidence_id,
       rule_id, is_overall, time_period, lang, row_fingerprint, category from kept"""

def evidence_totals(spark, folder):
    failing = materialize(call_failures(spark, folder), "failures")
    kept = ev.collect_evidence(failing, BY_CALL_MONTH, "call_id", tb.SOURCE, tb.SALT)
    return ev.evidence_summary(failing, kept, BY_CALL_MONTH)


EVIDENCE_TOTALS_SQL = f"""with {EVIDENCE_CTES_SQL},
o as (select rule_id, is_overall, time_period, lang, count(*) as observed_count from scoped group by all),
r as (select rule_id, is_overall, time_period, lang, count(*) as retained from kept group by all)
select o.*, coalesce(retained, 0) as retained_count, observed_count > coalesce(retained, 0) as truncated
from o left join r on o.rule_id = r.rule_id and o.is_overall = r.is_overall and o.time_period is not distinct from r.time_period and o.lang is not distinct from r.lang"""


def review_samples(spark, folder):
    picked = ev.stratified_sample(tb.calls(spark, folder), "transcript", "call_id", tb.SOURCE, "lang", "call_day", characters=300)
    return ev.within_budget(picked, 6000).select("sample_id", "stratum", F.length("sample").cast("bigint").alias("characters"), "characters_so_far")


REVIEW_SQL = f"""
with {tq.CALLS},
red as (select call_id, lang, call_day, transcript as text from spoken where text_present),
a as (select call_id as doc_id, lower(trim(lang)) || '|' || strftime(call_day, '%Y-%m') as stratum, sha256('{tb.SOURCE}|' || call_id) as h from red),
ranked as (select *, row_number() over (partition by stratum order by h) as p from a),
chosen as (select * from ranked where p <= 4 order by h limit 24),
texts as (select c.h, c.stratum, r.text from chosen c join red r on r.call_id = c.doc_id),
documents2 as (select h as doc_id, text from texts),
clean as ({tq.REDACTED_SQL.strip().rsplit('select doc_id, cast', 1)[0].replace('from documents)', 'from documents2)')} select doc_id, substr(t, 1, 300) as t from e),
summed as (select 'sha256:' || h as sample_id, stratum, cast(length(t) as bigint) as characters,
                  cast(sum(length(t)) over (order by h rows unbounded preceding) as bigint) as characters_so_far
           from texts join clean on h = doc_id)
select * from summed where characters_so_far <= 6000
"""


def own_rule_beside_built_in(spark, folder):
    """A caller's own rule and a built-in one with another threshold, in one pass; one that cannot run is left aside."""
    own = base.Rule("long_transcript", F.col("text_present"), F.col("token_count") > 100, lambda state: [
        base.Metric("long_share", F.coalesce(F.try_divide(
            state("passed_count").cast("double"), state("eligible_count").cast("double")), F.lit(0.0)), "ratio")])
    broken = base.Rule("broken", F.col("no_such_column") > 0, None, lambda state: [])
    keyed = grp.limit_groups(grp.group_keys(tq.calls_features(spark, folder), BY_CALL_MONTH), BY_CALL_MONTH)
    rules, failing = base.separate_failing(keyed, [own, tr.pii_rule(maximum_record_rate=0.5), broken], BY_CALL_MONTH)
    states = grp.measure(keyed, BY_CALL_MONTH, base.rule_states(rules), keyed=True, limited=True)
    table = base.metric_table(states, rules, BY_CALL_MONTH, None).where(F.col("metric_name").isin("long_share", "pii_record_rate"))
    return flat(table, ["lang"]).select(
        "rule_id", "is_overall", "time_period", "lang", "eligible_count", "passed_count", F.round("value", 9).alias("value"),
        F.when(F.col("metric_name") == "pii_record_rate", F.col("outcome")).alias("outcome"), F.lit(",".join(failing)).alias("failed_rules"))


OWN_RULE_SQL = f"""
with {FEATURES_SQL},
judged as (
  select 'long_transcript' as rule_id, time_period, lang, text_present as eligible, token_count > 100 as passed from feat
  union all select 'pii_detection', time_period, lang, text_present, {PII_TOTAL} = 0 from feat),
grouped as (
  select rule_id, grouping(time_period) = 1 as is_overall, time_period, lang, count_if(eligible) as eligible_count,
         count_if(eligible and passed) as passed_count
  from judged group by grouping sets ((rule_id), (rule_id, time_period, lang)))
select rule_id, is_overall, time_period, lang, cast(eligible_count as bigint) as eligible_count, cast(passed_count as bigint) as passed_count,
       round(case when eligible_count = 0 then 0.0 when rule_id = 'pii_detection' then (eligible_count - passed_count) / cast(eligible_count as double)
             else passed_count / cast(eligible_count as double) end, 9) as value,
       case when rule_id <> 'pii_detection' then null
            when (eligible_count - passed_count) / cast(eligible_count as double) <= 0.5 then 'passed' else 'failed' end as outcome, 'broken' as failed_rules
from grouped where rule_id <> 'pii_detection' or eligible_count > 0
"""


def failing_rule_beside_six(spark, folder):
    """Seven rules of which one raises on some row: it is reported with its error, the others with their rows."""
    broken = base.Rule("numbered_language", F.col("text_present"), F.col("lang").cast("int") > 0, lambda state: [
        base.Metric("numbered_share", state("passed_count").cast("double"))])
    longer, shorter = (base.Rule(name, F.col("text_present"), test, lambda state: [
        base.Metric("share", state("passed_count").cast("double"))]) for name, test in (
            ("over_hundred_words", F.col("token_count") > 100), ("under_thousand_words", F.col("token_count") < 1000)))
    rules = [*evidence_rules(), broken, longer, shorter]
    features = materialize(tq.calls_features(spark, folder).drop("transcript"), "features")
    partials, running, failing = base.measure_apart(grp.group_keys(features, BY_CALL_MONTH), rules, BY_CALL_MONTH)
    merges = {name: state.merge for name, state in base.rule_states(running).items()}
    table = base.metric_table(grp.roll_up(partials, BY_CALL_MONTH, merges), running, BY_CALL_MONTH)
    statuses = runs.rule_statuses(table, [rule.rule_id for rule in rules], list(failing), failing)
    counts = table.where("is_overall").groupBy("rule_id").agg(F.max("eligible_count").alias("eligible_count"), F.max("passed_count").alias("passed_count"))
    return statuses.join(counts, "rule_id", "left")


FAILING_BESIDE_SQL = f"""
with {FEATURES_SQL}, {SPEECH_RATED_SQL},
o as (
  select rule_id, eligible_count, passed_count from (select *, 'agent_speaker_tag_validation' as rule_id from ({speaker_group_sql('feat')})) where is_overall
  union all select rule_id, eligible_count, passed_count from (select *, 'speech_per_duration_rate' as rule_id from ({SPEECH_GROUP_SQL})) where is_overall
  union all select rule_id, eligible_count, passed_count from (select *, 'pii_detection' as rule_id from ({PII_GROUP_SQL})) where is_overall
  union all select rule_id, eligible_count, passed_count from (select *, 'mistranslated_rate' as rule_id from ({LEX_GROUP_SQL})) where is_overall
  union all select 'over_hundred_words', count_if(text_present), count_if(text_present and token_count > 100) from feat
  union all select 'under_thousand_words', count_if(text_present), count_if(text_present and token_count < 1000) from feat)
select rule_id, 'completed' as status, cast(null as varchar) as error, cast(eligible_count as bigint) as eligible_count, cast(passed_count as bigint) as passed_count from o
union all select 'numbered_language', 'failed', 'CAST_INVALID_INPUT', null, null
"""


def assessment_of_bound_columns(spark, folder):
    """Speech rate and topic mix of a table whose columns are found by role, and whose date is text declared a date."""
    made = tb.calls(spark, folder).select(
        F.col("call_id").alias("Number"), F.col("transcript").alias("Transcript_Text"), F.col("duration_ms").alias("Duration_Milliseconds"),
        F.concat(F.col("call_day").cast("string"), F.lit("T00:00:00")).alias("day"), "lang", F.col("lang").alias("theme"), F.col("source").alias("topic_name"))
    known = [binding.ColumnDomain(name, "conversation.topic") for name in ("theme", "topic_name")]
    table, columns = assessment.bind(made, "Number", domains=known, declared={"DAY": "date"}, targets=("lang",))
    settings = assessment.Settings("calls", tb.SALT, decimals=None)
    grouping = Grouping("day", "month", {"lang": "lang"})
    metrics = assessment.assess(table, columns, grouping, settings, only=["speech_per_duration_rate", "topic_distribution"])["metrics"]
    return flat(metrics, ["lang"]).where("metric_name in ('speech_words_per_minute', 'distinct_topic_count_lower_bound')").select(
        "rule_id", "is_overall", "time_period", "lang", "row_count", "metric_name", F.round("value", 6).alias("value"))


BOUND_SQL = f"""
with {FEATURES_SQL}, {SPEECH_RATED_SQL}, g as ({SPEECH_GROUP_SQL}),
t as (select grouping(lang) = 1 as is_overall, strftime(call_day, '%Y-%m') as time_period, lang, count(*) as row_count, count(distinct source) as topics
      from ({tb.CALLS_SQL}) group by grouping sets ((), (strftime(call_day, '%Y-%m'), lang)))
select 'speech_per_duration_rate' as rule_id, is_overall, time_period, lang, row_count, 'speech_words_per_minute' as metric_name, round(cast({OVERALL_RATE} as double), 6) as value
from g where {OVERALL_RATE} is not null
union all select 'topic_distribution', is_overall, time_period, lang, row_count, 'distinct_topic_count_lower_bound', cast(topics as double) from t"""


# ---- unions and incremental results -----------------------------------------------------------


def all_rule_metrics(spark, folder):
    """Completeness, transcript and topic metrics as one table, summarised per rule."""
    events = tb.events_fill(spark, folder)
    tables = [
        base.run_rules(events, [fill_rate.fill_rate_rule(events, gq.TARGETS)], gq.BY_MONTH),
        base.run_rules(tq.calls_features(spark, folder), evidence_rules(), BY_CALL_MONTH),
        topics.topic_metrics(topic_states(spark, folder), BY_ORDER_YEAR),
    ]
    return runs.union_results(tables).groupBy("rule_id", "metric_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_overall").alias("overall_rows"), F.sum("row_count").alias("row_total")
    )


def streamed(spark, folder, table, files, grouping, make_rules, prepare, **options):
    """A table dealt into files, read one file a batch into a store that folds every two segments; the store's path."""
    source = new_path(spark, f"{table}-files")
    tb.load(spark, folder, table, spread=False).repartition(files).write.parquet(source)
    partials = new_path(spark, "partials")
    incremental.start_incremental(
        spark, source, spark.read.parquet(source).schema, "parquet", partials, new_path(spark, "progress"), grouping, make_rules, prepare,
        files_per_batch=1, fanout=2, spread=table in tb.LONG_TEXTS, **options,
    ).awaitTermination()
    return partials


def incremental_fill_rate(spark, folder):
    """Completeness from states that a stream stored in four batches."""

    def make_rules(df):
        return [fill_rate.fill_rate_rule(df, gq.TARGETS)]

    partials = streamed(spark, folder, "events", 4, gq.BY_MONTH, make_rules, lambda df: tb.derived(df, tb.EVENTS_FILL))
    rules = make_rules(tb.derived(tb.load(spark, folder, "events"), tb.EVENTS_FILL))
    table = incremental.stored_metrics(spark, partials, gq.BY_MONTH, rules, decimals=None)
    return table.where(F.col("metric_name") == "fill_rate").select(
        "rule_id", "is_overall", "time_period", F.try_element_at("dims", F.lit("event_type")).alias("event_type"), *COUNTS,
        "value", "numerator", "denominator", "outcome",
    )


def incremental_topics(spark, folder):
    """Topic mix from counts that a stream stored in three batches and folded."""
    partials = streamed(
        spark, folder, "orders", 3, BY_ORDER_YEAR, lambda df: [], lambda df: tb.derived(df, tb.ORDER_TOPICS),
        topic=incremental.TopicSource("topic", tb.TOPIC_ONTOLOGY))
    tables = incremental.stored_topics(spark, partials, BY_ORDER_YEAR)
    return flat(topics.topic_metrics(tables, BY_ORDER_YEAR, decimals=None), ["parity"])


def incremental_unknown_words(spark, folder):
    """Unknown words from states that a stream stored in three batches, then folded into one."""
    words = tq.english_words(spark, folder)
    size = vocabulary.vocabulary_size(words)

    def prepare(df):
        featured = text_features(tb.as_calls(df), "transcript", with_tokens=True).drop("transcript")
        return vocabulary.with_unknown_words(featured, "tokens", words, size)

    rules = [tr.spelling_rule(size)]
    partials = streamed(spark, folder, "documents", 3, BY_CALL_MONTH, lambda df: rules, prepare)
    incremental.compact(spark, partials, BY_CALL_MONTH, rules)
    return flat(incremental.stored_metrics(spark, partials, BY_CALL_MONTH, rules, decimals=None), ["lang"])


def incremental_evidence(spark, folder):
    """Evidence records from fingerprints that a stream stored in three batches and folded."""
    source = incremental.EvidenceSource("call_id", tb.SOURCE, tb.SALT)
    partials = streamed(
        spark, folder, "documents", 3, BY_CALL_MONTH, lambda df: evidence_rules(),
        lambda df: text_features(tb.as_calls(df), "transcript", lexicon=tb.LEXICON).drop("transcript"), evidence=source)
    return incremental.stored_evidence(spark, partials, BY_CALL_MONTH, evidence_rules())[0].drop("failure_type")


QUERIES = {
    "speaker_tag_rule": speaker_tags,
    "exchange_speaker_tag_rule": exchange_speaker_tags,
    "speech_rate_rule": speech_rate,
    "personal_data_rule": personal_data,
    "mistranscription_rule": mistranscriptions,
    "spelling_rule": spelling,
    "transcript_rules_in_one_pass": transcript_rules,
    "topic_categories": topic_categories,
    "topic_distribution_rule": topic_distribution,
    "raw_topic_distribution": raw_topic_distribution,
    "topic_drift": topic_drift,
    "own_rule_beside_built_in": own_rule_beside_built_in,
    "topic_drift_of_many_categories": topic_drift_of_many_categories,
    "failing_rows": failing_rows,
    "evidence_records": evidence_records,
    "default_evidence_records": evidence_records,
    "evidence_totals": evidence_totals,
    "review_samples": review_samples,
    "incremental_fill_rate": incremental_fill_rate,
    "failing_rule_beside_six": failing_rule_beside_six,
    "assessment_of_bound_columns": assessment_of_bound_columns,
    "incremental_topics": incremental_topics,
    "incremental_unknown_words": incremental_unknown_words,
    "incremental_evidence": incremental_evidence,
}
ORACLES = {
    "speaker_tag_rule": SPEAKER_TAGS_SQL,
    "exchange_speaker_tag_rule": EXCHANGE_TAGS_SQL,
    "speech_rate_rule": SPEECH_SQL,
    "personal_data_rule": PII_SQL,
    "mistranscription_rule": LEX_SQL,
    "spelling_rule": SPELL_SQL,
    "transcript_rules_in_one_pass": TRANSCRIPT_RULES_SQL,
    "topic_categories": TOPIC_CATEGORIES_SQL,
    "topic_distribution_rule": TOPIC_SQL,
    "raw_topic_distribution": RAW_TOPIC_SQL,
    "topic_drift": TOPIC_DRIFT_SQL,
    "own_rule_beside_built_in": OWN_RULE_SQL,
    "topic_drift_of_many_categories": MANY_CATEGORIES_SQL,
    "failing_rows": FAILING_SQL,
    "evidence_records": EVIDENCE_SQL,
    "default_evidence_records": EVIDENCE_SQL,
    "evidence_totals": EVIDENCE_TOTALS_SQL,
    "review_samples": REVIEW_SQL,
    "incremental_fill_rate": gq.FILL_RATE_SQL,
    "failing_rule_beside_six": FAILING_BESIDE_SQL,
    "assessment_of_bound_columns": BOUND_SQL,
    "incremental_topics": TOPIC_SQL,
    "incremental_unknown_words": SPELL_SQL,
    "incremental_evidence": EVIDENCE_SQL,
}
