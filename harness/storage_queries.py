"""Queries that go through files: CSV transcripts, written metrics, bound roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import grouping_queries as gq
from harness import profile_queries as pq
from harness import rule_queries as rq
from harness import tables as tb
from harness import text_queries as tq
from parlance import fixed_values as fixed
from parlance.functions import text as tx
from parlance.operators import binding
from parlance.operators import grouping as grp
from parlance.operators.rules import base, fill_rate
from parlance.operators.rules import transcript_rules as tr
from parlance.sources import exports, readers, sinks
from parlance.sources.storage import materialize, new_path

CALLS_OUT = {
    "Call Number": "call_id",
    "Transcript_Text": "transcript",
    "duration_milliseconds": "duration_ms",
    "direction": "lang",
}


def csv_transcripts(spark, folder):
    """Calls written as CSV, then read back with inferred types and bound to their roles."""
    path = new_path(spark, "calls-csv")
    made = tb.calls(spark, folder)
    renamed = made.select(*[F.col(source).alias(name) for name, source in CALLS_OUT.items()])
    renamed.write.option("header", True).option("escape", '"').csv(path)
    read = readers.read_transcripts(spark, path)
    bound = binding.bind_roles(
        read, ("transcript", "duration", "interaction_direction"), keep=("Call Number",)
    )
    return bound.select(
        F.col("Call Number").cast("bigint").alias("call_id"),
        F.col("interaction_direction").alias("direction"),
        F.col("duration").cast("double").alias("duration"),
        tx.present(F.col("transcript")).alias("text_present"),
        F.sha2(tx.strip(F.coalesce("transcript", F.lit(""))), 256).alias("digest"),
    )


def split_csv_transcripts(spark, folder):
    """Calls written as CSV with line breaks in fields, then read back by many tasks a file."""
    path = new_path(spark, "calls-csv")
    tb.calls(spark, folder).select("call_id", "transcript", "duration_ms", "lang").write.option("header", True).option("escape", '"').csv(path)
    read = readers.read_split_csv(spark, path, "call_id bigint, transcript string, duration_ms double, lang string")
    return read.where("_corrupt_line is null").select(
        "call_id", F.col("lang").alias("direction"), F.col("duration_ms").alias("duration"),
        tx.present(F.col("transcript")).alias("text_present"), F.sha2(tx.strip(F.coalesce("transcript", F.lit(""))), 256).alias("digest"))


CSV_SQL = f"""
with c as ({tb.CALLS_SQL})
select call_id, lang as direction, duration_ms as duration, regexp_matches(coalesce(transcript, ''), '\\S') as text_present,
       sha256(trim(coalesce(transcript, ''), ' ' || chr(9) || chr(10) || chr(13))) as digest from c
"""


def written_metrics(spark, folder):
    """Completeness metrics as read back from the sink."""
    df = tb.events_fill(spark, folder)
    path = new_path(spark, "metrics-out")
    sinks.write_metrics(base.run_rules(df, [fill_rate.fill_rate_rule(df, gq.TARGETS)], gq.BY_MONTH, decimals=None), path)
    back = spark.read.parquet(path)
    return back.where(F.col("metric_name") == "fill_rate").select(
        "rule_id", F.col("is_overall").cast("boolean").alias("is_overall"), "time_period",
        F.try_element_at("dims", F.lit("event_type")).alias("event_type"), *rq.COUNTS,
        "value", "numerator", "denominator", "outcome",
    )


def ordered_groups(spark, folder):
    """All groups in presentation order: overall, then periods, then dimensions."""
    df = tb.load(spark, folder, "orders")
    column = binding.bind_group_column(df, "interaction_date", temporal=True)
    status = binding.bind_group_column(df, "order_status", aliases=("o_orderstatus",))
    grouping = grp.Grouping(column, "month", {"status": status})
    measured = grp.measure(df, grouping, grp.counters(F.lit(True), None))
    return grp.group_order(measured, grouping).select("is_overall", "time_period", "status", "row_count")


ORDERED_SQL = """
select grouping(o_orderstatus) = 1 as is_overall, time_period, o_orderstatus as status, count(*) as row_count
from (select strftime(o_orderdate, '%Y-%m') as time_period, o_orderstatus from orders)
group by grouping sets ((), (time_period, o_orderstatus)) order by 1 desc, 2 nulls first, 3 nulls first
"""

def exported_rows(spark, folder):
    """Detail and monthly exports of two rules, written twice and read back by their manifest."""
    path = new_path(spark, "exports")
    metrics = materialize(base.run_rules(
        tq.calls_features(spark, folder), [tr.speaker_tag_rule(), tr.pii_rule()], rq.BY_CALL_MONTH, decimals=None), "metrics")
    exports.write_exports(metrics, path, "first")
    exports.write_exports(metrics.where("rule_id = 'pii_detection'"), path, "second")
    exports.write_exports(metrics, path, "second")
    parts = [exports.read_export(spark, path, name, "second").withColumn("is_overall", F.lit(name == exports.DETAIL)) for name in (exports.DETAIL, exports.MONTHLY)]
    return parts[0].unionByName(parts[1]).withColumn("value", F.col("metric_value").try_cast("double")).where("value is not null").select(
        F.col("runtime_rule_id").alias("rule_id"), "is_overall", "time_period", F.get_json_object("dimensions", "$.lang").alias("lang"), *rq.COUNTS,
        "metric_name", "outcome", "value")


EXPORTED_SQL = f"""
with {rq.FEATURES_SQL}, g1 as ({rq.speaker_group_sql('feat')}), g3 as ({rq.PII_GROUP_SQL}),
every as ({rq.rows_sql('agent_speaker_tag_validation', 'g1', rq.KEYS, rq.SPEAKER_METRICS)} union all {rq.rows_sql('pii_detection', 'g3', rq.KEYS, rq.PII_METRICS)})
select * exclude (category) from every where category is null"""


def exported_summaries(spark, folder):
    """Summary exports of the rules of a run."""
    path = new_path(spark, "exports")
    metrics = base.run_rules(tq.calls_features(spark, folder), [tr.speaker_tag_rule(), tr.pii_rule()], rq.BY_CALL_MONTH)
    exports.write_exports(materialize(metrics, "metrics"), path, "run")
    found = exports.read_export(spark, path, exports.SUMMARY, "run")
    return found.select("canonical_rule_id", F.col("runtime_rule_id").alias("rule_id"), *rq.COUNTS, "group_count")


EXPORTED_SUMMARIES_SQL = f"""
with {rq.FEATURES_SQL}, g as (select 'agent_speaker_tag_validation' as rule_id, is_overall, row_count, eligible_count, passed_count, failed_count from ({rq.speaker_group_sql('feat')})
  union all select 'pii_detection', is_overall, row_count, eligible_count, passed_count, failed_count from ({rq.PII_GROUP_SQL}))
select case rule_id when 'pii_detection' then 'privacy_detection' else 'speaker_tag_validation' end as canonical_rule_id, rule_id,
       max(row_count) filter (where is_overall) as row_count, max(eligible_count) filter (where is_overall) as eligible_count,
       max(passed_count) filter (where is_overall) as passed_count, max(failed_count) filter (where is_overall) as failed_count,
       max(row_count - eligible_count) filter (where is_overall) as skipped_count, count(*) filter (where not is_overall) as group_count
from g group by rule_id"""


def _profile_tables(spark, folder):
    path = new_path(spark, "profile-tables")
    sinks.write_profile_tables({"profile": pq.profiles(spark, folder), "domains": pq.domains(spark, folder)}, path)
    return path


def written_profiles(spark, folder):
    """Profiles of all tables as read back from the sink."""
    return pq._flat(spark.read.parquet(f"{_profile_tables(spark, folder)}/profile"))


def written_domains(spark, folder):
    """Assigned domains as read back from the sink."""
    return spark.read.parquet(f"{_profile_tables(spark, folder)}/domains").drop("matched_features")


def refused_tables(spark, folder):
    """Which tables the sinks refuse, since their columns are named like raw content."""
    found = []
    for name, df in pq.frames(spark, folder).items():
        try:
            sinks.assert_redacted(df)
            found.append((name, False))
        except sinks.RedactionError:
            found.append((name, True))
    return spark.createDataFrame(found, "table_name string, is_refused boolean")


REFUSED_TABLES_SQL = "select table_name, bool_or(name <> 'value' and regexp_matches(name, '" + fixed.FORBIDDEN_FIELD_NAMES + "')) as is_refused from (values " + ", ".join(
    f"('{t}', '{c}')" for t, columns in pq.SCHEMAS.items() for c in columns) + ") as c(table_name, name) group by 1"


QUERIES = {
    "exported_rows": exported_rows,
    "exported_summaries": exported_summaries,
    "written_profiles": written_profiles,
    "written_domains": written_domains,
    "refused_tables": refused_tables,
    "csv_transcripts": csv_transcripts,
    "split_csv_transcripts": split_csv_transcripts,
    "written_metrics": written_metrics,
    "leading_groups": ordered_groups,
    "ordered_groups": ordered_groups,
}
ORACLES = {
    "exported_rows": EXPORTED_SQL,
    "exported_summaries": EXPORTED_SUMMARIES_SQL,
    "written_profiles": pq.COLUMN_STATISTICS_SQL,
    "written_domains": pq.DOMAINS_SQL,
    "refused_tables": REFUSED_TABLES_SQL,
    "csv_transcripts": CSV_SQL,
    "split_csv_transcripts": CSV_SQL,
    "written_metrics": gq.FILL_RATE_SQL,
    "leading_groups": ORDERED_SQL,
    "ordered_groups": ORDERED_SQL,
}
