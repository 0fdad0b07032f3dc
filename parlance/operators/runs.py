"""Summaries of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.sources.sinks import reporting_name

COMPLETED, WITH_WARNINGS, FAILED = "completed", "completed_with_warnings", "failed"
SKIPPED, PENDING, PARTIAL = "skipped", "implementation_pending", "partial"


class RowCount:
    """Counts the rows of a frame while another job reads them."""

    def __init__(self) -> None:
        self._observation = Observation()

    def of(self, df: DataFrame) -> DataFrame:
        """The same rows; their number is known once a job has read them."""
        return df.observe(self._observation, F.count(F.lit(1)).alias("rows"))

    def value(self) -> int:
        return self._observation.get["rows"]


def run_summary(rows: DataFrame | int, filtered: DataFrame | int, metrics: DataFrame, statuses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows read and kept, groups, rules by status, failures observed and retained.

    ``statuses`` has one row per requested rule (rule_id, status). Rows may be given as numbers, such as a `RowCount` has taken.
    """
    groups = metrics.where(~F.col("is_overall")).select("time_period", F.to_json("dims").alias("dims")).distinct()
    status = F.col("status")

    def counted(source: DataFrame | int, name: str) -> DataFrame:
        if isinstance(source, int):
            return metrics.sparkSession.range(1).select(F.lit(source).cast("bigint").alias(name))
        return source.agg(F.count(F.lit(1)).alias(name))

    parts = [
        counted(rows, "rows_read"),
        counted(filtered, "rows_after_filters"),
        groups.agg(F.count(F.lit(1)).alias("groups_created")),
        statuses.agg(
            F.count(F.lit(1)).alias("rules_requested"),
            F.count_if(~status.isin(SKIPPED, PENDING)).alias("rules_executed"),
            F.count_if(status.isin(COMPLETED, WITH_WARNINGS)).alias("rules_completed"),
            F.count_if(status.isin(SKIPPED, PENDING)).alias("rules_skipped"),
            F.count_if(status == FAILED).alias("rules_failed"),
        ),
        evidence.agg(
            F.coalesce(F.sum("observed_count"), F.lit(0)).alias("evidence_observed"),
            F.coalesce(F.sum("retained_count"), F.lit(0)).alias("evidence_retained"),
        ),
    ]
    single_rows = parts[0]
    for part in parts[1:]:
        single_rows = single_rows.unionByName(part, allowMissingColumns=True)
    return single_rows.agg(*[F.max(name).alias(name) for name in single_rows.columns])


def run_status(statuses: DataFrame, warnings: int = 0) -> DataFrame:
    """Partial if a rule failed or is pending; with warnings if any was raised or a rule skipped."""
    seen = statuses.agg(
        F.max(F.col("status").isin(FAILED, PENDING)).alias("incomplete"),
        F.max(F.col("status").isin(WITH_WARNINGS, SKIPPED)).alias("warned"),
    )
    return seen.select(
        F.when(F.col("incomplete"), PARTIAL).when(F.col("warned") | F.lit(warnings > 0), WITH_WARNINGS)
        .otherwise(COMPLETED).alias("status")
    )


def rule_statuses(
    metrics: DataFrame, requested: Sequence[str], failing: Sequence[str] = (), errors: Mapping[str, str] | None = None
) -> DataFrame:
    """Completed for every requested rule that produced metrics, failed for those that could not run, skipped otherwise.

    With ``errors``, the conditions under which rules failed, there is a column for them.
    """
    asked = metrics.sparkSession.createDataFrame([(name,) for name in requested], "rule_id string")
    produced = metrics.select("rule_id").distinct().withColumn("ran", F.lit(True))
    status = F.when(F.col("ran"), COMPLETED).when(F.col("rule_id").isin(*failing), FAILED).otherwise(SKIPPED).alias("status")
    columns = ["rule_id", status]
    if errors is not None:
        pairs = [F.lit(part) for pair in errors.items() for part in pair]
        known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        columns.append(F.try_element_at(known, F.col("rule_id")).alias("error"))
    return asked.join(produced, "rule_id", "left").select(*columns)


def check_summary(metrics: DataFrame) -> DataFrame:
    """Primary metric and population of every rule, and how many groups it has."""
    primary = F.when(F.lit(False), F.lit(""))
    for rule, metric in fixed.SUMMARY_METRICS.items():
        primary = primary.when(F.col("rule_id") == rule, metric)
    chosen = metrics.where(F.col("metric_name") == primary.otherwise(F.col("metric_name")))
    overall = chosen.where("is_overall").select(
        "rule_id", reporting_name("rule_id").alias("reporting_name"), "metric_name", "value", "outcome", "row_count",
        "eligible_count", "passed_count", "failed_count", "skipped_count",
    )
    groups = chosen.where(~F.col("is_overall")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("groups"))
    return overall.join(groups, "rule_id", "left").withColumn("grouped_result_count", F.coalesce("groups", F.lit(0))).drop("groups")


def union_results(tables: Sequence[DataFrame]) -> DataFrame:
    """Results of several rules as one table."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole
