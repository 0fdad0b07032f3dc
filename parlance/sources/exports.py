"""Exports of rule results: a summary of each rule, its overall details and its monthly (grouped) rows.

Each export is one dataset split by run and rule. A rerun overwrites exactly the partitions of the rules it holds, and a manifest
row for each of these, written last, makes them visible: readers take only partitions that the manifest of their run names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources import sinks

SUMMARY, DETAIL, MONTHLY, MANIFEST = "summary", "detail", "monthly", "manifest"
COUNTS = ("row_count", "eligible_count", "passed_count", "failed_count", "skipped_count")
# The columns of detail and monthly exports, in their order.
COLUMNS = (
    "canonical_rule_id", "runtime_rule_id", "time_period", "dimensions", "row_count", "eligible_count", "passed_count", "failed_count",
    "skipped_count", "metric_name", "metric_value", "unit", "outcome", "threshold",
)


def metric_rows(metrics: DataFrame, grouped: bool) -> DataFrame:
    """One row per metric, overall or of groups; dimensions and values as JSON text."""
    number = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value").cast("string"))
    kept = metrics.where(~F.col("is_overall") if grouped else F.col("is_overall"))
    return kept.select(
        sinks.reporting_name("rule_id").alias("canonical_rule_id"), F.col("rule_id").alias("runtime_rule_id"), "time_period",
        F.to_json("dims").alias("dimensions"), *COUNTS, "metric_name",
        F.coalesce(F.when(F.col("value_map").isNotNull(), F.to_json("value_map")), number, F.lit("null")).alias("metric_value"),
        "unit", "outcome", "threshold",
    ).select(*COLUMNS)


def rule_summaries(metrics: DataFrame) -> DataFrame:
    """One row per rule: its overall population, its metrics, and how many groups it has."""
    overall = F.col("is_overall")
    # A rule has a few metrics.
    entry = F.struct("metric_name", "value", "value_map", "unit", "numerator", "denominator", "threshold", "outcome")
    group = F.struct("time_period", F.to_json("dims").alias("dims"))
    return metrics.groupBy("rule_id").agg(
        *[F.max(F.when(overall, F.col(name))).alias(name) for name in COUNTS],
        F.count_distinct(F.when(~overall, group)).alias("group_count"),
        F.array_sort(F.collect_list(F.when(overall, F.struct(F.col("metric_name").alias("name"), F.to_json(entry).alias("metric"))))).alias("found"),
    ).select(
        sinks.reporting_name("rule_id").alias("canonical_rule_id"), F.col("rule_id").alias("runtime_rule_id"), *COUNTS, "group_count",
        F.concat(F.lit("["), F.array_join(F.transform("found", lambda item: item["metric"]), ","), F.lit("]")).alias("metrics"),
    )


def _replace(df: DataFrame, path: str, form: str) -> None:
    """Overwrite the partitions that the rows belong to, and no others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "rule")
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(form).save(path)


def write_exports(metrics: DataFrame, path: str, run_id: str) -> None:
    """Write the three exports of a run's rules, then the manifest that makes them visible."""
    tables = {SUMMARY: (rule_summaries(metrics), "json"), DETAIL: (metric_rows(metrics, False), "csv"), MONTHLY: (metric_rows(metrics, True), "csv")}
    root = path.rstrip("/")
    for name, (table, form) in tables.items():
        checked = sinks.assert_redacted(table, known=("metric_value",))
        _replace(checked.withColumns({"run_id": F.lit(run_id), "rule": F.col("runtime_rule_id")}), f"{root}/{name}", form)
    rules = metrics.groupBy("rule_id").agg(F.count_if("is_overall").alias("detail_rows"), F.count_if(~F.col("is_overall")).alias("monthly_rows"))
    _replace(rules.withColumns({"run_id": F.lit(run_id), "rule": F.col("rule_id")}), f"{root}/{MANIFEST}", "json")


_COUNTED = ", ".join(f"{name} bigint" for name in COUNTS)
_ROWS = (
    "canonical_rule_id string, runtime_rule_id string, time_period string, dimensions string, "
    f"{_COUNTED}, metric_name string, metric_value string, unit string, outcome string, threshold string, run_id string, rule string"
)
_SCHEMAS = {
    SUMMARY: f"canonical_rule_id string, runtime_rule_id string, {_COUNTED}, group_count bigint, metrics string, run_id string, rule string",
    DETAIL: _ROWS,
    MONTHLY: _ROWS,
    MANIFEST: "rule_id string, detail_rows bigint, monthly_rows bigint, run_id string, rule string",
}


def read_export(spark: SparkSession, path: str, name: str, run_id: str) -> DataFrame:
    """One export of a run, without partitions its manifest does not name."""
    root = path.rstrip("/")

    def read(table: str) -> DataFrame:
        reader = spark.read.schema(_SCHEMAS[table]).option("header", True).option("escape", '"')
        return reader.format("csv" if table in (DETAIL, MONTHLY) else "json").load(f"{root}/{table}").where(F.col("run_id") == run_id)

    return read(name).join(read(MANIFEST).select("rule"), "rule", "left_semi").drop("rule")
