"""Threshold signals from profile observations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance import fixed_values as fixed
from parlance.functions import hashing

POLICY_SCHEMA = (
    "policy_id string, check_name string, metric_name string, domains array<string>, minimum_distinct int, "
    "message string, message_scale double, bands array<struct<operator:string,low:double,high:double,severity:string,signal_type:string>>"
)
OBSERVATION = (
    "check_name", "metric_name", "table_name", "column_name", "domain", "value", "sample_size", "confidence",
    "exact", "distinct_topics",
)
Extractor = Callable[[DataFrame, DataFrame], DataFrame]


def policy_table(spark: SparkSession, policies: Sequence[Mapping] = fixed.SIGNAL_POLICIES) -> DataFrame:
    """The configured policies as a table; identifiers must be unique and bands present."""
    names = [policy["policy_id"] for policy in policies]
    if len(set(names)) != len(names) or any(not policy["bands"] for policy in policies):
        raise ValueError("policies need unique names and at least one band")
    rows = [
        (p["policy_id"], p["check_name"], p["metric"], list(p["domains"]), p.get("minimum_distinct"), p["message"],
         float(p.get("message_scale", 100.0)), list(p["bands"]))
        for p in policies
    ]
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def profile_observations(profiles: DataFrame, domains: DataFrame) -> DataFrame:
    """Fill rate of every column, and the largest share of every topic column."""
    known = profiles.join(
        domains.select("table_name", "column_name", "domain"), ["table_name", "column_name"], "left"
    ).withColumn("domain", F.coalesce("domain", F.lit(fixed.DOMAIN_UNMATCHED)))
    dominant = F.array_max(F.transform("top_values", lambda entry: entry["count"]))
    fill = F.struct(
        F.lit("fill_rate").alias("check_name"),
        F.lit("fill_rate").alias("metric_name"),
        F.col("fill_rate").alias("value"),
        F.col("row_count").alias("sample_size"),
        F.lit(1.0).alias("confidence"),
        F.lit(True).alias("exact"),
        F.lit(None).cast("bigint").alias("distinct_topics"),
    )
    share = F.struct(
        F.lit("topic_distribution").alias("check_name"),
        F.lit("dominant_topic_share").alias("metric_name"),
        F.least(F.lit(1.0), F.try_divide(dominant.cast("double"), F.col("non_null_count").cast("double"))).alias("value"),
        F.col("non_null_count").alias("sample_size"),
        F.lit(0.75).alias("confidence"),
        F.lit(False).alias("exact"),
        F.col("distinct_count").alias("distinct_topics"),
    )
    has_topics = (F.col("domain") == "conversation.topic") & (F.col("non_null_count") > 0) & (F.size("top_values") > 0)
    observed = F.array_compact(F.array(fill, F.when(has_topics, share)))
    return known.select("table_name", "column_name", "domain", F.inline(observed)).select(*OBSERVATION)


def observe(profiles: DataFrame, domains: DataFrame, extractors: Sequence[Extractor] = (profile_observations,)) -> DataFrame:
    """Observations of several extractors; any function of profiles and domains will do."""
    found = [extract(profiles, domains).select(*OBSERVATION) for extract in extractors]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _holds(value: Column, band: Column) -> Column:
    low, high = band["low"], band["high"]
    tests = {
        "lt": value < low, "lte": value <= low, "gt": value > low, "gte": value >= low, "eq": value == low,
        "outside_inclusive": (value < low) | (value > high),
    }
    chosen = F.when(F.lit(False), F.lit(False))
    for name, test in tests.items():
        chosen = chosen.when(band["operator"] == name, test)
    return chosen.otherwise(F.raise_error(F.lit("unknown band operator")).cast("boolean"))


def with_policies(observations: DataFrame, policies: DataFrame) -> DataFrame:
    """Observations with the policy for their check and metric, where its domains apply."""
    joined = observations.join(policies, ["check_name", "metric_name"])
    return joined.where(F.array_contains("domains", "*") | F.array_contains(F.col("domains"), F.col("domain")))


def suppression(minimum_rows: int = fixed.SIGNAL_MINIMUM_ROWS) -> Column:
    """Why an observation must not raise a signal, or null."""
    few_topics = F.col("minimum_distinct").isNotNull() & (
        F.col("distinct_topics").isNull() | (F.col("distinct_topics") < F.col("minimum_distinct"))
    )
    return F.when(few_topics, "distinct-topic coverage is insufficient").when(
        ~F.col("exact") & (F.col("sample_size") < minimum_rows), "the sample is too small"
    )


def suppress_weak(matched: DataFrame, minimum_rows: int = fixed.SIGNAL_MINIMUM_ROWS) -> tuple[DataFrame, DataFrame]:
    """Observations that may raise signals, and those suppressed with the reason."""
    marked = matched.withColumn("suppressed_because", suppression(minimum_rows))
    strong = marked.where(F.col("suppressed_because").isNull()).drop("suppressed_because")
    return strong, marked.where(F.col("suppressed_because").isNotNull())


def apply_bands(matched: DataFrame) -> DataFrame:
    """First band of the policy that holds for the observed value."""
    each = matched.select(*[c for c in matched.columns if c != "bands"], F.posexplode("bands").alias("band_position", "band"))
    holding = each.where(_holds(F.col("value"), F.col("band")))
    order = Window.partitionBy("policy_id", "table_name", "column_name", "metric_name").orderBy("band_position")
    first = holding.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return first.select("*", "band.*").drop("band")


def rank_signals(banded: DataFrame) -> DataFrame:
    """Signals with identifier and message, most severe first."""
    severity = F.lit(0)
    for name, rank in fixed.SEVERITY_RANK.items():
        severity = F.when(F.col("severity") == name, rank).otherwise(severity)
    identified = banded.select(
        hashing.stable_id("sig-", 16, F.col("policy_id"), F.col("metric_name"), F.col("table_name"), F.col("column_name")).alias("signal_id"),
        "policy_id", "check_name", "metric_name", "table_name", "column_name", "signal_type", "severity", "confidence",
        F.bround("value", 8).alias("observed_value"),
        F.col("low").alias("threshold"),
        "high",
        _message().alias("message"),
        severity.alias("severity_rank"),
    )
    return identified.orderBy(F.desc("severity_rank"), F.desc("confidence"), "signal_id")


def _message() -> Column:
    # The policy row gives the format and the scale of its numbers: 100 shows shares in percent, 1 numbers as they are.
    scale = F.col("message_scale")
    return F.call_function(
        "format_string", F.col("message"), F.col("column_name"), F.col("value") * scale, F.col("low") * scale,
        F.coalesce("high", F.lit(0.0)) * scale,
    )


def detect(profiles: DataFrame, domains: DataFrame, policies: DataFrame, extractors: Sequence[Extractor] = (profile_observations,)) -> DataFrame:
    strong, _ = suppress_weak(with_policies(observe(profiles, domains, extractors), policies))
    return rank_signals(apply_bands(strong))


def check_coverage(observations: DataFrame, checks: Sequence[str] = fixed.REQUIRED_CHECKS) -> DataFrame:
    """For every required check, whether anything was observed and how much."""
    counted = observations.groupBy("check_name").agg(F.count(F.lit(1)).alias("observation_count"))
    required = observations.sparkSession.createDataFrame([(name,) for name in checks], "check_name string")
    count = F.coalesce("observation_count", F.lit(0))
    return required.join(counted, "check_name", "left").select(
        "check_name",
        (count > 0).alias("available"),
        F.when(count > 0, "observed in the profile").otherwise("must be measured on the rows").alias("reason"),
        count.alias("observation_count"),
    )
