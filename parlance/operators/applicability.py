"""Which rules apply to which columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAXIMUM_RULES = 1000


@dataclass(frozen=True)
class Selector:
    """Conditions a column must meet; ``match_mode`` combines those that are set."""

    rule_id: str
    required_domains: tuple[str, ...] = ()
    semantic_types: tuple[str, ...] = ()
    column_name_patterns: tuple[str, ...] = ()
    excluded_column_patterns: tuple[str, ...] = ()
    required_relationship_types: tuple[str, ...] = ()
    minimum_domain_confidence: float = 0.0
    match_mode: str = "any"
    enabled: bool = True
    approved: bool = True
    tags: tuple[str, ...] = field(default_factory=tuple)


def selectors(rules: DataFrame) -> list[Selector]:
    """Selectors of a rule table. Rules are configuration, so their number is checked and small."""
    rows = rules.select(
        "rule_id", "selector.*", "enabled", (F.col("lifecycle") == "approved").alias("approved"),
        F.coalesce("suggested_by_model", F.lit(False)).alias("suggested"),
    ).orderBy("rule_id").limit(MAXIMUM_RULES + 1).collect()
    if len(rows) > MAXIMUM_RULES:
        raise ValueError("too many rules")
    return [
        Selector(
            row["rule_id"],
            *[tuple(row[name] or ()) for name in (
                "required_domains", "semantic_types", "column_name_patterns", "excluded_column_patterns",
                "required_relationship_types",
            )],
            minimum_domain_confidence=row["minimum_domain_confidence"] or 0.0,
            match_mode=row["match_mode"] or "any",
            enabled=row["enabled"],
            approved=row["approved"] and not row["suggested"],
        )
        for row in rows
    ]


def _matches(selector: Selector) -> Column:
    checks = []
    if selector.required_domains:
        listed = F.coalesce(F.col("domain").isin(*selector.required_domains), F.lit(False))
        checks.append(F.lit("*" in selector.required_domains) | listed)
    if selector.semantic_types:
        checks.append(F.coalesce(F.col("semantic_type").isin(*selector.semantic_types), F.lit(False)))
    if selector.column_name_patterns:
        checks.append(F.col("column_name").rlike("(?i)" + "|".join(f"(?:{p})" for p in selector.column_name_patterns)))
    if selector.required_relationship_types:
        wanted = F.array(*[F.lit(kind) for kind in selector.required_relationship_types])
        checks.append(F.arrays_overlap(F.col("relationship_types"), wanted))
    met = F.lit(True)
    if checks:
        met = checks[0]
        for check in checks[1:]:
            met = (met & check) if selector.match_mode == "all" else (met | check)
    confident = F.coalesce(F.col("confidence") >= selector.minimum_domain_confidence, F.lit(True))
    chosen = met & confident
    if selector.excluded_column_patterns:
        excluded = "(?i)" + "|".join(f"(?:{p})" for p in selector.excluded_column_patterns)
        chosen = chosen & ~F.col("column_name").rlike(excluded)
    return chosen


def rule_targets(chosen: list[Selector], profiles: DataFrame, domains: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row per rule and column it selects, from one look at each column.

    Selectors become conditions on the column's row; rules are not joined.
    """
    ends = relationships.select(
        "table_name", "relationship_type", F.explode(F.array("source_column", "target_column")).alias("column_name")
    ).where(F.col("column_name").isNotNull())
    related = ends.groupBy("table_name", "column_name").agg(F.collect_set("relationship_type").alias("relationship_types"))
    keys = ["table_name", "column_name"]
    columns = (
        profiles.select(*keys)
        .join(domains.select(*keys, "domain", "semantic_type", "confidence"), keys, "left")
        .join(related, keys, "left")
        .withColumn("relationship_types", F.coalesce("relationship_types", F.array().cast("array<string>")))
    )
    hits = F.array_compact(F.array(*[F.when(_matches(item), F.lit(item.rule_id)) for item in chosen]))
    return columns.select(*keys, "domain", "confidence", F.explode(hits).alias("rule_id"))


def rule_applicability(chosen: list[Selector], profiles: DataFrame, domains: DataFrame, relationships: DataFrame) -> DataFrame:
    """Status, targets and mean domain confidence of every rule in every table."""
    targets = rule_targets(chosen, profiles, domains, relationships)
    rules = F.array(
        *[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.enabled).alias("enabled"), F.lit(r.approved).alias("approved")) for r in chosen]
    )
    every = profiles.select("table_name").distinct().select("table_name", F.inline(rules))
    found = targets.groupBy("table_name", "rule_id").agg(
        F.array_sort(F.collect_set("column_name")).alias("target_columns"),
        F.array_sort(F.collect_set("domain")).alias("matched_domains"),
        F.bround(F.avg("confidence"), 6).alias("mean_confidence"),
    )
    has_targets = F.col("target_columns").isNotNull()
    status = (
        F.when(~F.col("enabled"), "disabled").when(~F.col("approved"), "needs_review")
        .when(~has_targets, "not_applicable").otherwise("applicable")
    )
    confident = F.col("enabled") & has_targets
    return every.join(found, ["table_name", "rule_id"], "left").select(
        "table_name",
        "rule_id",
        status.alias("status"),
        F.when(confident, F.coalesce("mean_confidence", F.lit(1.0))).otherwise(1.0).alias("confidence"),
        F.coalesce("target_columns", F.array().cast("array<string>")).alias("target_columns"),
        F.coalesce("matched_domains", F.array().cast("array<string>")).alias("matched_domains"),
    )
