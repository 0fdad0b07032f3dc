"""Relationships between columns, proposed from profiles and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import hashing


def _candidate(kind: str, source: Column, target: Column, confidence: Column, method: str) -> list[Column]:
    identity = [F.lit(kind), F.col("table_name"), source, F.lit("->"), target]
    return [
        hashing.stable_id("rel-", 16, *identity).alias("relationship_id"),
        F.col("table_name"),
        F.lit(kind).alias("relationship_type"),
        source.alias("source_column"),
        target.cast("string").alias("target_column"),
        F.bround(confidence, 6).alias("confidence"),
        F.lit(method).alias("method"),
    ]


def _distinct_ratio() -> Column:
    return F.try_divide(F.col("distinct_count").cast("double"), F.col("non_null_count").cast("double"))


def identifier_candidates(profiles: DataFrame, minimum: float = fixed.IDENTIFIER_RATIO) -> DataFrame:
    """Columns whose values are nearly all different."""
    near_unique = profiles.where(_distinct_ratio() >= minimum)
    return near_unique.select(
        *_candidate("identifier", F.col("column_name"), F.lit(None), F.least(F.lit(1.0), _distinct_ratio()), "exact_distinct_ratio")
    )


def categorical_dimensions(profiles: DataFrame, maximum: float = fixed.CATEGORICAL_RATIO) -> DataFrame:
    """Columns with few values, usable as dimensions."""
    few = profiles.where((F.col("distinct_count") > 1) & (_distinct_ratio() <= maximum))
    confidence = F.least(F.lit(0.95), F.lit(1.0) - _distinct_ratio())
    return few.select(
        *_candidate("categorical_dimension", F.col("column_name"), F.lit(None), confidence, "exact_distinct_ratio")
    )


def _with_domain(profiles: DataFrame, domains: DataFrame) -> DataFrame:
    return profiles.join(domains.select("table_name", "column_name", "domain"), ["table_name", "column_name"], "left")


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("table_name", F.col("column_name").alias(name), F.col("fill_rate").alias(f"{name}_fill"))


def transcript_duration_pairs(profiles: DataFrame, domains: DataFrame, minimum: float = fixed.PAIR_COVERAGE) -> DataFrame:
    """Transcript and duration columns of one table that are both well filled."""
    known = _with_domain(profiles, domains).where(F.col("fill_rate") >= minimum)
    transcripts = _side(known.where(F.col("domain") == "conversation.transcript"), "transcript")
    durations = _side(known.where(F.col("domain") == "interaction.duration"), "duration")
    coverage = F.least("transcript_fill", "duration_fill")
    return transcripts.join(durations, "table_name").select(
        *_candidate("transcript_duration", F.col("transcript"), F.col("duration"), F.least(F.lit(0.9), coverage), "domain_and_coverage")
    )


def speaker_structure_pairs(profiles: DataFrame, domains: DataFrame) -> DataFrame:
    """Columns showing speaker labels with the speaker columns of the same table."""
    known = _with_domain(profiles, domains)
    tagged = _side(known.where(F.array_contains("detected_patterns", "speaker_labels")), "tagged")
    speakers = _side(known.where(F.col("domain") == "conversation.speaker"), "speaker")
    pairs = tagged.join(speakers, "table_name").where(F.col("tagged") != F.col("speaker"))
    confidence = F.least(F.lit(0.9), F.col("tagged_fill"), F.col("speaker_fill"))
    return pairs.select(
        *_candidate("speaker_structure", F.col("tagged"), F.col("speaker"), confidence, "speaker_pattern_and_domain")
    )


def rank_relationships(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Relationships, each once, the most confident first; all of them unless a limit is asked for."""
    ranked = candidates.dropDuplicates(["relationship_id"]).orderBy(F.desc("confidence"), "relationship_id")
    return ranked if limit is None else ranked.limit(limit)


def discover(profiles: DataFrame, domains: DataFrame, limit: int | None = None) -> DataFrame:
    found = identifier_candidates(profiles).unionByName(categorical_dimensions(profiles))
    paired = transcript_duration_pairs(profiles, domains).unionByName(speaker_structure_pairs(profiles, domains))
    return rank_relationships(found.unionByName(paired), limit)
