"""End-to-end plans built from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.operators import binding, classify, evidence, patterns, relationships, runs, scoring, signals, vocabulary
from parlance.operators import grouping as grp
from parlance.operators import profile as prof
from parlance.operators.applicability import Selector, rule_applicability
from parlance.operators.features import text_features
from parlance.operators.filters import Filter, apply_filters
from parlance.operators.grouping import Grouping
from parlance.operators.rules import base, fill_rate, topics, transcript_rules
from parlance.sources.storage import materialize


@dataclass(frozen=True)
class TranscriptColumns:
    row_key: str
    transcript: str
    duration: str | None = None
    topic: str | None = None
    targets: Sequence[str] = ()


@dataclass(frozen=True)
class Settings:
    source: str
    salt: bytes
    lexicon: Mapping[str, Sequence[str]] | None = None
    ontology: topics.Ontology = ()
    duration_unit: str = "milliseconds"
    decimals: int | None = fixed.RESULT_DECIMALS
    allow_partial: bool = False
    # Arguments of rule constructors by rule, such as thresholds, and rules of the caller's own.
    rule_options: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    own_rules: Sequence[base.Rule] = ()
    # What scores, confidence, impact and recommendations are looked up in.
    score_catalogue: scoring.Catalogue = fixed.SCORE_CATALOGUE
    confidence_weights: Mapping[str, float] = field(default_factory=lambda: fixed.CONFIDENCE_WEIGHTS)
    impact_conditions: patterns.Conditions = fixed.IMPACT_CONDITIONS
    recommendations: patterns.Recommendations = fixed.RECOMMENDATIONS


def understand(
    tables: Mapping[str, DataFrame],
    policies: DataFrame,
    selectors: Sequence[Selector],
    dictionary: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Profiles, domains, relationships, signals and applicable rules of several tables."""
    frames = [prof.profile(df, name) for name, df in tables.items()]
    profiles = materialize(runs.union_results(frames), "profiles")
    domains = materialize(classify.classify_columns(profiles, dictionary), "domains")
    related = relationships.discover(profiles, domains)
    observed = signals.observe(profiles, domains)
    return {
        "profile": profiles,
        "domains": domains,
        "relationships": related,
        "signals": signals.detect(profiles, domains, policies),
        "check_coverage": signals.check_coverage(observed),
        "applicable_rules": rule_applicability(list(selectors), profiles, domains, related),
    }


def bind(
    df: DataFrame,
    row_key: str,
    overrides: Mapping[str, str] | None = None,
    domains: Sequence[binding.ColumnDomain] = (),
    declared: Mapping[str, str] | None = None,
    aliases: Mapping[str, Sequence[str]] = binding.ROLE_ALIASES,
    targets: Sequence[str] = (),
    zone: str = "UTC",
) -> tuple[DataFrame, TranscriptColumns]:
    """The table with its declared dates parsed, and the columns found for the roles of an assessment.

    A transcript must be found. Of several topic columns the one that comes first among the aliases is preferred.
    """
    known = list(domains)

    def found(role: str, required: bool = False) -> str | None:
        return binding.resolve_role(role, df.columns, overrides, known, aliases, required)

    labelled = {item.column_name.casefold() for item in known if item.domain == "conversation.topic"}
    topical = [name for name in df.columns if name.casefold() in labelled]
    named = {role.casefold() for role in overrides or {}}
    topic = topics.preferred_topic_column(topical, aliases.get("topic", ())) if topical and "topic" not in named else found("topic")
    columns = TranscriptColumns(row_key, found("transcript", required=True), found("duration"), topic, targets)
    return binding.apply_declared_temporal(df, declared or {}, known, zone), columns


def transcript_features(
    df: DataFrame,
    columns: TranscriptColumns,
    settings: Settings,
    words: DataFrame | None,
    word_count: int,
    keep: Sequence[str],
) -> DataFrame:
    """Features of all transcript rules beside the columns to keep, written once for all branches."""
    featured = text_features(df, columns.transcript, lexicon=settings.lexicon, with_tokens=words is not None)
    added = [name for name in featured.columns if name not in df.columns]
    rows = featured.select(*dict.fromkeys(keep), *added)
    if words is None:
        none = {name: F.lit(0).cast("bigint") for name in ("evaluated_words", "unknown_words")}
        return materialize(rows, "features").withColumns(none)
    return materialize(vocabulary.with_unknown_words(rows, "tokens", words, word_count), "features")


def assess(
    df: DataFrame,
    columns: TranscriptColumns,
    grouping: Grouping,
    settings: Settings,
    filters: Sequence[Filter] = (),
    words: DataFrame | None = None,
    provenance_matches: bool = True,
    only: Sequence[str] = (),
    guard: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All rules, or only those named, over one transcript table, then evidence, scores and patterns.

    With a grouping guard, dimensions and filters on sensitive or free-text columns are refused.
    """
    if guard is not None:
        classify.enforce_guard(guard, [*grouping.dimensions.values(), *[item.column for item in filters]])
    rows = apply_filters(df, filters)
    targets = list(columns.targets) or [columns.transcript]
    word_count = vocabulary.vocabulary_size(words) if words is not None else 0
    filled = {f"filled_cell_{name}": fill_rate.populated(rows, name, columns.transcript) for name in targets}
    marked = rows.withColumns(filled)
    grouped_by = [grouping.time_column, *grouping.dimensions.values(), columns.duration]
    keep = [columns.row_key, *[name for name in grouped_by if name], *filled]
    counter = runs.RowCount()
    features = transcript_features(counter.of(marked), columns, settings, words, word_count, keep)
    options = {name: dict(chosen) for name, chosen in settings.rule_options.items()}
    rules = [
        fill_rate.fill_rate_from_cells(targets, **options.pop("fill_rate", {})),
        transcript_rules.speaker_tag_rule(**options.pop("agent_speaker_tag_validation", {})),
        transcript_rules.pii_rule(**options.pop("pii_detection", {})),
        transcript_rules.spelling_rule(word_count, **options.pop("non_english_spelling", {})),
    ]
    speech, lexicon, mixing = (options.pop(name, {}) for name in ("speech_per_duration_rate", "mistranslated_rate", topics.RULE_ID))
    if options:
        raise ValueError(f"options for unknown rules {sorted(options)}")
    if columns.duration:
        rules.append(transcript_rules.speech_rate_rule(columns.duration, settings.duration_unit, **speech))
    if settings.lexicon:
        rules.append(transcript_rules.lexicon_rule(settings.lexicon, **lexicon))
    rules.extend(settings.own_rules)
    if only:
        rules = base.select_rules(rules, only)
    # Groups are limited once, so that evidence and patterns name the groups that metrics have.
    keyed = grp.limit_groups(grp.group_keys(features, grouping), grouping)
    requested = [rule.rule_id for rule in rules]
    partials, rules, failing_rules = base.measure_apart(keyed, rules, grouping)
    merges = {name: state.merge for name, state in base.rule_states(rules).items()}
    tables = [base.metric_table(grp.roll_up(partials, grouping, merges), rules, grouping, settings.decimals)]
    if columns.topic and (not only or topics.RULE_ID in {base.measured_name(name) for name in only}):
        mixed = topics.topic_states(rows, columns.topic, grouping, settings.ontology)
        mixed = topics.TopicTables(materialize(mixed.states, "topic-states"), materialize(mixed.counts, "topic-counts"))
        tables.append(topics.topic_metrics(mixed, grouping, decimals=settings.decimals, **mixing))
        requested.append(topics.RULE_ID)
    metrics = materialize(runs.union_results(tables), "metrics")
    failing = materialize(evidence.failures(keyed, rules, grouping, columns.row_key), "failures")
    kept = evidence.collect_evidence(failing, grouping, columns.row_key, settings.source, settings.salt)
    summary = materialize(evidence.evidence_summary(failing, kept, grouping), "evidence_summary")
    availability = scoring.metric_availability(metrics, requested)
    scored = materialize(
        scoring.score_metrics(scoring.primary_metrics(metrics, settings.score_catalogue), availability, settings.allow_partial), "scores"
    )
    by_rule = scoring.rule_scores(scored)
    statuses = runs.rule_statuses(metrics, requested, list(failing_rules), failing_rules)
    timed = summary if grp.PERIOD in summary.columns else summary.withColumn(grp.PERIOD, F.lit(None).cast("string"))
    found = patterns.failure_patterns(timed, list(grouping.dimensions))
    facts, dropped = patterns.fact_table(metrics, timed, list(grouping.dimensions))
    return {
        "metrics": metrics,
        "evidence": kept,
        "evidence_summary": summary,
        "metric_availability": availability,
        "metric_scores": scored,
        "rule_scores": by_rule,
        "group_scores": scoring.group_scores(scored),
        "aggregate_score": scoring.aggregate_score(by_rule, catalogue=settings.score_catalogue),
        "confidence": scoring.assessment_confidence(
            by_rule, statuses.where("status = 'completed'"), summary, provenance_matches, weights=settings.confidence_weights),
        "patterns": found,
        "root_causes": patterns.root_cause_candidates(found),
        "impact_hypotheses": patterns.impact_hypotheses(scored, settings.impact_conditions),
        "recommendations": patterns.recommendations(scored, settings.impact_conditions, settings.recommendations),
        "facts": facts,
        "dropped_facts": dropped,
        "run_summary": runs.run_summary(df if filters else counter.value(), counter.value(), metrics, statuses, summary),
        "run_status": runs.run_status(statuses),
        "check_summary": runs.check_summary(metrics),
    }
