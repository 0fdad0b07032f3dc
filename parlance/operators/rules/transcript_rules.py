"""The five rules over transcript features.

Each works on the columns ``operators.features.text_features`` adds; the
spelling rule also needs ``evaluated_words`` and ``unknown_words``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.functions import ramps
from parlance.functions import text as tx
from parlance.operators.grouping import State
from parlance.operators.rules import base
from parlance.operators.rules.base import Metric, Rule


def speaker_tag_rule(maximum_invalid_rate: float = fixed.MAXIMUM_INVALID_SPEAKER_RATE) -> Rule:
    """Every present transcript needs tagged turns, both parties and no empty turn.

    Only known labels are ever recognised, so the count of unknown labels is zero.
    """
    eligible = F.col("text_present")
    untagged, missing_role = F.col("total_turns") == 0, ~F.col("roles_present")
    has_empty = F.col("empty_turns") > 0
    valid = ~untagged & ~missing_role & ~has_empty
    zero = F.lit(0).cast("bigint")
    states = {
        "turns": base.sum_of(F.when(eligible, F.col("total_turns")).otherwise(zero)),
        "mismatched_turns": base.sum_of(F.when(eligible, F.col("empty_turns")).otherwise(zero)),
        "no_speaker_tags": base.count_if(eligible & untagged),
        "required_role_missing": base.count_if(eligible & missing_role),
        "unknown_label": base.sum_of(zero),
        "empty_turn": base.count_if(eligible & has_empty),
    }

    def metrics(state):
        failed, rows = state("failed_count"), state("eligible_count")
        rate = ramps.ratio(failed, rows)
        outcome = base.threshold_outcome(rate, maximum_invalid_rate)
        summary = F.create_map(
            F.lit("rows_evaluated"), rows.cast("double"),
            F.lit("rows_with_mismatch"), failed.cast("double"),
            F.lit("rows_matching"), state("passed_count").cast("double"),
            F.lit("mismatch_rate"), rate,
            F.lit("total_utterances"), state("turns").cast("double"),
            F.lit("mismatched_utterances"), state("mismatched_turns").cast("double"),
        )
        categories = {
            name: state(name) for name in ("no_speaker_tags", "required_role_missing", "unknown_label", "empty_turn")
        }
        return [
            Metric("invalid_speaker_tag_rate", rate, "ratio", failed, rows, f"<={maximum_invalid_rate}", outcome),
            Metric("speaker_tag_summary", None, "count", outcome=outcome, value_map=summary),
            Metric("speaker_failure_categories", None, "count", value_map=base.counts_map(categories)),
            Metric("average_speaker_turns", ramps.ratio(state("turns"), rows), "turns_per_transcript"),
        ]

    category = (
        F.when(untagged, "no_speaker_tags").when(missing_role, "required_role_missing")
        .when(has_empty, "empty_speaker_turn").otherwise("rule_failure")
    )
    return Rule("agent_speaker_tag_validation", eligible, valid, metrics, states, category)


def speech_rate_rule(
    duration: str,
    unit: str = "milliseconds",
    minimum_duration: float = fixed.MINIMUM_DURATION,
    passing: tuple[float, float] = fixed.WPM_PASS,
    warning: tuple[float, float] = fixed.WPM_WARN,
) -> Rule:
    """Words per minute of transcripts with a plausible duration."""
    if unit not in ("milliseconds", "seconds"):
        raise ValueError("unit must be milliseconds or seconds")
    if passing[0] < 0 or passing[1] <= passing[0] or warning[0] > passing[0] or warning[1] < passing[1]:
        raise ValueError("the warning range must enclose the pass range")
    length = tx.safe_scalar(F.col(duration).cast("double"))
    seconds = length / 1000.0 if unit == "milliseconds" else length
    words = F.col("token_count")
    eligible = F.coalesce(
        F.col("text_present") & (length >= minimum_duration) & (words > 0) & (seconds > 0), F.lit(False)
    )
    # The divisor is non-zero exactly for eligible rows.
    rate = F.when(eligible, words / (seconds / 60.0))
    status = ramps.range_status(rate, passing, warning)
    states = {
        "words": base.sum_of(F.when(eligible, words).otherwise(F.lit(0).cast("bigint"))),
        "seconds": base.sum_of(F.when(eligible, seconds).otherwise(F.lit(0.0))),
        "rate_sum": base.sum_of(rate),
        "rate_min": State("min", rate),
        "rate_max": State("max", rate),
        **{name: base.count_if(eligible & (status == name)) for name in ("pass", "warn", "fail")},
    }

    def metrics(state):
        overall = ramps.ratio(state("words"), state("seconds") / 60.0)
        outcome = F.when(overall.isNull(), base.NOT_EVALUATED).otherwise(
            ramps.range_status(overall, passing, warning, (base.PASSED, base.WARNING, base.FAILED))
        )
        summary = F.create_map(
            F.lit("average"), ramps.ratio(state("rate_sum"), state("eligible_count")),
            F.lit("minimum"), state("rate_min"),
            F.lit("maximum"), state("rate_max"),
        )
        statuses = base.counts_map({name: state(name) for name in ("pass", "warn", "fail")})
        threshold = f"pass {passing[0]}..{passing[1]}, warn {warning[0]}..{warning[1]}"
        return [
            Metric("speech_words_per_minute", overall, "words_per_minute", state("words"), state("seconds"), threshold, outcome),
            Metric("row_words_per_minute_summary", None, "words_per_minute", value_map=summary),
            Metric("speech_rate_status_counts", None, "count", value_map=statuses),
        ]

    return Rule("speech_per_duration_rate", eligible, status == "pass", metrics, states, F.lit("speech_duration_outlier"))


def pii_rule(
    categories: Sequence[str] = tuple(name for name, _, _ in fixed.PII_PATTERNS),
    maximum_record_rate: float = fixed.MAXIMUM_PII_RECORD_RATE,
) -> Rule:
    """Transcripts in which any enabled category of personal data occurs."""
    eligible = F.col("text_present")
    found = sum((F.col(f"pii_{name}") for name in categories[1:]), F.col(f"pii_{categories[0]}"))
    zero = F.lit(0).cast("bigint")
    states = {
        f"found_{name}": base.sum_of(F.when(eligible, F.col(f"pii_{name}")).otherwise(zero)) for name in categories
    }

    def metrics(state):
        failed, rows = state("failed_count"), state("eligible_count")
        rate = ramps.ratio(failed, rows)
        by_category = {name: state(f"found_{name}") for name in categories}
        occurrences = sum(list(by_category.values())[1:], by_category[categories[0]])
        return [
            Metric("pii_record_rate", rate, "ratio", failed, rows, f"<={maximum_record_rate}",
                   base.threshold_outcome(rate, maximum_record_rate)),
            Metric("pii_occurrence_count", occurrences, "count"),
            Metric("pii_category_counts", None, "count", value_map=base.counts_map(by_category)),
        ]

    return Rule("pii_detection", eligible, found == 0, metrics, states, F.lit("pii_category_detected"))


def lexicon_rule(lexicon: Mapping[str, Sequence[str]], maximum_rate: float = fixed.MAXIMUM_LEXICON_RATE) -> Rule:
    """Suspected mistranscriptions per token."""
    categories = list(lexicon)
    eligible = F.col("text_present") & (F.col("token_count") > 0)
    hits = sum((F.col(f"lexicon_{name}") for name in categories[1:]), F.col(f"lexicon_{categories[0]}"))
    zero = F.lit(0).cast("bigint")
    states = {
        "tokens": base.sum_of(F.when(eligible, F.col("token_count")).otherwise(zero)),
        **{f"hits_{name}": base.sum_of(F.when(eligible, F.col(f"lexicon_{name}")).otherwise(zero)) for name in categories},
    }

    def metrics(state):
        by_category = {name: state(f"hits_{name}") for name in categories}
        total = sum(list(by_category.values())[1:], by_category[categories[0]])
        rate = ramps.ratio(total, state("tokens"))
        return [
            Metric("mistranslated_rate", rate, "matches_per_token", total, state("tokens"), f"<={maximum_rate}",
                   base.threshold_outcome(rate, maximum_rate)),
            Metric("mistranslation_category_counts", None, "count", value_map=base.counts_map(by_category)),
        ]

    return Rule("mistranslated_rate", eligible, hits == 0, metrics, states, F.lit("configured_mistranslation"))


def spelling_rule(
    vocabulary_size: int,
    maximum_unknown_rate: float = fixed.MAXIMUM_UNKNOWN_TOKEN_RATE,
    minimum_tokens: int = fixed.MINIMUM_EVALUATED_TOKENS,
    minimum_vocabulary: int = fixed.MINIMUM_VOCABULARY_SIZE,
) -> Rule:
    """Unknown words, judged only against a vocabulary of sufficient size."""
    evaluated, unknown = F.col("evaluated_words"), F.col("unknown_words")
    present = F.col("text_present")
    eligible = F.coalesce(present & F.lit(vocabulary_size >= minimum_vocabulary) & (evaluated > 0), F.lit(False))
    zero = F.lit(0).cast("bigint")
    row_rate = ramps.ratio(unknown, evaluated)
    states = {
        "tokens": base.sum_of(F.when(eligible, evaluated).otherwise(zero)),
        "unknown": base.sum_of(F.when(eligible, unknown).otherwise(zero)),
        "letters": base.sum_of(F.when(present, F.col("letter_count")).otherwise(zero)),
        "non_ascii": base.sum_of(F.when(present, F.col("non_ascii_letter_count")).otherwise(zero)),
    }

    def metrics(state):
        rate = F.when(state("tokens") >= minimum_tokens, ramps.ratio(state("unknown"), state("tokens")))
        return [
            Metric("unknown_token_rate", rate, "ratio", state("unknown"), state("tokens"), f"<={maximum_unknown_rate}",
                   base.threshold_outcome(rate, maximum_unknown_rate)),
            Metric("non_ascii_alphabetic_rate", ramps.ratio(state("non_ascii"), state("letters")), "ratio",
                   state("non_ascii"), state("letters")),
        ]

    return Rule("non_english_spelling", eligible, row_rate <= maximum_unknown_rate, metrics, states,
                F.lit("unknown_token_rate_exceeded"))
