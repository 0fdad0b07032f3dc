"""Score ramps, bands and outcomes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import fixed_values as fixed


def _clamped(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def higher_is_better_linear(value: Column, fail_at: Column, pass_at: Column) -> Column:
    return _clamped(F.lit(100.0) * (value - fail_at) / (pass_at - fail_at))


def lower_is_better_linear(value: Column, pass_at: Column, fail_at: Column) -> Column:
    return _clamped(F.lit(100.0) * (fail_at - value) / (fail_at - pass_at))


def inside_range_linear(
    value: Column, warn_low: Column, pass_low: Column, pass_high: Column, warn_high: Column
) -> Column:
    rising = F.lit(100.0) * (value - warn_low) / (pass_low - warn_low)
    falling = F.lit(100.0) * (warn_high - value) / (warn_high - pass_high)
    return _clamped(
        F.when(value.between(pass_low, pass_high), F.lit(100.0)).when(value < pass_low, rising).otherwise(falling)
    )


def score_band(score: Column, bands: Sequence[tuple[str, float]] = fixed.SCORE_BANDS) -> Column:
    chosen = F.when(score.isNull(), F.lit("not_evaluated"))
    for name, minimum in sorted(bands, key=lambda band: -band[1]):
        chosen = chosen.when(score >= minimum, F.lit(name))
    return chosen.otherwise(F.lit("not_evaluated"))


def rate_status(rate: Column, passes_from: float, warns_above: float, labels=("pass", "warn", "fail")) -> Column:
    good, fair, bad = labels
    return F.when(rate >= passes_from, F.lit(good)).when(rate > warns_above, F.lit(fair)).otherwise(F.lit(bad))


def range_status(
    value: Column, passing: tuple[float, float], warning: tuple[float, float], labels=("pass", "warn", "fail")
) -> Column:
    good, fair, bad = labels
    return (
        F.when(value.between(*passing), F.lit(good)).when(value.between(*warning), F.lit(fair)).otherwise(F.lit(bad))
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
