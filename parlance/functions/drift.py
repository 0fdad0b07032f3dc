"""Distances between two category distributions, as terms to add up over categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance import fixed_values as fixed


def smoothed_share(count: Column, total: Column, categories: Column, epsilon: float = fixed.DRIFT_EPSILON) -> Column:
    """Share of a category in a total of at least one, smoothed over all categories of both distributions."""
    whole = F.greatest(total, F.lit(1)).cast("double") + categories * F.lit(epsilon)
    return (count.cast("double") + F.lit(epsilon)) / whole


def jensen_shannon_term(p: Column, q: Column) -> Column:
    """A category's part of the divergence, with natural logarithm."""
    middle = (p + q) / 2.0
    return 0.5 * (p * F.log(p / middle) + q * F.log(q / middle))


def population_stability_term(p: Column, q: Column) -> Column:
    return (q - p) * F.log(q / p)


def cohen_h(p: Column, q: Column) -> Column:
    return F.abs(F.lit(2.0) * F.asin(F.sqrt(q)) - F.lit(2.0) * F.asin(F.sqrt(p)))
