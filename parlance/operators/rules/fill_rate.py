"""Completeness of target columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import fixed_values as fixed
from parlance.functions import ramps
from parlance.functions import text as tx
from parlance.operators.grouping import Grouping
from parlance.operators.rules import base
from parlance.operators.rules.base import Metric, Rule


def populated(df: DataFrame, column: str, transcript: str | None = None) -> Column:
    """True when a cell holds a value.

    Text must not be a spelling of a missing value; the transcript column only
    has to be non-blank, unless it is left unnamed here.
    """
    value, data_type = F.col(column), df.schema[column].dataType
    if column == transcript:
        return tx.present(value)
    if isinstance(data_type, T.StringType):
        return ~tx.is_null_like(value, fixed.RULE_NULL_LIKE)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return tx.safe_scalar(value).isNotNull()
    return value.isNotNull()


def fill_rate_rule(
    df: DataFrame,
    targets: Sequence[str],
    transcript: str | None = None,
    passes_from: float = fixed.FILL_RATE_PASS,
    warns_above: float = fixed.FILL_RATE_WARN,
) -> Rule:
    return _rule({name: populated(df, name, transcript) for name in targets}, passes_from, warns_above)


def fill_rate_from_cells(
    targets: Sequence[str], passes_from: float = fixed.FILL_RATE_PASS, warns_above: float = fixed.FILL_RATE_WARN
) -> Rule:
    """The rule for frames that already hold one ``filled_cell_<target>`` flag per target."""
    return _rule({name: F.col(f"filled_cell_{name}") for name in targets}, passes_from, warns_above)


def _rule(filled: dict[str, Column], passes_from: float, warns_above: float) -> Rule:
    if not filled:
        raise ValueError("name at least one target column")
    if not 0.0 <= warns_above < passes_from <= 1.0:
        raise ValueError("fill-rate thresholds must be increasing and within 0 and 1")
    targets = list(filled)
    all_filled = F.lit(True)
    for cell in filled.values():
        all_filled = all_filled & cell
    states = {f"filled_{name}": base.count_if(cell) for name, cell in filled.items()}

    def metrics(state):
        total_filled = sum((state(f"filled_{name}") for name in targets[1:]), state(f"filled_{targets[0]}"))
        observed = state("row_count") * len(targets)
        rate = F.coalesce(ramps.ratio(total_filled, observed), F.lit(0.0))
        outcome = ramps.rate_status(rate, passes_from, warns_above, (base.PASSED, base.WARNING, base.FAILED))
        pairs = [
            part
            for name in targets
            for part in (F.lit(name), F.coalesce(ramps.ratio(state(f"filled_{name}"), state("row_count")), F.lit(0.0)))
        ]
        threshold = f"pass>={passes_from}, warn>{warns_above}"
        return [
            Metric("fill_rate", rate, "ratio", total_filled, observed, threshold, outcome),
            Metric("fill_rate_by_column", None, "ratio", None, None, threshold, outcome, F.create_map(*pairs)),
        ]

    return Rule("fill_rate", F.lit(True), all_filled, metrics, states, F.lit("missing_required_value"))


def fill_rate_by_column(
    states: DataFrame,
    targets: Sequence[str],
    grouping: Grouping,
    passes_from: float = fixed.FILL_RATE_PASS,
    warns_above: float = fixed.FILL_RATE_WARN,
) -> DataFrame:
    """Total, filled, missing, rate and status per target column, from rule states."""
    rows = F.col("fill_rate__row_count")
    cells = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"fill_rate__filled_{name}").alias("filled"))
        for name in targets
    ]
    rate = F.coalesce(ramps.ratio(F.col("filled"), F.col("total")), F.lit(0.0))
    return (
        states.select("is_overall", *grouping.keys, rows.alias("total"), F.inline(F.array(*cells)))
        .withColumn("missing", F.greatest(F.lit(0), F.col("total") - F.col("filled")))
        .withColumn("fill_rate", rate)
        .withColumn("status", ramps.rate_status(F.col("fill_rate"), passes_from, warns_above))
    )


