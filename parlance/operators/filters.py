"""Row filters with the null behaviour data-quality users expect.

All filters must hold. A null differs from every value, so ``not_equals`` and
``not_in`` keep it; ordering comparisons never do. Values of another kind than
the column compare as different.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import fixed_values as fixed
from parlance.operators.columns import require_allowed, typed

ORDERED = {
    "greater_than": lambda column, value: column > value,
    "greater_than_or_equal": lambda column, value: column >= value,
    "less_than": lambda column, value: column < value,
    "less_than_or_equal": lambda column, value: column <= value,
}
OPERATORS = ("equals", "not_equals", "in", "not_in", *ORDERED, "between", "is_null", "is_not_null")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    values: Sequence[Any] = ()


def _literal(value: Any, data_type: T.DataType) -> Column | None:
    """The value as a literal of the column's kind, or None if the kinds differ."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(data_type, temporal) and isinstance(value, str):
        return F.lit(value).try_cast(data_type)
    if isinstance(data_type, temporal) and isinstance(value, (datetime.date, datetime.datetime)):
        return F.lit(value).cast(data_type)
    if isinstance(data_type, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return None if isinstance(value, str) else F.lit(value)
    return F.lit(value)


def condition(df: DataFrame, item: Filter) -> Column:
    """The filter as a boolean column that is never null."""
    return F.coalesce(_predicate(df, item), F.lit(False))


def _predicate(df: DataFrame, item: Filter) -> Column:
    """The filter in a form the scan can take over; null where it does not hold."""
    if item.operator not in OPERATORS:
        raise ValueError(f"unknown filter operator {item.operator!r}")
    if len(item.values) > fixed.MAXIMUM_FILTER_VALUES:
        raise ValueError("too many values in one filter")
    require_allowed(df, [item.column])
    column, data_type = typed(df, item.column)
    unusable = F.isnan(column) | (F.abs(column) == F.lit(float("inf"))) if isinstance(
        data_type, (T.DoubleType, T.FloatType)) else None
    if unusable is not None:
        # NaN and the infinities count as missing everywhere.
        missing = column.isNull() | unusable
    else:
        missing = column.isNull()
    if item.operator == "is_null":
        return missing
    if item.operator == "is_not_null":
        return ~missing

    literals = [None if value is None else _literal(value, data_type) for value in item.values]
    usable = [literal for literal in literals if literal is not None]
    if item.operator in ("equals", "not_equals"):
        if item.values[0] is None:
            equal = missing
        else:
            equal = column.eqNullSafe(usable[0]) if usable else F.lit(False)
        return equal if item.operator == "equals" else ~equal
    if item.operator in ("in", "not_in"):
        listed = column.isin(*usable) if usable else F.lit(False)
        if item.operator == "in":
            return listed | missing if None in item.values else listed
        return ~listed & ~missing if None in item.values else column.isNull() | ~listed
    if len(usable) < len(item.values):
        return F.lit(False)
    if item.operator == "between":
        holds = column.between(usable[0], usable[1])
    else:
        holds = ORDERED[item.operator](column, usable[0])
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        holds = holds & ~unusable
    return holds


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Rows for which every filter holds; runs before any text work."""
    if len(filters) > fixed.MAXIMUM_FILTERS:
        raise ValueError("too many filters")
    for item in filters:
        df = df.where(_predicate(df, item))
    return df
