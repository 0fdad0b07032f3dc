"""Facts about columns that travel with them, as metadata of the schema's fields.

`annotated` notes for each column whether it may serve as filter or dimension, its domain and semantic type, and a declared
temporal type of text. Spark keeps the notes through selections, filters, joins and files. Filters and groupings read them: an
unsafe column is refused without being asked, and text that is declared a date is compared and grouped as one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import dates
from parlance.functions.text import quoted
from parlance.operators import binding

NOTES = "parlance"
_TYPES = {"date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}


class UnsafeColumnError(ValueError):
    """A filter or dimension uses a sensitive or free-text column."""


def notes(df: DataFrame, name: str) -> Mapping[str, object]:
    """What is noted about a column; empty for a column without notes."""
    return df.schema[name].metadata.get(NOTES, {})


def annotated(
    df: DataFrame, table: str, guard: DataFrame | None = None, domains: DataFrame | None = None,
    declared: Mapping[str, str] | None = None,
) -> DataFrame:
    """The frame with notes from a grouping guard, assigned domains and declared types, each of one row per column."""
    found: dict[str, dict] = {name: {} for name in df.columns}
    for facts, names in ((guard, ("allowed", "sensitive", "free_text")), (domains, ("domain", "semantic_type"))):
        if facts is not None:
            for row in facts.where(F.col("table_name") == table).select("column_name", *names).collect():
                if row["column_name"] in found:
                    found[row["column_name"]].update({name: row[name] for name in names if row[name] is not None})
    types = {name.casefold(): kind for name, kind in (declared or {}).items()}
    for field in df.schema.fields:
        item = found[field.name]
        kind = binding.temporal_type(types.get(field.name.casefold()), item.get("semantic_type"), item.get("domain"))
        if kind and isinstance(field.dataType, T.StringType):
            item["declared_type"] = kind
    return df.select(*[
        quoted(field.name).alias(field.name, metadata={**field.metadata, NOTES: {**notes(df, field.name), **found[field.name]}})
        for field in df.schema.fields
    ])


def require_allowed(df: DataFrame, names: Sequence[str | None]) -> None:
    """Raise if a note says that any of the columns must not be filtered or grouped by."""
    refused = sorted({name for name in names if name and not notes(df, name).get("allowed", True)})
    if refused:
        raise UnsafeColumnError(f"columns {refused} must not be grouped or filtered by")


def typed(df: DataFrame, name: str, zone: str = "UTC") -> tuple[Column, T.DataType]:
    """A column with its type, parsed if it is text declared a date or timestamp."""
    field = df.schema[name]
    kind = notes(df, name).get("declared_type")
    if kind in _TYPES and isinstance(field.dataType, T.StringType):
        return dates.parse_iso(quoted(name), zone).cast(str(kind)), _TYPES[kind]
    return quoted(name), field.dataType
