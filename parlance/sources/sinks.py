"""Writing result tables, after checking that they reveal nothing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance import fixed_values as fixed

FORMATS = ("parquet", "csv", "json")
# Columns of the library's own tables that its operators fill with statistics, hashes or names of columns.
OWN_COLUMNS = {
    "profile": ("text", "top_values", "value_hash"),
    "domains": ("matched_features",),
    "applicable_rules": ("matched_domains",),
    "signals": ("observed_value", "signal_id"),
    "observations": ("value",),
    "metrics": ("value", "value_map"),
}


class RedactionError(ValueError):
    """An output holds something it must not."""


def _field_names(kind: T.DataType, prefix: str) -> list[tuple[str, str]]:
    """(path, name) of every field, nested ones included."""
    if isinstance(kind, T.StructType):
        return [
            found
            for item in kind.fields
            for found in ((f"{prefix}{item.name}", item.name), *_field_names(item.dataType, f"{prefix}{item.name}."))
        ]
    if isinstance(kind, T.ArrayType):
        return _field_names(kind.elementType, prefix)
    return _field_names(kind.valueType, prefix) if isinstance(kind, T.MapType) else []


def assert_redacted(
    df: DataFrame, hashed: tuple[str, ...] = (), fingerprints: tuple[str, ...] = (), known: tuple[str, ...] = ()
) -> DataFrame:
    """Return the frame if it is safe to write.

    Field names, nested ones included, must not be those of raw content; ``known`` names are statistics of the library.
    ``hashed`` columns must hold value hashes and ``fingerprints`` salted row references.
    """
    import re

    allowed = {"value", "value_map", *hashed, *fingerprints, *known}
    forbidden = [
        path for path, name in _field_names(df.schema, "") if name not in allowed and re.search(fixed.FORBIDDEN_FIELD_NAMES, name)
    ]
    if forbidden:
        raise RedactionError(f"columns {forbidden} may hold raw values")
    unsafe = F.lit(False)
    for name in hashed:
        unsafe = unsafe | ~F.col(name).rlike("^[0-9a-f]{16}$")
    for name in fingerprints:
        unsafe = unsafe | ~F.col(name).rlike("^sha256:[0-9a-f]{64}$")
    if (hashed or fingerprints) and not df.where(F.coalesce(unsafe, F.lit(True))).limit(1).isEmpty():
        raise RedactionError("a value that should be hashed is not")
    return df


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.withColumns(
        {item.name: F.to_json(F.col(item.name)) for item in df.schema.fields if isinstance(item.dataType, nested)}
    )


def _write(df: DataFrame, path: str, form: str, partitions: tuple[str, ...] = ()) -> None:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    writer = (_flat(df) if form == "csv" else df).write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    if form == "csv":
        writer = writer.option("header", True)
    writer.format(form).save(path)


def write_metrics(df: DataFrame, path: str, form: str = "parquet") -> None:
    """One dataset, split by rule and by overall or grouped: each rule's export is a folder of it."""
    named = df.withColumn("reporting_name", reporting_name("rule_id"))
    _write(assert_redacted(named), path, form, ("rule_id", "is_overall"))


def reporting_name(rule_id: str):
    chosen = F.when(F.lit(False), F.lit(""))
    for measured, reported in fixed.REPORTING_NAMES.items():
        chosen = chosen.when(F.col(rule_id) == measured, reported)
    return chosen.otherwise(F.col(rule_id))


def write_profile_tables(tables: Mapping[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Profile, dictionary, domains, relationships, signals and applicable rules, each on its own."""
    for name, table in tables.items():
        hashed = tuple(column for column in ("value_hash", "sample_hash") if column in table.columns)
        checked = assert_redacted(table, hashed=hashed, known=OWN_COLUMNS.get(name, ()))
        _write(checked, f"{path.rstrip('/')}/{name}", form)
