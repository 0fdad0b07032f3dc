"""Choosing physical columns for roles and groupings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import dates

ROLE_ALIASES = {
    "transcript": ("transcript", "transcript_text"),
    "interaction_date": ("interaction_date", "interaction_timestamp"),
    "interaction_direction": ("interaction_direction", "direction"),
    "interaction_identifier": ("interaction_id",),
    "topic": ("topic", "topic_name", "topic_description"),
    "duration": ("duration_milliseconds", "duration_seconds", "duration_ms"),
    "transcript_length": ("transcript_length",),
}
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


class BindingError(ValueError):
    """A role cannot be bound to exactly one column."""


@dataclass(frozen=True)
class ColumnDomain:
    """What classification says about one column."""

    column_name: str
    domain: str = "unknown"
    semantic_type: str | None = None
    subdomain: str | None = None


def _index(columns: Iterable[str]) -> dict[str, str]:
    columns = list(columns)
    index = {name.casefold(): name for name in columns}
    if len(index) != len(columns):
        raise BindingError("column names must differ by more than letter case")
    return index


def resolve_role(
    role: str,
    columns: Sequence[str],
    overrides: Mapping[str, str] | None = None,
    domains: Sequence[ColumnDomain] = (),
    aliases: Mapping[str, Sequence[str]] = ROLE_ALIASES,
    required: bool = False,
) -> str | None:
    """Column for a role: an override wins, then one semantic match, then the alias list."""
    index = _index(columns)
    override = {name.casefold(): column for name, column in (overrides or {}).items()}.get(role.casefold())
    if override is not None:
        if override.casefold() not in index:
            raise BindingError(f"override {override!r} is not a column")
        return index[override.casefold()]
    semantic = sorted(
        {
            index[item.column_name.casefold()]
            for item in domains
            if role.casefold() in {(name or "").casefold() for name in (item.semantic_type, item.domain, item.subdomain)}
            and item.column_name.casefold() in index
        }
    )
    if len(semantic) > 1:
        raise BindingError(f"role {role!r} matches several columns; name one")
    if semantic:
        return semantic[0]
    for alias in aliases.get(role, ()):
        if alias.casefold() in index:
            return index[alias.casefold()]
    if required:
        raise BindingError(f"no column found for role {role!r}")
    return None


def bind_roles(
    df: DataFrame,
    roles: Sequence[str],
    overrides: Mapping[str, str] | None = None,
    domains: Sequence[ColumnDomain] = (),
    aliases: Mapping[str, Sequence[str]] = ROLE_ALIASES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project the columns found for the roles, named after them, plus ``keep``."""
    bound = {role: resolve_role(role, df.columns, overrides, domains, aliases) for role in roles}
    chosen = [F.col(column).alias(role) for role, column in bound.items() if column is not None]
    return df.select(*keep, *chosen)


def bind_group_column(
    df: DataFrame,
    reference: str,
    overrides: Mapping[str, str] | None = None,
    domains: Sequence[ColumnDomain] = (),
    aliases: Sequence[str] = (),
    temporal: bool = False,
) -> str:
    """Column for a time, dimension or filter reference.

    Order: override, exact name, one semantic match, aliases; for time columns
    finally the only date-typed column there is.
    """
    index = _index(df.columns)
    token = reference.strip().casefold()
    override = {name.casefold(): column for name, column in (overrides or {}).items()}.get(token)
    if override is not None:
        if override.casefold() not in index:
            raise BindingError(f"override {override!r} is not a column")
        return index[override.casefold()]
    if token in index:
        return index[token]

    def fits(name: str) -> bool:
        return not temporal or isinstance(df.schema[name].dataType, TEMPORAL)

    semantic = sorted(
        index[item.column_name.casefold()]
        for item in domains
        if token in {(name or "").casefold() for name in (item.semantic_type, item.domain, item.subdomain)}
        and item.column_name.casefold() in index
    )
    semantic = [name for name in semantic if fits(name)]
    if len(semantic) > 1:
        raise BindingError(f"{reference!r} matches several columns; name one")
    if semantic:
        return semantic[0]
    for alias in aliases:
        if alias.casefold() in index and fits(index[alias.casefold()]):
            return index[alias.casefold()]
    if temporal:
        dated = [field.name for field in df.schema.fields if isinstance(field.dataType, TEMPORAL)]
        if len(dated) == 1:
            return dated[0]
    raise BindingError(f"no column found for {reference!r}")


def temporal_type(declared: str | None, semantic_type: str | None, domain: str | None) -> str | None:
    """Temporal type a column should have, from its dictionary entry and its domain."""
    declared, semantic, domain = ((text or "").casefold() for text in (declared, semantic_type, domain))
    if "timestamp" in declared or "datetime" in declared or "timestamp" in semantic:
        return "timestamp_ntz"
    if declared == "date" or semantic.endswith("_date") or domain == "interaction.time":
        return "date"
    return None


def apply_declared_temporal(
    df: DataFrame, declared: Mapping[str, str], domains: Sequence[ColumnDomain] = (), zone: str = "UTC"
) -> DataFrame:
    """Retype text columns that the dictionary or the domain calls dates or timestamps."""
    types = {name.casefold(): kind for name, kind in declared.items()}
    known = {item.column_name.casefold(): item for item in domains}
    retyped = {}
    for field in df.schema.fields:
        item = known.get(field.name.casefold())
        target = temporal_type(
            types.get(field.name.casefold()), item.semantic_type if item else None, item.domain if item else None
        )
        if target and isinstance(field.dataType, T.StringType):
            retyped[field.name] = dates.parse_iso(F.col(field.name), zone).cast(target)
    return df.withColumns(retyped) if retyped else df
