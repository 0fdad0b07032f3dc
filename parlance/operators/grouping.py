"""Group keys, and states that can be merged.

A measure is a set of mergeable states (sums, minima, maxima). Rows are reduced
once, to one state per group; the overall result and every later roll-up are
made from those few states, so no row is ever duplicated for grouping sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance import fixed_values as fixed
from parlance.functions import dates
from parlance.functions import text as tx
from parlance.operators.columns import require_allowed, typed

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
IN_GROUP = "in_group"
PERIOD = "time_period"


class GroupLimitError(ValueError):
    """More groups were observed than the caller allows."""


@dataclass(frozen=True)
class State:
    """One mergeable aggregate: how to merge it, and its value per row."""

    merge: str
    column: Column


@dataclass(frozen=True)
class Grouping:
    """What to group by and what to do with rows that do not fit.

    ``dimensions`` maps output names to columns. Policies: ``invalid_time`` is
    unknown, exclude or fail; ``null_dimension`` is include, exclude or fail;
    ``overflow`` is reject or other.
    """

    time_column: str | None = None
    grain: str = "month"
    dimensions: Mapping[str, str] = field(default_factory=dict)
    zone: str = "UTC"
    invalid_time: str = "unknown"
    null_dimension: str = "include"
    overflow: str = "reject"
    maximum_groups: int = fixed.MAXIMUM_GROUPS
    include_overall: bool = True
    unknown_time: str = fixed.UNKNOWN_TIME
    unknown_value: str = fixed.UNKNOWN_VALUE
    other_value: str = fixed.OTHER_VALUE

    def __post_init__(self) -> None:
        if len(self.dimensions) > fixed.MAXIMUM_DIMENSIONS:
            raise ValueError("too many dimensions")
        if self.invalid_time not in ("unknown", "exclude", "fail"):
            raise ValueError("unknown invalid_time policy")
        if self.null_dimension not in ("include", "exclude", "fail"):
            raise ValueError("unknown null_dimension policy")
        if self.overflow not in ("reject", "other"):
            raise ValueError("unknown overflow policy")

    @property
    def keys(self) -> list[str]:
        timed = [PERIOD] if self.time_column and self.grain != "none" else []
        return timed + list(self.dimensions)


def dimension_value(column: Column, data_type: T.DataType) -> Column:
    """A dimension as text: NaN and infinities are null, a blank string is a value."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        column = tx.safe_scalar(column)
    return column.cast("string")


def group_keys(df: DataFrame, grouping: Grouping) -> DataFrame:
    """Add the time bucket, the dimensions and ``in_group`` to every row.

    Rows that a policy excludes keep ``in_group`` false: they still count in the
    overall result but in no group.
    """
    require_allowed(df, [grouping.time_column, *grouping.dimensions.values()])
    derived: dict[str, Column] = {}
    fits = F.lit(bool(grouping.keys))
    if PERIOD in grouping.keys:
        moment = dates.wall_clock(*typed(df, grouping.time_column, grouping.zone), grouping.zone)
        period = dates.bucket(moment, grouping.grain)
        if grouping.invalid_time == "unknown":
            period = F.coalesce(period, F.lit(grouping.unknown_time))
        elif grouping.invalid_time == "exclude":
            fits = fits & period.isNotNull()
        else:
            period = F.coalesce(period, F.raise_error(F.lit("a timestamp could not be parsed")).cast("string"))
        derived[PERIOD] = period
    for name, source in grouping.dimensions.items():
        value = dimension_value(*typed(df, source, grouping.zone))
        if grouping.null_dimension == "include":
            value = F.coalesce(value, F.lit(grouping.unknown_value))
        elif grouping.null_dimension == "exclude":
            fits = fits & value.isNotNull()
        else:
            value = F.coalesce(value, F.raise_error(F.lit("a null dimension was found")).cast("string"))
        derived[name] = value
    keyed = {name: F.when(fits, value) for name, value in derived.items()}
    return df.withColumns({**keyed, IN_GROUP: fits})


def kept_groups(df: DataFrame, grouping: Grouping) -> DataFrame | None:
    """Keys of the largest groups of keyed rows or partial states, or None if all fit; fewer than the limit.

    Raises if there are too many groups and the policy is to reject them.
    """
    keys = grouping.keys
    if not keys:
        return None
    weight = F.sum("row_count") if "row_count" in df.columns else F.count(F.lit(1))
    sizes = df.where(IN_GROUP).groupBy(*keys).agg(weight.alias("rows_in_group"))
    observed = sizes.limit(grouping.maximum_groups + 1).count()
    if observed <= grouping.maximum_groups:
        return None
    if grouping.overflow == "reject":
        raise GroupLimitError(f"more than {grouping.maximum_groups} groups")
    return (
        sizes.orderBy(F.desc("rows_in_group"), *keys)
        .limit(max(0, grouping.maximum_groups - 1))
        .select(*[F.col(key).alias("kept_" + key) for key in keys])
        .withColumn("is_kept", F.lit(True))
    )


def fold_groups(df: DataFrame, grouping: Grouping, kept: DataFrame | None, is_grouped: Column | None = None) -> DataFrame:
    """Give rows of groups that are not kept the keys of the one group for all others."""
    if kept is None:
        return df
    is_grouped = F.col(IN_GROUP) if is_grouped is None else is_grouped
    same = [df[key].eqNullSafe(kept["kept_" + key]) for key in grouping.keys]
    joined = df.join(F.broadcast(kept), same, "left")
    folded = {
        key: F.when(
            is_grouped & F.col("is_kept").isNull(),
            F.lit(fixed.OTHER_TIME if key == PERIOD else grouping.other_value),
        ).otherwise(F.col(key))
        for key in grouping.keys
    }
    return joined.withColumns(folded).select(*df.columns)


def limit_groups(df: DataFrame, grouping: Grouping) -> DataFrame:
    """Enforce the group limit on keyed rows or on partial states.

    ``reject`` raises; ``other`` keeps the largest groups and folds the rest into
    one. The kept keys number fewer than the limit, which bounds the broadcast.
    """
    return fold_groups(df, grouping, kept_groups(df, grouping))


def partial_states(df: DataFrame, grouping: Grouping, states: Mapping[str, State]) -> DataFrame:
    """One row of states per group of a keyed frame; a map-side reduction of the rows."""
    aggregates = [MERGE[state.merge](state.column).alias(name) for name, state in states.items()]
    return df.groupBy(IN_GROUP, *grouping.keys).agg(*aggregates)


def merge_states(partials: DataFrame, grouping: Grouping, merges: Mapping[str, str]) -> DataFrame:
    """Add up states of the same group, for example those of several batches."""
    aggregates = [MERGE[merge](name).alias(name) for name, merge in merges.items()]
    return partials.groupBy(IN_GROUP, *grouping.keys).agg(*aggregates)


def roll_up(partials: DataFrame, grouping: Grouping, merges: Mapping[str, str]) -> DataFrame:
    """Overall result and groups, in one grouping-sets aggregate over the few states."""
    aggregates = [MERGE[merge](name).alias(name) for name, merge in merges.items()]
    keys = [IN_GROUP, *grouping.keys]
    sets = [[F.col(key) for key in keys]] if grouping.keys else []
    if grouping.include_overall:
        sets.append([])
        partials = partials.unionByName(_nothing(partials, merges))
    rolled = partials.groupingSets(sets, *keys).agg(
        (F.grouping_id() > 0).alias("is_overall") if grouping.include_overall else F.lit(False).alias("is_overall"),
        *aggregates,
    )
    return rolled.where(F.col("is_overall") | F.col(IN_GROUP)).drop(IN_GROUP)


def _nothing(partials: DataFrame, merges: Mapping[str, str]) -> DataFrame:
    """A state of no rows, outside every group: it gives an overall result to a frame without rows."""
    values = {IN_GROUP: False} | {name: 0 for name, merge in merges.items() if merge == "sum"}
    return partials.sparkSession.range(1).select(*[
        F.lit(values.get(field.name)).cast(field.dataType).alias(field.name) for field in partials.schema.fields
    ])


def measure(
    df: DataFrame, grouping: Grouping, states: Mapping[str, State], keyed: bool = False, limited: bool = False
) -> DataFrame:
    """Overall and grouped states of a frame; ``keyed`` and ``limited`` tell what was done before."""
    partials = partial_states(df if keyed else group_keys(df, grouping), grouping, states)
    if not limited:
        partials = limit_groups(partials, grouping)
    return roll_up(partials, grouping, {name: state.merge for name, state in states.items()})


def counters(eligible: Column, passed: Column | None) -> dict[str, State]:
    """Row, eligible, passed and failed counts; rows neither passed nor failed are only eligible."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    eligible = F.coalesce(eligible, F.lit(False))
    passed = F.lit(None).cast("boolean") if passed is None else passed
    return {
        "row_count": State("sum", one),
        "eligible_count": State("sum", F.when(eligible, one).otherwise(zero)),
        "passed_count": State("sum", F.when(eligible & passed, one).otherwise(zero)),
        "failed_count": State("sum", F.when(eligible & ~passed, one).otherwise(zero)),
    }


def moments(name: str, value: Column) -> dict[str, State]:
    """Count, sum, minimum, maximum of finite values, and the number of unusable ones."""
    finite = tx.safe_scalar(value.cast("double"))
    return {
        f"{name}_count": State("sum", F.when(finite.isNotNull(), 1).otherwise(0).cast("bigint")),
        f"{name}_sum": State("sum", finite),
        f"{name}_min": State("min", finite),
        f"{name}_max": State("max", finite),
        f"{name}_invalid": State("sum", F.when(finite.isNull(), 1).otherwise(0).cast("bigint")),
    }


def category_counts(
    counts: DataFrame,
    keys: Sequence[str],
    category: str,
    weight: str,
    limit: int = fixed.CATEGORIES_PER_GROUP,
) -> DataFrame:
    """Largest categories of each group, the tail summed into one overflow row.

    ``counts`` holds one row per (keys, category). Ranking keeps ``limit`` rows
    per group and partition before the shuffle, so a group with very many
    categories never lands in one task; the tail is total minus kept, exactly.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(weight), category)
    kept = counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    totals = counts.groupBy(*keys).agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("categories"))
    kept_totals = kept.groupBy(*keys).agg(F.sum(weight).alias("kept_total"))
    same = [totals[key].eqNullSafe(kept_totals[key]) for key in keys]
    overflow = (
        totals.where(F.col("categories") > limit)
        .join(kept_totals, same, "inner")
        .select(
            *[totals[key] for key in keys],
            F.lit(fixed.OTHER_VALUE).alias(category),
            (F.col("total") - F.col("kept_total")).alias(weight),
            F.lit(limit + 1).alias("position"),
        )
    )
    return kept.select(*keys, category, weight, "position").unionByName(overflow)


def group_order(df: DataFrame, grouping: Grouping) -> DataFrame:
    """Overall first, then periods, then dimensions."""
    return df.orderBy(F.desc("is_overall"), *[F.asc_nulls_first(key) for key in grouping.keys])
