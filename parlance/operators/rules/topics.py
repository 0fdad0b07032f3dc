"""Topic mix per group, and its drift from one period to the next.

Topics are rows until the last step: counts per (group, category) are reduced
before every shuffle, and only the capped result of a group becomes a map.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance import fixed_values as fixed
from parlance.functions import drift, ramps
from parlance.functions import text as tx
from parlance.operators import grouping as grp
from parlance.operators.grouping import Grouping, State
from parlance.operators.rules import base
from parlance.operators.rules.base import Metric, Rule

RULE_ID = "topic_distribution"
Ontology = Sequence[tuple[int, str, Sequence[str]]]


class TopicTables(NamedTuple):
    """States of every group with a capped category map, and the uncapped counts by group and category."""

    states: DataFrame
    counts: DataFrame


def preferred_topic_column(targets: Sequence[str], aliases: Sequence[str]) -> str:
    """First alias found among the targets, else the first target."""
    by_name = {name.casefold(): name for name in targets}
    return next((by_name[alias.casefold()] for alias in aliases if alias.casefold() in by_name), targets[0])


def topic_partials(
    keyed: DataFrame,
    topic: str,
    grouping: Grouping,
    ontology: Ontology = (),
    fallback: str = fixed.TOPIC_FALLBACK,
    delimiters: str = fixed.TOPIC_DELIMITERS,
) -> DataFrame:
    """Mergeable states of keyed rows: topic counts by group and category, and each group's rows under a null category.

    Rows are counted by distinct cell of a group first, so splitting and mapping run once for each of these. States of several
    batches add up (`merge_topic_partials`), and groups can still be folded afterwards.
    """
    keys = [grp.IN_GROUP, *grouping.keys]
    cells = keyed.groupBy(*keys, F.col(topic).cast("string").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    is_filled = tx.present(F.col("cell"))
    rows = F.struct(
        F.lit(None).cast("string").alias("part"), F.col("n").alias("row_count"),
        F.when(is_filled, F.col("n")).otherwise(zero).alias("filled_count"), zero.alias("topic_count"))
    named = F.transform(
        F.when(is_filled, tx.split_topics(F.col("cell"), delimiters)),
        lambda part: F.struct(part.alias("part"), zero.alias("row_count"), zero.alias("filled_count"), F.col("n").alias("topic_count")))
    each = cells.select(*keys, F.inline(F.concat(F.array(rows), F.coalesce(named, F.array()))))
    category = F.when(F.col("part").isNotNull(), tx.topic_category(F.col("part"), ontology, fallback))
    return merge_topic_partials(each.withColumn("category", category), grouping)


def merge_topic_partials(partials: DataFrame, grouping: Grouping) -> DataFrame:
    """Add up the states of a category, for example those of several batches."""
    counts = ("row_count", "filled_count", "topic_count")
    return partials.groupBy(grp.IN_GROUP, *grouping.keys, "category").agg(*[F.sum(name).alias(name) for name in counts])


def topic_states(
    df: DataFrame,
    topic: str,
    grouping: Grouping,
    ontology: Ontology = (),
    fallback: str = fixed.TOPIC_FALLBACK,
    delimiters: str = fixed.TOPIC_DELIMITERS,
    limit: int = fixed.CATEGORIES_PER_GROUP,
) -> TopicTables:
    """Counters and the capped category map of every group, and all categories as rows."""
    return topic_tables(topic_partials(grp.group_keys(df, grouping), topic, grouping, ontology, fallback, delimiters), grouping, limit)


def topic_tables(partials: DataFrame, grouping: Grouping, limit: int = fixed.CATEGORIES_PER_GROUP) -> TopicTables:
    """The tables of merged states: groups are limited, then rolled up."""
    limited = grp.limit_groups(partials, grouping)
    filled, zero = F.col("filled_count"), F.lit(0).cast("bigint")
    counts = {"row_count": F.col("row_count"), "eligible_count": filled, "passed_count": zero, "failed_count": zero}
    states = {f"{RULE_ID}__{name}": State("sum", column) for name, column in counts.items()}
    counters = grp.measure(limited, grouping, states, keyed=True, limited=True)
    keys = ["is_overall", *grouping.keys]
    sets = [[F.col(key) for key in (grp.IN_GROUP, *grouping.keys, "category")]] if grouping.keys else []
    if grouping.include_overall:
        sets.append([F.col("category")])
    rolled = limited.where(F.col("category").isNotNull()).groupingSets(sets, grp.IN_GROUP, *grouping.keys, "category").agg(
        (F.grouping_id() > 0).alias("is_overall"), F.sum("topic_count").alias("topic_count")
    )
    counted = rolled.where(F.col("is_overall") | F.col(grp.IN_GROUP)).drop(grp.IN_GROUP)
    capped = grp.category_counts(counted, keys, "category", "topic_count", limit)
    distinct = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_topics")).toDF(
        *[f"distinct_{key}" for key in keys], "distinct_topics")
    entry = F.struct(F.col("category"), F.col("topic_count").cast("bigint"))
    distribution = capped.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("distribution"),
        F.max(F.when(F.col("position") <= limit, F.col("topic_count"))).alias("dominant_count"),
    )
    same = [counters[key].eqNullSafe(distribution[key]) for key in keys]
    same_distinct = [counters[key].eqNullSafe(distinct[f"distinct_{key}"]) for key in keys]
    states_of = counters.join(distribution, same, "left").join(distinct, same_distinct, "left").select(
        *[counters[key] for key in keys],
        *[counters[name] for name in states],
        F.coalesce("distribution", F.create_map().cast("map<string,bigint>")).alias("distribution"),
        F.coalesce("dominant_count", F.lit(0)).alias("dominant_count"),
        F.coalesce("distinct_topics", F.lit(0)).alias("distinct_lower_bound"),
    )
    return TopicTables(states_of, counted)


def topic_drift(tables: TopicTables, grouping: Grouping, epsilon: float = fixed.DRIFT_EPSILON) -> DataFrame:
    """Each period's distance from the period observed before it, per dimension tuple.

    Counts of the two periods meet as rows, one per category, so no group's categories are gathered or cut off. The
    buckets for unknown and folded times are no periods and take no part.
    """
    states, counts = tables
    dims = list(grouping.dimensions)
    keys = [*dims, grp.PERIOD]
    # Dimensions are text; without any, all periods form one short series.
    order = Window.partitionBy(*([F.col(name) for name in dims] or [F.col("is_overall")])).orderBy(grp.PERIOD)
    timed = states.where(~F.col("is_overall") & ~F.col(grp.PERIOD).isin(grouping.unknown_time, fixed.OTHER_TIME))
    paired = timed.withColumn("previous_period", F.lag(grp.PERIOD).over(order)).where(F.col("previous_period").isNotNull())
    pairs = paired.select(*[F.col(name).alias(f"pair_{name}") for name in keys], "previous_period")
    grouped = counts.where(~F.col("is_overall"))

    def side(period: str, name: str) -> DataFrame:
        """Counts of one side of every pair, under the keys of its later period."""
        same = [grouped[dim].eqNullSafe(pairs[f"pair_{dim}"]) for dim in dims] + [grouped[grp.PERIOD] == pairs[period]]
        zero = F.lit(0).cast("bigint")
        found = {side: F.col("topic_count") if side == name else zero for side in ("before", "after")}
        return grouped.join(pairs, same).select(
            *[F.col(f"pair_{key}").alias(key) for key in keys], "category", *[value.alias(side) for side, value in found.items()]
        )

    met = side("previous_period", "before").union(side(f"pair_{grp.PERIOD}", "after")).groupBy(*keys, "category").agg(
        F.sum("before").alias("before"), F.sum("after").alias("after"))
    totals = met.groupBy(*keys).agg(
        F.sum("before").alias("all_before"), F.sum("after").alias("all_after"), F.count(F.lit(1)).alias("categories")
    ).toDF(*[f"total_{key}" for key in keys], "all_before", "all_after", "categories")
    shares = met.join(totals, [met[key].eqNullSafe(totals[f"total_{key}"]) for key in keys]).select(
        *keys,
        *[drift.smoothed_share(F.col(name), F.col(f"all_{name}"), F.col("categories"), epsilon).alias(share)
          for name, share in (("before", "p"), ("after", "q"))],
    )
    p, q = F.col("p"), F.col("q")
    distances = shares.groupBy(*keys).agg(
        F.sum(drift.jensen_shannon_term(p, q)).alias("jensen_shannon_divergence"),
        F.sum(drift.population_stability_term(p, q)).alias("population_stability_index"),
        F.max(drift.cohen_h(p, q)).alias("maximum_cohen_h"),
    )
    measured = ("jensen_shannon_divergence", "population_stability_index", "maximum_cohen_h")
    same = [paired[key].eqNullSafe(distances[key]) for key in keys]
    return paired.join(distances, same, "left").select(
        *[paired[name] for name in states.columns], "previous_period",
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name in measured],
    )


def _distribution_metrics(maximum_share: float, minimum_distinct: int):
    share = F.coalesce(ramps.ratio(F.col("dominant_count"), F.col(f"{RULE_ID}__eligible_count")), F.lit(0.0))
    distinct = F.col("distinct_lower_bound")
    outcome = F.when((share <= maximum_share) & (distinct >= minimum_distinct), base.PASSED).otherwise(base.FAILED)
    as_double = F.transform_values(F.col("distribution"), lambda _, count: count.cast("double"))
    return [
        Metric("dominant_topic_share", share, "ratio", F.col("dominant_count"), F.col(f"{RULE_ID}__eligible_count"),
               f"<={maximum_share}", outcome),
        Metric("distinct_topic_count_lower_bound", distinct, "count", threshold=f">={minimum_distinct}", outcome=outcome),
        Metric("topic_distribution", None, "count", value_map=as_double),
    ]


def _drift_metrics():
    divergence = F.col("jensen_shannon_divergence")
    outcome = (
        F.when(divergence < fixed.DRIFT_STABLE_BELOW, base.PASSED)
        .when(divergence < fixed.DRIFT_SIGNIFICANT_FROM, base.WARNING).otherwise(base.FAILED)
    )
    return [
        Metric("jensen_shannon_divergence", divergence, "divergence",
               threshold=f"stable<{fixed.DRIFT_STABLE_BELOW}, significant>={fixed.DRIFT_SIGNIFICANT_FROM}", outcome=outcome),
        Metric("population_stability_index", F.col("population_stability_index"), "index", threshold="low<0.1, high>=0.25"),
        Metric("maximum_cohen_h", F.col("maximum_cohen_h"), "effect_size", threshold="small<0.2, medium<0.5, large<0.8"),
    ]


def topic_metrics(
    tables: TopicTables,
    grouping: Grouping,
    maximum_share: float = fixed.DOMINANT_TOPIC_MAXIMUM,
    minimum_distinct: int = fixed.MINIMUM_DISTINCT_TOPICS,
    decimals: int | None = fixed.RESULT_DECIMALS,
) -> DataFrame:
    """Distribution metrics of every group and, for timed groups, drift metrics."""
    mixed = Rule(RULE_ID, F.lit(True), None, lambda state: _distribution_metrics(maximum_share, minimum_distinct))
    table = base.metric_table(tables.states, [mixed], grouping, decimals)
    if grp.PERIOD not in grouping.keys:
        return table
    drifting = Rule(RULE_ID, F.lit(True), None, lambda state: _drift_metrics())
    return table.unionByName(base.metric_table(topic_drift(tables, grouping), [drifting], grouping, decimals))


