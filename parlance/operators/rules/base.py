"""What a rule is, and the tables rules produce.

A rule names its row conditions, its mergeable states and the metrics made from
them. Any rule written this way runs beside the built-in ones, in the same
aggregation, and its stored states can be merged across batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance import fixed_values as fixed
from parlance.operators import grouping as grp
from parlance.operators.grouping import Grouping, State
from parlance.sources.storage import materialize

METRIC_TYPE = (
    "struct<rule_id:string,row_count:bigint,eligible_count:bigint,passed_count:bigint,failed_count:bigint,"
    "skipped_count:bigint,metric_name:string,value:double,value_map:map<string,double>,unit:string,"
    "numerator:double,denominator:double,threshold:string,outcome:string>"
)
PASSED, WARNING, FAILED, NOT_EVALUATED = "passed", "warning", "failed", "not_evaluated"


@dataclass(frozen=True)
class Metric:
    name: str
    value: Column | None = None
    unit: str | None = None
    numerator: Column | None = None
    denominator: Column | None = None
    threshold: str | None = None
    outcome: Column | None = None
    value_map: Column | None = None


@dataclass(frozen=True)
class Rule:
    """A rule over one row's columns.

    ``metrics`` receives a lookup from state name to column and returns the
    metrics. ``passed`` may be None for rules that judge only distributions.
    """

    rule_id: str
    eligible: Column
    passed: Column | None
    metrics: Callable[[Callable[[str], Column]], Sequence[Metric]]
    states: Mapping[str, State] = field(default_factory=dict)
    failure_category: Column | None = None

    def all_states(self) -> dict[str, State]:
        own = {**grp.counters(self.eligible, self.passed), **self.states}
        return {f"{self.rule_id}__{name}": state for name, state in own.items()}

    def failed(self) -> Column:
        """True for rows that count as failures, never null."""
        if self.passed is None:
            return F.lit(False)
        return F.coalesce(self.eligible & ~self.passed, F.lit(False))

    def category(self) -> Column:
        return F.lit("rule_failure") if self.failure_category is None else self.failure_category


def threshold_outcome(value: Column, maximum: float) -> Column:
    """Passed up to the maximum, failed above it, not evaluated when null."""
    return F.when(value.isNull(), NOT_EVALUATED).when(value <= maximum, PASSED).otherwise(FAILED)


def separate_failing(df: DataFrame, rules: Sequence[Rule], grouping: Grouping) -> tuple[list[Rule], list[str]]:
    """Rules that can be planned over these rows, and the names of those that cannot; plans only, no job runs."""
    usable, failing = [], []
    for rule in rules:
        try:
            states = grp.measure(df, grouping, rule_states([rule]), keyed=True, limited=True)
            metric_table(states, [rule], grouping)
        except AnalysisException:
            failing.append(rule.rule_id)
        else:
            usable.append(rule)
    return usable, failing


def measure_apart(
    keyed: DataFrame, rules: Sequence[Rule], grouping: Grouping
) -> tuple[DataFrame, list[Rule], dict[str, str]]:
    """Stored partial states of all rules that run, those rules, and the error conditions of the others.

    All rules are tried in one pass. Only if that fails are they halved until the failing ones are found, so one bad rule
    among n costs some 2 log n further passes; a failure that is not a rule's own is raised. Errors are named by their
    condition, not their message, which may quote values. Categories of failures are tried along, since evidence reads them.
    """

    def attempt(chosen: Sequence[Rule]) -> DataFrame:
        states = rule_states(chosen)
        probes = {
            f"probe__{rule.rule_id}": count_if(F.coalesce(F.when(rule.failed(), rule.category()), F.lit("")) != "") for rule in chosen}
        return materialize(grp.partial_states(keyed, grouping, {**states, **probes}), "rule-states").select(
            grp.IN_GROUP, *grouping.keys, *states)

    failing: dict[str, str] = {}

    def running(chosen: Sequence[Rule]) -> tuple[list[Rule], DataFrame | None]:
        try:
            return list(chosen), attempt(chosen)
        except PySparkException as error:
            if len(chosen) <= 1:
                failing.update({rule.rule_id: error.getCondition() or type(error).__name__ for rule in chosen})
                return [], None
        half = len(chosen) // 2
        return running(chosen[:half])[0] + running(chosen[half:])[0], None

    usable, states = running(list(rules))
    return (attempt(usable) if states is None else states), usable, failing


def rule_states(rules: Sequence[Rule]) -> dict[str, State]:
    """States of several rules side by side, so that one aggregation computes all."""
    states = {"row_count": State("sum", F.lit(1).cast("bigint"))}
    for rule in rules:
        states.update(rule.all_states())
    return states


def measure_rules(df: DataFrame, rules: Sequence[Rule], grouping: Grouping) -> DataFrame:
    """States of all rules, overall and per group, in one pass over the rows."""
    return grp.measure(df, grouping, rule_states(rules))


def _metric_structs(rule: Rule, decimals: int | None) -> list[Column]:
    """The rule's metrics as structs; the cast to the standard type names the fields."""

    def state(name: str) -> Column:
        return F.col(f"{rule.rule_id}__{name}")

    no_number = F.lit(None).cast("double")
    no_map = F.lit(None).cast("map<string,double>")

    def number(column: Column | None) -> Column:
        return no_number if column is None else column.cast("double")

    def rounded(column: Column) -> Column:
        return column if decimals is None else F.bround(column, decimals)

    def value_map(column: Column | None) -> Column:
        if column is None or decimals is None:
            return no_map if column is None else column
        return F.transform_values(column, lambda _, value: F.bround(value, decimals))

    counts = [state(name) for name in ("row_count", "eligible_count", "passed_count", "failed_count")]
    shared = [F.lit(rule.rule_id), *counts, counts[0] - counts[1]]
    return [
        F.struct(
            *shared,
            F.lit(metric.name),
            rounded(number(metric.value)),
            value_map(metric.value_map),
            F.lit(metric.unit),
            number(metric.numerator),
            number(metric.denominator),
            F.lit(metric.threshold),
            F.lit(NOT_EVALUATED) if metric.outcome is None else metric.outcome,
        ).cast(METRIC_TYPE)
        for metric in rule.metrics(state)
    ]


def metric_table(
    states: DataFrame, rules: Sequence[Rule], grouping: Grouping, decimals: int | None = fixed.RESULT_DECIMALS
) -> DataFrame:
    """The standard long table: one row per rule, group and metric.

    All metrics leave one array per group, so the states are computed once.
    """
    structs = [struct for rule in rules for struct in _metric_structs(rule, decimals)]
    period = F.col(grp.PERIOD) if grp.PERIOD in grouping.keys else F.lit(None).cast("string")
    pairs = [part for name in grouping.dimensions for part in (F.lit(name), F.col(name))]
    dims = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return states.select(
        "is_overall",
        period.alias("time_period"),
        F.when(F.col("is_overall"), F.create_map().cast("map<string,string>")).otherwise(dims).alias("dims"),
        F.inline(F.array(*structs).cast(f"array<{METRIC_TYPE}>")),
    ).select("rule_id", "is_overall", "time_period", "dims", *[
        "row_count", "eligible_count", "passed_count", "failed_count", "skipped_count", "metric_name", "value",
        "value_map", "unit", "numerator", "denominator", "threshold", "outcome",
    ])


def measured_name(name: str) -> str:
    """Identifier of a rule given by its own or its reporting name, however it is spelled."""
    spelled = name.strip().casefold().replace("-", "_").replace(" ", "_")
    known = {reported: measured for measured, reported in fixed.REPORTING_NAMES.items()}
    if spelled in known:
        return known[spelled]
    if spelled in fixed.REPORTING_NAMES:
        return spelled
    raise ValueError(f"unknown rule {name!r}")


def select_rules(rules: Sequence[Rule], names: Sequence[str]) -> list[Rule]:
    """The rules asked for, in their own order."""
    wanted = {measured_name(name) for name in names}
    return [rule for rule in rules if rule.rule_id in wanted]


def run_rules(
    df: DataFrame, rules: Sequence[Rule], grouping: Grouping, decimals: int | None = fixed.RESULT_DECIMALS
) -> DataFrame:
    """Metrics of several rules over one frame of rows."""
    return metric_table(measure_rules(df, rules, grouping), rules, grouping, decimals)


def sum_of(column: Column) -> State:
    return State("sum", column)


def count_if(condition: Column) -> State:
    return State("sum", F.when(condition, 1).otherwise(0).cast("bigint"))


def counts_map(named: Mapping[str, Column]) -> Column:
    """Category to count, leaving out categories that did not occur."""
    pairs = [part for name, count in named.items() for part in (F.lit(name), count.cast("double"))]
    if not pairs:
        return F.create_map().cast("map<string,double>")
    return F.map_filter(F.create_map(*pairs), lambda _, count: count > 0)
