"""Queries over filters, grouping, time buckets and completeness."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from harness import tables as tb
from parlance.functions import dates
from parlance.functions import text as tx
from parlance.operators import columns
from parlance.operators import grouping as grp
from parlance.operators.filters import Filter, apply_filters
from parlance.operators.grouping import Grouping
from parlance.operators.rules import base, fill_rate

TARGETS = ("event_type", "value", "props")
BY_MONTH = Grouping("ts", "month", {"event_type": "event_type"})


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def declared_date_as_text(spark, folder):
    """Order dates held as text, some of them no dates, filtered and grouped by what they are declared to be."""
    text = "case when o_orderkey % 11 = 0 then 'soon' else cast(o_orderdate as string) end"
    orders = tb.load(spark, folder, "orders").selectExpr("o_orderkey", f"{text} as placed")
    noted = columns.annotated(orders, "orders", declared={"PLACED": "Date"})
    grouping = Grouping("placed", "quarter", {"day": "placed"})
    kept = apply_filters(noted, [Filter("placed", "greater_than_or_equal", (datetime.date(1995, 3, 1),)), Filter("placed", "less_than", (datetime.date(1996, 3, 1),))])
    measured = grp.measure(kept, grouping, grp.counters(F.lit(True), None))
    return measured.select("is_overall", "time_period", "day", "row_count")


DECLARED_DATE_SQL = """
select grouping(day) = 1 as is_overall, year(day) || '-Q' || quarter(day) as time_period, cast(day as varchar) as day, count(*) as row_count
from (select cast(o_orderdate as date) as day from orders where o_orderkey % 11 <> 0 and cast(o_orderdate as date) >= '1995-03-01' and cast(o_orderdate as date) < '1996-03-01')
group by grouping sets ((), (day))
"""


# ---- completeness -------------------------------------------------------------


def fill_rate_by_month(spark, folder):
    df = tb.events_fill(spark, folder)
    table = base.run_rules(df, [fill_rate.fill_rate_rule(df, TARGETS)], BY_MONTH, decimals=None)
    return table.where(F.col("metric_name") == "fill_rate").select(
        "rule_id", "is_overall", "time_period", F.try_element_at("dims", F.lit("event_type")).alias("event_type"),
        "row_count", "eligible_count", "passed_count", "failed_count", "skipped_count", "value", "numerator",
        "denominator", "outcome",
    )


FILLED_SQL = {
    "event_type": "(event_type is not null and lower(trim(event_type)) not in ('','null','none','nan','n/a','na','not available'))",
    "value": "(value is not null and not isnan(value) and not isinf(value))",
    "props": "(props is not null and lower(trim(props)) not in ('','null','none','nan','n/a','na','not available'))",
}
FILL_BASE_SQL = f"""
fx as ({tb.sql(tb.EVENTS_FILL, "events")}),
cells as (
  select strftime(ts, '%Y-%m') as time_period, event_type,
         {', '.join(f"cast({sql} as int) as f_{name}" for name, sql in FILLED_SQL.items())}
  from fx),
g as (
  select grouping(time_period) = 1 as is_overall, time_period, event_type, count(*) as row_count,
         {', '.join(f"cast(sum(f_{name}) as bigint) as f_{name}" for name in TARGETS)},
         count(*) filter (where f_event_type + f_value + f_props = 3) as passed_count
  from cells group by grouping sets ((), (time_period, event_type)))
"""
FILL_RATE_SQL = f"""
with {FILL_BASE_SQL}
select 'fill_rate' as rule_id, is_overall, time_period, event_type, row_count, row_count as eligible_count, passed_count,
       row_count - passed_count as failed_count, cast(0 as bigint) as skipped_count,
       (f_event_type + f_value + f_props) / cast(row_count * 3 as double) as value,
       cast(f_event_type + f_value + f_props as double) as numerator, cast(row_count * 3 as double) as denominator,
       case when (f_event_type + f_value + f_props) / cast(row_count * 3 as double) >= 0.9 then 'passed'
            when (f_event_type + f_value + f_props) / cast(row_count * 3 as double) > 0.7 then 'warning' else 'failed' end as outcome
from g
"""


def fill_rate_columns(spark, folder):
    df = tb.events_fill(spark, folder)
    states = base.measure_rules(df, [fill_rate.fill_rate_rule(df, TARGETS)], BY_MONTH)
    return fill_rate.fill_rate_by_column(states, TARGETS, BY_MONTH)


FILL_COLUMNS_SQL = f"with {FILL_BASE_SQL}" + " union all ".join(
    f"""
select is_overall, time_period, event_type, row_count as total, '{name}' as column_name, f_{name} as filled,
       row_count - f_{name} as missing, f_{name} / cast(row_count as double) as fill_rate,
       case when f_{name} / cast(row_count as double) >= 0.9 then 'pass'
            when f_{name} / cast(row_count as double) > 0.7 then 'warn' else 'fail' end as status
from g"""
    for name in TARGETS
)


# ---- time buckets ----------------------------------------------------------------


def time_bucket_counts(spark, folder):
    orders = tb.load(spark, folder, "orders").select("o_orderdate")
    events = tb.load(spark, folder, "events").select("ts")

    def each(df, name, source):
        moment = dates.wall_clock(F.col(source), df.schema[source].dataType)
        grains = [F.struct(F.lit(g).alias("grain"), dates.bucket(moment, g).alias("time_period")) for g in dates.GRAINS[1:]]
        return df.select(F.lit(name).alias("table_name"), F.inline(F.array(*grains)))

    return (
        each(orders, "orders", "o_orderdate").unionByName(each(events, "events", "ts"))
        .groupBy("table_name", "grain", "time_period").agg(F.count(F.lit(1)).alias("row_count"))
    )


def _bucket_sql(table: str, column: str) -> str:
    labels = {
        "day": f"strftime({column}, '%Y-%m-%d')",
        "week": f"strftime(date_trunc('week', {column}), '%Y-%m-%d') || '/P7D'",
        "month": f"strftime({column}, '%Y-%m')",
        "quarter": f"strftime({column}, '%Y') || '-Q' || quarter({column})",
        "year": f"strftime({column}, '%Y')",
    }
    return " union all ".join(
        f"select '{table}' as table_name, '{grain}' as grain, {label} as time_period, count(*) as row_count from {table} group by 3"
        for grain, label in labels.items()
    )


def _timed(policy):
    def query(spark, folder):
        df = tb.events_bad_time(spark, folder)
        grouping = Grouping("moment", "week", {"event_type": "event_type"}, invalid_time=policy, null_dimension=policy_for[policy])
        states = {**grp.counters(F.lit(True), None), **grp.moments("cents", F.col("cents"))}
        return grp.measure(df, grouping, states).select(
            "is_overall", "time_period", "event_type", "row_count", F.col("cents_sum").cast("bigint").alias("cents_sum"),
            "cents_min", "cents_max",
        )

    return query


policy_for = {"unknown": "include", "exclude": "exclude"}
_BAD_TIME = f"""
fx as ({tb.sql(tb.EVENTS_BAD_TIME, "events")}),
k as (select strftime(date_trunc('week', try_cast(moment as timestamp)), '%Y-%m-%d') || '/P7D' as time_period, event_type, cents from fx)
"""
TIME_UNKNOWN_SQL = f"""
with {_BAD_TIME},
f as (select coalesce(time_period, '__UNKNOWN_TIME__') as time_period, coalesce(event_type, '__UNKNOWN__') as event_type, cents from k)
select grouping(time_period) = 1 as is_overall, time_period, event_type, count(*) as row_count, cast(sum(cents) as bigint) as cents_sum,
       cast(min(cents) as double) as cents_min, cast(max(cents) as double) as cents_max
from f group by grouping sets ((), (time_period, event_type))
"""
TIME_EXCLUDE_SQL = f"""
with {_BAD_TIME}
select true as is_overall, null::varchar as time_period, null::varchar as event_type, count(*) as row_count,
       cast(sum(cents) as bigint) as cents_sum, cast(min(cents) as double) as cents_min, cast(max(cents) as double) as cents_max from k
union all
select false, time_period, event_type, count(*), cast(sum(cents) as bigint), cast(min(cents) as double), cast(max(cents) as double)
from k where time_period is not null and event_type is not null group by 2, 3
"""


def parsed_timestamps(spark, folder):
    df = tb.load(spark, folder, "events").select(
        "event_id",
        F.expr(
            "case event_id % 6 when 0 then cast(ts as string) when 1 then date_format(ts, 'yyyyMMdd') "
            "when 2 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00') when 3 then date_format(ts, 'yyyy') "
            "when 4 then concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm\"), 'Z') else concat('x', event_id) end"
        ).alias("raw"),
    )
    parsed = dates.parse_iso(F.col("raw"), "UTC")
    return df.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("moment"), parsed.isNull().alias("invalid"))


PARSED_SQL = """
with t as (
  select event_id, case event_id % 6 when 0 then ts when 1 then date_trunc('day', ts) when 2 then date_trunc('second', ts) - interval 2 hour
         when 4 then date_trunc('minute', ts) else null end as moment from events)
select event_id, strftime(moment, '%Y-%m-%d %H:%M:%S') as moment, moment is null as invalid from t
"""


# ---- group limits, moments, categories ----------------------------------------------


def group_overflow(spark, folder):
    orders = tb.load(spark, folder, "orders").select("o_custkey", "o_orderdate", cents("o_totalprice").alias("cents"))
    grouping = Grouping("o_orderdate", "year", {"customer": "o_custkey"}, overflow="other", maximum_groups=50)
    states = {**grp.counters(F.lit(True), None), "cents": grp.State("sum", F.col("cents"))}
    return grp.measure(orders, grouping, states).select("is_overall", "time_period", "customer", "row_count", "cents")


GROUP_OVERFLOW_SQL = """
with k as (select strftime(o_orderdate, '%Y') as time_period, cast(o_custkey as varchar) as customer, cast(round(o_totalprice * 100) as bigint) as cents from orders),
top as (select time_period, customer from k group by 1, 2 order by count(*) desc, 1, 2 limit 49),
f as (select case when top.customer is null then '__OTHER_TIME__' else k.time_period end as time_period,
             case when top.customer is null then '__OTHER__' else k.customer end as customer, cents
      from k left join top using (time_period, customer))
select grouping(time_period) = 1 as is_overall, time_period, customer, count(*) as row_count, cast(sum(cents) as bigint) as cents
from f group by grouping sets ((), (time_period, customer))
"""


def numeric_moments(spark, folder):
    df = tb.load(spark, folder, "events").select(
        "event_type",
        F.expr(
            "case when event_id % 31 = 0 then double('NaN') when event_id % 37 = 0 then double('Infinity') "
            "when event_id % 41 = 0 then null else round(value * 100) end"
        ).alias("v"),
    )
    grouping = Grouping(dimensions={"event_type": "event_type"}, grain="none")
    states = {
        **grp.counters(F.lit(True), None),
        **grp.moments("v", F.col("v")),
        "infinite": base.count_if(tx.is_infinite(F.col("v"))),
    }
    measured = grp.measure(df, grouping, states)
    return measured.select(
        "is_overall", "event_type", "v_count", F.col("v_sum").cast("bigint").alias("v_sum"), "v_min", "v_max",
        (F.col("v_sum") / F.col("v_count")).alias("v_mean"), "v_invalid", "infinite",
    )


MOMENTS_SQL = """
with t as (select event_type, event_id, case when event_id % 31 = 0 or event_id % 37 = 0 or event_id % 41 = 0 then null else round(value * 100) end as v from events)
select grouping(event_type) = 1 as is_overall, event_type, count(v) as v_count, cast(sum(v) as bigint) as v_sum, min(v) as v_min, max(v) as v_max,
       sum(v) / count(v) as v_mean, count(*) filter (where v is null) as v_invalid,
       count(*) filter (where event_id % 37 = 0 and event_id % 31 <> 0) as infinite
from t group by grouping sets ((), (event_type))
"""


def category_frequencies(spark, folder):
    counts = tb.load(spark, folder, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.withColumn("category", F.col("l_partkey").cast("string")).drop("l_partkey")
    return grp.category_counts(parts, ["l_returnflag"], "category", "n", limit=20).select("l_returnflag", "category", "n")


CATEGORY_SQL = """
with c as (select l_returnflag, cast(l_partkey as varchar) as category, count(*) as n from lineitem group by 1, 2),
r as (select *, row_number() over (partition by l_returnflag order by n desc, category) as p from c)
select l_returnflag, category, n from r where p <= 20
union all
select l_returnflag, '__OTHER__', cast(sum(n) as bigint) from r where p > 20 group by 1
"""


def merged_partials(spark, folder):
    """States of two halves of the data, merged, then rolled up."""
    df = tb.load(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", cents("o_totalprice").alias("cents"))
    grouping = Grouping("o_orderdate", "quarter", {"status": "o_orderstatus"})
    states = {**grp.counters(F.col("cents") >= 10000000, F.col("cents") % 2 == 0), **grp.moments("cents", F.col("cents"))}
    keyed = grp.group_keys(df, grouping)
    early = grp.partial_states(keyed.where(F.col("o_orderkey") % 2 == 0), grouping, states)
    late = grp.partial_states(keyed.where(F.col("o_orderkey") % 2 != 0), grouping, states)
    merges = {name: state.merge for name, state in states.items()}
    merged = grp.merge_states(early.unionByName(late), grouping, merges)
    return grp.roll_up(merged, grouping, merges).select(
        "is_overall", "time_period", "status", "row_count", "eligible_count", "passed_count", "failed_count",
        F.col("cents_sum").cast("bigint").alias("cents_sum"), "cents_min", "cents_max",
    )


MERGED_SQL = """
with k as (select strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) as time_period, o_orderstatus as status,
                  cast(round(o_totalprice * 100) as bigint) as cents from orders)
select grouping(status) = 1 as is_overall, time_period, status, count(*) as row_count,
       count(*) filter (where cents >= 10000000) as eligible_count,
       count(*) filter (where cents >= 10000000 and cents % 2 = 0) as passed_count,
       count(*) filter (where cents >= 10000000 and cents % 2 <> 0) as failed_count,
       cast(sum(cents) as bigint) as cents_sum, cast(min(cents) as double) as cents_min, cast(max(cents) as double) as cents_max
from k group by grouping sets ((), (time_period, status))
"""


# ---- filters ----------------------------------------------------------------------------

FILTERS = {
    "filter_equals": (Filter("event_type", "equals", ["click"]), "event_type is not distinct from 'click'"),
    "filter_not_equals": (Filter("value", "not_equals", [50.0]), "value is distinct from 50.0"),
    "filter_in": (Filter("event_type", "in", ["click", "view", None]), "coalesce(event_type in ('click', 'view'), false) or event_type is null"),
    "filter_not_in": (Filter("value", "not_in", [25.0, 30.0]), "not coalesce(value in (25.0, 30.0), false)"),
    "filter_greater_than": (Filter("value", "greater_than", [60.0]), "value > 60.0"),
    "filter_greater_than_or_equal": (Filter("user_id", "greater_than_or_equal", [40]), "user_id >= 40"),
    "filter_less_than": (Filter("ts", "less_than", ["2024-01-15"]), "ts < timestamp '2024-01-15'"),
    "filter_less_than_or_equal": (Filter("value", "less_than_or_equal", [35.5]), "value <= 35.5"),
    "filter_between": (Filter("value", "between", [30.0, 70.0]), "value between 30.0 and 70.0"),
    "filter_is_null": (Filter("value", "is_null"), "value is null"),
    "filter_is_not_null": (Filter("value", "is_not_null"), "value is not null"),
}


def _filtered(item):
    def query(spark, folder):
        kept = apply_filters(tb.events_fill(spark, folder), [item])
        return kept.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("row_count"), F.sum(cents("value")).alias("cents"), F.sum("event_id").alias("id_sum")
        )

    return query


def _filtered_sql(condition: str) -> str:
    return f"""
with fx as ({tb.sql(tb.EVENTS_FILL, "events")})
select event_type, count(*) as row_count, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents, cast(sum(event_id) as bigint) as id_sum
from fx where {condition} group by 1
"""


def filters_combined(spark, folder):
    items = [
        Filter("event_type", "not_in", ["N/A"]),
        Filter("value", "between", [20.0, 80.0]),
        Filter("props", "greater_than", [5]),
        Filter("user_id", "not_equals", ["8"]),
    ]
    kept = apply_filters(tb.events_fill(spark, folder), items[:2] + items[3:])
    never = apply_filters(tb.events_fill(spark, folder), [items[2]])
    both = kept.agg(F.count(F.lit(1)).alias("rows_kept")).unionByName(
        never.agg(F.count(F.lit(1)).alias("rows_of_other_kind")), allowMissingColumns=True
    )
    return both.agg(F.max("rows_kept").alias("rows_kept"), F.max("rows_of_other_kind").alias("rows_of_other_kind"))


FILTERS_COMBINED_SQL = f"""
with fx as ({tb.sql(tb.EVENTS_FILL, "events")})
select count(*) filter (where event_type <> 'N/A' and value between 20.0 and 80.0) as rows_kept,
       cast(0 as bigint) as rows_of_other_kind from fx
"""

QUERIES = {
    "fill_rate_by_month": fill_rate_by_month,
    "fill_rate_columns": fill_rate_columns,
    "time_bucket_counts": time_bucket_counts,
    "invalid_time_as_unknown": _timed("unknown"),
    "invalid_time_excluded": _timed("exclude"),
    "parsed_timestamps": parsed_timestamps,
    "group_overflow_folded": group_overflow,
    "numeric_moments": numeric_moments,
    "category_frequencies": category_frequencies,
    "merged_partial_states": merged_partials,
    "filters_combined": filters_combined,
    "declared_date_as_text": declared_date_as_text,
    **{name: _filtered(item) for name, (item, _) in FILTERS.items()},
}
ORACLES = {
    "declared_date_as_text": DECLARED_DATE_SQL,
    "fill_rate_by_month": FILL_RATE_SQL,
    "fill_rate_columns": FILL_COLUMNS_SQL,
    "time_bucket_counts": _bucket_sql("orders", "o_orderdate") + " union all " + _bucket_sql("events", "ts"),
    "invalid_time_as_unknown": TIME_UNKNOWN_SQL,
    "invalid_time_excluded": TIME_EXCLUDE_SQL,
    "parsed_timestamps": PARSED_SQL,
    "group_overflow_folded": GROUP_OVERFLOW_SQL,
    "numeric_moments": MOMENTS_SQL,
    "category_frequencies": CATEGORY_SQL,
    "merged_partial_states": MERGED_SQL,
    "filters_combined": FILTERS_COMBINED_SQL,
    **{name: _filtered_sql(condition) for name, (_, condition) in FILTERS.items()},
}
