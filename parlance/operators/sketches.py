"""Mergeable sketches of columns, so that profiles of very large tables move no cells.

One aggregate over the wide table gives every column three sketches: of its distinct values (HyperLogLog), of its frequent values
(frequent items) and, if numeric, of its quantiles (KLL). Sketches can be stored for each batch or partition and merged later.
They either answer within a stated error, or tell what an exact count has to look at: distinct values are counted exactly only
where there are few; top values are counted exactly among proposed ones, which holds wherever the sketch's error bound lets no
other value in; samples come from cells below a hash threshold. Columns for which a bound fails are counted in full.

Values enter as 64-bit hashes. Missing values, as profiles define them, take no part; a column without values has no estimates.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance import fixed_values as fixed
from parlance.functions import hashing
from parlance.functions.text import quoted
from parlance.operators import profile as prof
from parlance.sources.readers import logical_type
from parlance.sources.storage import materialize

# Standard errors: 0.8 % of a distinct count, 0.8 % of rows in a quantile's rank.
DISTINCT_PRECISION = 14
QUANTILE_SIZE = 400
TRACKED_VALUES = 10_000
PROPOSED_VALUES = 100
# A frequent-items sketch of m tracked values misses none of a share of 2.625 / m of all values, and its estimates exceed the true
# counts by no more than that; until it holds m values it makes no error.
MISSED_SHARE = 2.625
KINDS = ("distinct", "frequent", "quantile")
# How many times the wanted sample values are expected below a hash threshold.
SAMPLE_SURPLUS = 8


def _key(item: T.StructField) -> str:
    column = "`" + item.name.replace("`", "``") + "`"
    return f"xxhash64({f'to_json({column})' if isinstance(item.dataType, T.MapType) else column})"


def _sketches(item: T.StructField, tracked: int, kinds: Collection[str]) -> str:
    column = "`" + item.name.replace("`", "``") + "`"
    label = item.name.replace("\\", "\\\\").replace("'", "\\'")
    present = f"filter (where {column} is not null)"
    number = f"cast({column} as double)" if logical_type(item.dataType) in prof.NUMERIC else "cast(null as double)"
    finite = f"filter (where abs({number}) < double('infinity'))"
    entries = [f"'column_name', '{label}', 'value_count', count({column})"]
    if "distinct" in kinds:
        entries.append(f"'distinct_sketch', hll_sketch_agg({_key(item)}, {DISTINCT_PRECISION}) {present}")
    if "frequent" in kinds:
        entries.append(f"'frequent_sketch', approx_top_k_accumulate({_key(item)}, {tracked}) {present}")
    if "quantile" in kinds:
        entries.append(
            f"'number_count', count({number}) {finite}, 'quantile_sketch', kll_sketch_agg_double({number}, {QUANTILE_SIZE}) {finite}")
    return f"named_struct({', '.join(entries)})"


def column_sketches(df: DataFrame, table: str, tracked: int = TRACKED_VALUES, kinds: Collection[str] = KINDS) -> DataFrame:
    """One row per column: its sketches, or those of the kinds asked for, from a single aggregate over the table."""
    kept = df.select(*[
        F.when(~prof.is_missing(quoted(item.name), item.dataType), quoted(item.name)).alias(item.name) for item in df.schema.fields])
    structs = ", ".join(_sketches(item, tracked, kinds) for item in df.schema.fields)
    return kept.agg(F.expr(f"array({structs})").alias("columns")).select(F.lit(table).alias("table_name"), F.inline("columns"))


def merge_sketches(sketches: DataFrame, tracked: int = TRACKED_VALUES) -> DataFrame:
    """Sketches of several parts of a table as those of the whole."""
    return sketches.groupBy("table_name", "column_name").agg(
        F.sum("value_count").alias("value_count"),
        F.hll_union_agg("distinct_sketch", F.lit(True)).alias("distinct_sketch"),
        F.expr(f"approx_top_k_combine(frequent_sketch, {tracked})").alias("frequent_sketch"),
        F.sum("number_count").alias("number_count"),
        F.expr("kll_merge_agg_double(quantile_sketch)").alias("quantile_sketch"),
    )


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """Estimated distinct values of each column."""
    estimate = F.when(F.col("value_count") > 0, F.hll_sketch_estimate("distinct_sketch")).otherwise(0)
    return sketches.select("table_name", "column_name", "value_count", estimate.alias("distinct_estimate"))


def quantile_estimates(sketches: DataFrame, probabilities: Sequence[float] = fixed.PROFILE_QUANTILES) -> DataFrame:
    """Estimated quantiles of numeric columns, one row per probability."""
    wanted = F.array(*[F.lit(float(probability)) for probability in probabilities])
    found = sketches.where(F.col("number_count") > 0).select(
        "table_name", "column_name", wanted.alias("probability"),
        F.expr(f"kll_sketch_get_quantile_double(quantile_sketch, array({', '.join(f'{float(p)}D' for p in probabilities)}))").alias("quantile"),
    )
    return found.select("table_name", "column_name", F.inline(F.arrays_zip("probability", "quantile")))


def _estimates(sketches: DataFrame) -> dict[str, tuple[int, int]]:
    """Values and estimated distinct values by column; one row per column."""
    return {row["column_name"]: (row["value_count"], row["distinct_estimate"]) for row in distinct_estimates(sketches).collect()}


def distinct_counts(df: DataFrame, table: str, sketches: DataFrame, many: int = fixed.PROFILE_DISTINCT_CAP) -> DataFrame:
    """Distinct values per column: exact where few are estimated, the estimate where many are; only the few are counted."""
    known = _estimates(sketches)
    few = [name for name in df.columns if 0 < known[name][1] <= many]
    exact = prof.distinct_counts(prof.value_counts(df.select(*map(quoted, few)), table), many) if few else None
    rest = distinct_estimates(sketches).where(F.col("distinct_estimate") > many).select(
        "table_name", "column_name", F.col("distinct_estimate").alias("distinct_count"), F.lit("estimate").alias("distinct_count_mode"),
        F.lit("many").alias("distinct_size"))
    return rest if exact is None else exact.unionByName(rest)


def _proposals(sketches: DataFrame, proposed: int) -> dict[str, list[tuple[int, int]]]:
    """The most frequent hashes of each column with their estimates: a bounded list for each column."""
    rows = sketches.where(F.col("value_count") > 0).select(
        "column_name", F.expr(f"approx_top_k_estimate(frequent_sketch, {proposed})").alias("values")).collect()
    return {row["column_name"]: [(entry["item"], entry["count"]) for entry in row["values"]] for row in rows}


def frequent_value_counts(
    df: DataFrame, table: str, sketches: DataFrame, limit: int = fixed.PROFILE_TOP_VALUES, proposed: int = PROPOSED_VALUES,
    tracked: int = TRACKED_VALUES,
) -> tuple[DataFrame, list[str]]:
    """Exact counts of all values that may be among the `limit` most frequent, and the columns that had to be counted in full.

    Proposed values are counted in one pass. A column is settled if its `limit`-th count exceeds what any value outside can
    have: the bound of the sketch, and the estimate of the last proposed value where there were more than could be proposed.
    """
    known, listed = _estimates(sketches), _proposals(sketches, proposed)
    kinds = {item.name: item for item in df.schema.fields}
    # A few rows for each column; several steps read them.
    near = materialize(prof.value_counts(df, table, {
        name: F.expr(_key(kinds[name])).isin([key for key, _ in values]) for name, values in listed.items() if values}), "near-values")
    order = Window.partitionBy("column_name").orderBy(F.desc("n"))
    ranked = near.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    reached = {row["column_name"]: (row["values"], row["least"]) for row in ranked.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("values"), F.min("n").alias("least")).collect()}
    whole = []
    for name, values in listed.items():
        total, distinct = known[name]
        # Three standard errors and some below the number of values at which a sketch starts to forget.
        forgets = distinct * 1.05 + 10 > tracked
        outside = 2 * MISSED_SHARE * total / tracked if forgets else 0
        if len(values) >= proposed:
            outside = max(outside, values[-1][1])
        held, least = reached.get(name, (0, 0))
        if outside and (held < limit or least <= outside):
            whole.append(name)
    full = prof.value_counts(df.select(*map(quoted, whole)), table) if whole else None
    near = near.where(~F.col("column_name").isin(whole)) if whole else near
    return (near if full is None else near.unionByName(full)), whole


def sampled_value_counts(df: DataFrame, table: str, sketches: DataFrame, limit: int = fixed.PROFILE_SAMPLES) -> DataFrame:
    """Counts of values of small hash, enough for the `limit` smallest of each column."""
    known = {name: distinct for name, (_, distinct) in _estimates(sketches).items() if distinct}
    types = {item.name: item.dataType for item in df.schema.fields}
    # The first eight hexadecimal digits of a hash are spread evenly over 32 bits.
    bounds = {name: min(1 << 32, int((1 << 32) * SAMPLE_SURPLUS * limit / distinct) + 1) for name, distinct in known.items()}

    def below(name: str, bound: int):
        digits = F.substring(hashing.value_hash(quoted(name), logical_type(types[name])), 1, 8)
        return digits <= F.lit(f"{min(bound, (1 << 32) - 1):08x}")

    near = materialize(prof.value_counts(df, table, {name: below(name, bound) for name, bound in bounds.items()}), "near-values")
    held = {row["column_name"]: row["n"] for row in near.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [name for name, bound in bounds.items() if bound < 1 << 32 and held.get(name, 0) < limit]
    if not short:
        return near
    return near.where(~F.col("column_name").isin(short)).unionByName(prof.value_counts(df.select(*map(quoted, short)), table))
