"""Column profiles: one row per column.

Statistics that merge (counts, moments, lengths, pattern hits) come from one
aggregate over the wide table. Distinct values, top values and samples come from
one count per (column, value hash); ranking keeps a few rows per column and
partition before the shuffle, so no column's values gather in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance import fixed_values as fixed
from parlance.functions import hashing
from parlance.functions import text as tx
from parlance.functions.text import quoted
from parlance.sources.readers import logical_type
from parlance.sources.storage import materialize

NUMERIC = ("integer", "float")
TEMPORAL = ("date", "datetime")
# Longer values are hashed before they are counted. No JSON form of another value begins with one of the marks.
COUNTED_CHARACTERS = 64
LONG_MARK, TEXT_MARK = "#", "s"


def is_missing(column: Column, data_type: T.DataType, spellings: Sequence[str] = fixed.PROFILE_NULL_LIKE) -> Column:
    if isinstance(data_type, T.StringType):
        return tx.is_null_like(column, spellings)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _statistics(item: T.StructField, characters: int | None) -> str:
    """All merging statistics of one column, whose missing values are null by now, as one SQL struct.

    A wide table needs hundreds of aggregates; written as text they reach the
    JVM in one call per column.
    """
    kind = logical_type(item.dataType)
    column = "`" + item.name.replace("`", "``") + "`"
    label = item.name.replace("\\", "\\\\").replace("'", "\\'")
    kept = column
    hits = ", ".join(
        f"named_struct('hits', count_if({_inspected(kept, characters)} rlike r'(?U){pattern}'), 'rank', {-position}, 'name', '{name}')"
        for position, (name, pattern) in enumerate(fixed.PROFILE_PATTERNS)
    )
    number = f"cast({kept} as double)"
    if isinstance(item.dataType, (T.DoubleType, T.FloatType)):
        number = f"if(abs({number}) = double('infinity'), null, {number})"
    moment = f"cast({kept} as timestamp_ntz)"
    # Statistics of another kind of column are constants, not aggregates over nulls.
    numeric = (
        f"named_struct('count', count({number}), 'minimum', min({number}), 'maximum', max({number}), 'mean', avg({number}), "
        f"'standard_deviation', if(count({number}) = 1, 0D, stddev_samp({number})))"
        if kind in NUMERIC
        else f"named_struct('count', 0L, {_nulls('double', 'minimum', 'maximum', 'mean', 'standard_deviation')})"
    )
    text = (
        f"named_struct('count', count({kept}), 'minimum_length', cast(min(length({kept})) as bigint), "
        f"'maximum_length', cast(max(length({kept})) as bigint), 'average_length', avg(length({kept})), "
        rf"'blank_count', count_if({kept} = ''), 'whitespace_only_count', count_if({kept} <> '' and not {kept} rlike r'(?U)\S'))"
        if kind == "string"
        else f"named_struct('count', 0L, {_nulls('bigint', 'minimum_length', 'maximum_length')}, {_nulls('double', 'average_length')}, "
        "'blank_count', 0L, 'whitespace_only_count', 0L)"
    )
    temporal = (
        f"named_struct('count', count({kept}), 'minimum', min({moment}), 'maximum', max({moment}))"
        if kind in TEMPORAL
        else f"named_struct('count', 0L, {_nulls('timestamp_ntz', 'minimum', 'maximum')})"
    )
    detected = (
        f"transform(reverse(array_sort(filter(array({hits}), entry -> entry.hits > 0))), entry -> entry.name)"
        if kind == "string"
        else "cast(array() as array<string>)"
    )
    return f"""named_struct(
        'column_name', '{label}',
        'source_type', '{item.dataType.simpleString()}',
        'inferred_type', if(count({kept}) = 0, 'unknown', '{kind}'),
        'type_confidence', if(count({kept}) = 0, 0D, 1D),
        'row_count', count(1),
        'non_null_count', count({kept}),
        'null_count', count(1) - count({kept}),
        'fill_rate', coalesce(try_divide(cast(count({kept}) as double), cast(count(1) as double)), 0D),
        'numeric', {numeric},
        'text', {text},
        'temporal', {temporal},
        'detected_patterns', {detected})"""


def _inspected(text: str, characters: int | None) -> str:
    return text if characters is None else f"substring({text}, 1, {characters})"


def _nulls(kind: str, *names: str) -> str:
    return ", ".join(f"'{name}', cast(null as {kind})" for name in names)


def column_statistics(df: DataFrame, table: str, characters: int | None = None) -> DataFrame:
    """One row per column from a single aggregate over the table."""
    structs = ", ".join(_statistics(item, characters) for item in df.schema.fields)
    # Missing values are told apart once for each cell, before the many aggregates that ask for it.
    kept = df.select(*[
        F.when(~is_missing(quoted(item.name), item.dataType), quoted(item.name)).alias(item.name) for item in df.schema.fields])
    one_row = kept.agg(F.expr(f"array({structs})").alias("columns"))
    return one_row.select(F.lit(table).alias("table_name"), F.inline("columns"))


def _counted_form(item: T.StructField) -> Column:
    """What stands for a cell while it is counted: a marked short text, the marked hash of a long value, or a JSON form."""
    column, kind = quoted(item.name), logical_type(item.dataType)
    present = ~is_missing(column, item.dataType)
    form = hashing.value_form(column, kind)
    long_form = F.concat(F.lit(LONG_MARK), hashing.form_hash(form))
    if isinstance(item.dataType, T.StringType):
        return F.when(F.length(column) <= COUNTED_CHARACTERS, F.concat(F.lit(TEXT_MARK), column)).when(present, long_form)
    if kind in NUMERIC + TEMPORAL + ("boolean",):
        return F.when(present, form)
    return F.when(present, F.when(F.length(form) <= COUNTED_CHARACTERS, form).otherwise(long_form))


def value_counts(df: DataFrame, table: str, chosen: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows per (column, value hash), without missing values; of some columns and cells, if conditions by column are given.

    Short values are counted as they are; whether a text is missing, and its hash, is asked once for each distinct one.
    """
    conditions = dict.fromkeys(df.columns, F.lit(True)) if chosen is None else chosen
    entries = [
        F.struct(F.lit(item.name).alias("column_name"), F.when(conditions[item.name], _counted_form(item)).alias("form"))
        for item in df.schema.fields if item.name in conditions
    ] or [F.struct(F.lit("").alias("column_name"), F.lit(None).cast("string").alias("form"))]
    each = df.select(F.inline(F.array(*entries))).where(F.col("form").isNotNull())
    form, rest = F.col("form"), F.substring("form", 2, COUNTED_CHARACTERS)
    is_text = form.startswith(TEXT_MARK)
    value_hash = F.when(form.startswith(LONG_MARK), rest).when(is_text, hashing.value_hash(rest, "string")).otherwise(hashing.form_hash(form))
    present = ~is_text | ~is_missing(rest, T.StringType())
    counted = each.groupBy("column_name", "form").agg(
        F.count(F.lit(1)).alias("n"), value_hash.alias("value_hash"), present.alias("is_present"))
    # A condition that does not ask for the count would be moved below it, with all it is made of, and be asked of each cell.
    return counted.where(F.when(F.col("n") > 0, F.col("is_present"))).select(F.lit(table).alias("table_name"), "column_name", "value_hash", "n")


def distinct_counts(counts: DataFrame, many: int = fixed.PROFILE_DISTINCT_CAP) -> DataFrame:
    """Distinct values per column, always exact; `distinct_size` tells columns of more than so many values."""
    per_column = counts.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    return per_column.select(
        "table_name",
        "column_name",
        "distinct_count",
        F.lit("exact").alias("distinct_count_mode"),
        F.when(F.col("distinct_count") > many, "many").otherwise("few").alias("distinct_size"),
    )


def _ranked(counts: DataFrame, limit: int, *order: Column) -> DataFrame:
    window = Window.partitionBy("table_name", "column_name").orderBy(*order)
    return counts.withColumn("position", F.row_number().over(window).cast("bigint")).where(F.col("position") <= limit)


def top_values(counts: DataFrame, statistics: DataFrame, limit: int = fixed.PROFILE_TOP_VALUES) -> DataFrame:
    """Most frequent values of each column, hashed, with their share of non-null rows."""
    ranked = _ranked(counts, limit, F.desc("n"), F.col("value_hash"))
    totals = statistics.select("table_name", "column_name", "non_null_count")
    return ranked.join(totals, ["table_name", "column_name"]).select(
        "table_name",
        "column_name",
        "position",
        "value_hash",
        F.col("n").alias("count"),
        (F.col("n") / F.col("non_null_count") * 100.0).alias("percentage"),
    )


def hashed_samples(counts: DataFrame, limit: int = fixed.PROFILE_SAMPLES) -> DataFrame:
    """The smallest value hashes of each column."""
    return _ranked(counts, limit, F.col("value_hash")).select(
        "table_name", "column_name", "position", F.col("value_hash").alias("sample_hash")
    )


def quantiles(
    df: DataFrame,
    table: str,
    probabilities: Sequence[float] = fixed.PROFILE_QUANTILES,
    distinct: bool = False,
    exact: bool = False,
    accuracy: int = 10000,
) -> DataFrame:
    """Quantiles of numeric columns: of rows with a bounded error, or exactly, of rows or of distinct values."""
    numeric = [item.name for item in df.schema.fields if logical_type(item.dataType) in NUMERIC]
    schema = "table_name string, column_name string, probability double, quantile double"
    if not numeric:
        return df.sparkSession.createDataFrame([], schema)
    values = {name: tx.safe_scalar(quoted(name).cast("double")) for name in numeric}
    if distinct or exact:
        entries = [F.struct(F.lit(name).alias("column_name"), value.alias("v")) for name, value in values.items()]
        each = df.select(F.inline(F.array(*entries))).where(F.col("v").isNotNull())
        counted = each.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        if distinct:
            counted = counted.withColumn("n", F.lit(1).cast("bigint"))
        return _exact_quantiles(counted, probabilities).select(F.lit(table).alias("table_name"), "*")
    wanted = F.array(*[F.lit(probability) for probability in probabilities])
    structs = [
        F.struct(F.lit(name).alias("column_name"), F.percentile_approx(value, wanted, accuracy).alias("quantiles"))
        for name, value in values.items()
    ]
    pairs = F.arrays_zip(wanted.alias("probability"), F.col("quantiles").alias("quantile"))
    per_column = df.agg(F.array(*structs).alias("columns")).select(F.inline("columns"))
    return per_column.select(F.lit(table).alias("table_name"), "column_name", F.inline(pairs))


def _exact_quantiles(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles of (column_name, v, n), however many values a column has.

    Values are range-partitioned and stored, so that the ranks a value covers
    follow from the rows in earlier partitions and those before it in its own.
    """
    ordered = values.repartitionByRange("column_name", "v").withColumn("part", F.spark_partition_id())
    stored = materialize(ordered, "ordered-values")
    sizes = stored.groupBy("column_name", "part").agg(F.sum("n").alias("rows"))
    # One row per column and partition.
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column_name")
    offsets = sizes.select(
        "column_name", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("total")
    )
    inside = Window.partitionBy("column_name", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = stored.withColumn("so_far", F.sum("n").over(inside)).join(offsets, ["column_name", "part"])
    end = F.col("offset") + F.col("so_far")
    start = end - F.col("n")
    wanted = F.array(*[F.lit(probability) for probability in probabilities])

    def share(probability: Column) -> Column:
        """How much of the interpolated value this one contributes."""
        position = probability * (F.col("total") - 1)
        lower, upper = F.floor(position), F.ceil(position)
        fraction = position - lower
        from_lower = F.when((lower >= start) & (lower < end), F.lit(1.0) - fraction).otherwise(0.0)
        from_upper = F.when((upper >= start) & (upper < end), fraction).otherwise(0.0)
        return from_lower + from_upper

    shares = F.transform(wanted, lambda probability: F.struct(probability.alias("probability"), share(probability).alias("share")))
    parts = ranked.select("column_name", "v", F.inline(F.filter(shares, lambda entry: entry["share"] > 0)))
    return parts.groupBy("column_name", "probability").agg(F.sum(F.col("v") * F.col("share")).alias("quantile"))


TEXT_READINGS = {
    "integer": lambda text: text.try_cast("bigint").isNotNull() & text.rlike(r"^\s*[+-]?\d+\s*$"),
    "float": lambda text: text.try_cast("double").isNotNull(),
    "boolean": lambda text: F.lower(tx.strip(text)).isin("true", "false"),
    "datetime": lambda text: text.try_cast("timestamp_ntz").isNotNull() & text.rlike(r"^\s*\d{4}-?\d{2}-?\d{2}"),
}


def text_type_shares(df: DataFrame, table: str) -> DataFrame:
    """For text columns, the share of present values that read as each other type."""
    texts = [item for item in df.schema.fields if isinstance(item.dataType, T.StringType)]
    structs = []
    for item in texts:
        column = quoted(item.name)
        kept = F.when(~is_missing(column, item.dataType), column)
        for kind, reads in TEXT_READINGS.items():
            share = F.try_divide(F.count_if(reads(kept)).cast("double"), F.count(kept).cast("double"))
            structs.append(
                F.struct(F.lit(item.name).alias("column_name"), F.lit(kind).alias("reads_as"), share.alias("share"))
            )
    return df.agg(F.array(*structs).alias("columns")).select(F.lit(table).alias("table_name"), F.inline("columns"))


def profile(df: DataFrame, table: str, characters: int | None = None) -> DataFrame:
    """Statistics, distinct counts, top values and samples, one row per column."""
    statistics = column_statistics(df, table, characters)
    # Three lists are drawn from the counts; stored, they are counted and hashed once.
    counts = materialize(value_counts(df, table), "value-counts")
    keys = ["table_name", "column_name"]
    # Both lists are bounded by their limits, once per column.
    tops = top_values(counts, statistics).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("position", "value_hash", "count", "percentage"))).alias("top_values")
    )
    samples = hashed_samples(counts).groupBy(*keys).agg(F.array_sort(F.collect_list("sample_hash")).alias("safe_samples"))
    return (
        statistics.join(distinct_counts(counts), keys, "left").join(tops, keys, "left").join(samples, keys, "left")
        .withColumns(
            {
                "distinct_count": F.when(F.col("non_null_count") == 0, F.lit(0)).otherwise(F.col("distinct_count")),
                "distinct_count_mode": F.coalesce("distinct_count_mode", F.lit("exact")),
                "distinct_size": F.coalesce("distinct_size", F.lit("few")),
                "top_values": F.coalesce("top_values", F.array()),
                "safe_samples": F.coalesce("safe_samples", F.array()),
            }
        )
    )


def retype_profile(profiles: DataFrame, dictionary: DataFrame, domains: DataFrame) -> DataFrame:
    """Profiles whose text columns are called temporal by dictionary or domain."""
    declared = dictionary.select("column_key", F.lower("source_type").alias("declared"))
    known = domains.select(
        "table_name", "column_name", F.lower(F.coalesce("semantic_type", F.lit(""))).alias("semantic"), "domain"
    )
    joined = (
        profiles.withColumn("column_key", F.lower("column_name")).join(declared, "column_key", "left")
        .join(known, ["table_name", "column_name"], "left")
    )
    said, semantic = F.coalesce("declared", F.lit("")), F.coalesce("semantic", F.lit(""))
    target = (
        F.when(F.col("inferred_type").isin(*TEMPORAL), F.col("inferred_type"))
        .when(said.contains("timestamp") | said.contains("datetime") | semantic.contains("timestamp"), "datetime")
        .when((said == "date") | semantic.endswith("_date") | (F.col("domain") == "interaction.time"), "date")
        .otherwise(F.col("inferred_type"))
    )
    changed = target != F.col("inferred_type")
    return joined.withColumns(
        {
            "inferred_type": target,
            "type_confidence": F.when(changed, F.greatest("type_confidence", F.lit(0.8))).otherwise(F.col("type_confidence")),
        }
    ).select(*profiles.columns)
