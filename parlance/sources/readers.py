"""Reading transcripts, dictionaries, rules and look-up tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.functions import text as tx

MODES = {"warn": "PERMISSIVE", "skip": "DROPMALFORMED", "error": "FAILFAST"}
SMALL_INPUT_BYTES = 256 * 1024 * 1024
SPLIT_BYTES = 128 << 20


def read_table(
    spark: SparkSession, path: str, spread: bool = False, small_input_bytes: int = SMALL_INPUT_BYTES, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Read parquet; with ``spread``, let all cores share an input that has few splits.

    A row group is read by one task, whatever its size, which hurts where each
    row is costly to inspect. Small inputs are dealt out at once. Of a large one
    the splits that hold rows are counted, which reads footers only; it is left
    as it is, so that its text is not shuffled, unless rows lie in few of them.
    """
    df = spark.read.parquet(path)
    if not spread:
        return df
    size = input_bytes(df)
    wanted = -(-size // split_bytes)
    if size > small_input_bytes and 2 * filled_splits(df, wanted) >= wanted:
        return df
    return df.repartition(max(spark.sparkContext.defaultParallelism, wanted))


def filled_splits(df: DataFrame, most: int) -> int:
    """How many partitions hold rows, counted up to ``most``."""
    return df.select(F.spark_partition_id()).distinct().limit(most).count()


def input_bytes(df: DataFrame) -> int:
    """Estimated size of what a frame reads, from the optimiser's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_transcripts(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    bad_lines: str = "warn",
    separator: str = ",",
    quote: str = '"',
    encoding: str = "UTF-8",
    corrupt_column: str = "_corrupt_line",
    multiline: bool = True,
) -> DataFrame:
    """Read a CSV of transcripts, or parquet when the path says so.

    Undecodable bytes are replaced and blank lines skipped. ``bad_lines`` keeps
    malformed lines in ``corrupt_column`` (warn), drops them (skip) or stops (error).
    With ``multiline`` a quoted field may hold line breaks, but a file is one task; for very large files use
    `read_split_csv`, or switch it off where there are no such fields.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = (
        spark.read.option("header", True).option("sep", separator).option("quote", quote).option("escape", quote)
        .option("encoding", encoding).option("multiLine", multiline).option("mode", MODES[bad_lines])
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )
    if schema is None:
        schema = infer_schema(spark, path, separator=separator, quote=quote, encoding=encoding, multiline=multiline)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = [name.casefold() for name in schema.names]
    if len(set(names)) != len(names):
        raise ValueError("column names must differ by more than letter case")
    if bad_lines == "warn":
        schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.schema(schema).csv(path)


def read_split_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    bad_lines: str = "warn",
    separator: str = ",",
    quote: str = '"',
    corrupt_column: str = "_corrupt_line",
) -> DataFrame:
    """Read CSV files whose quoted fields may hold line breaks, many tasks to a file; needs UTF-8 and a header line in every file.

    Whether a line begins inside a quoted field follows from the number of quotes before it: blocks count theirs first, their
    running sums are few rows, and each block then numbers the records that begin in it. Lines without an open quote are
    records as they are; only the lines of longer records are brought together. Quotes inside quoted fields are doubled.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).alias("quotes"))
    # One row for each block of each file.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parity = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes")).select(
        "file", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("quotes_before"))
    opened = F.col("quotes_before") + F.coalesce(F.sum("quotes").over(in_block), F.lit(0))
    begun = lines.join(F.broadcast(parity), ["file", "block"]).withColumn("begins", opened % 2 == 0)
    starts = begun.groupBy("file", "block").agg(F.count_if("begins").alias("starts")).select(
        "file", "block", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("starts_before"))
    so_far = F.count_if("begins").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    numbered = begun.join(F.broadcast(starts), ["file", "block"]).withColumn("record", F.col("starts_before") + so_far)
    whole = F.col("begins") & (F.col("quotes") % 2 == 0)
    alone = numbered.where(whole).select("file", "record", "value")
    # The lines of one record.
    pieces = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    joined = numbered.where(~whole).groupBy("file", "record").agg(
        F.array_join(F.transform(pieces, lambda piece: piece["value"]), "\n").alias("value"))
    records = alone.unionByName(joined).where((F.col("record") > 1) & (F.trim(F.col("value"), F.lit(" \t\r")) != ""))
    kept = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
    options = {
        "sep": separator, "quote": quote, "escape": quote, "columnNameOfCorruptRecord": corrupt_column,
        "mode": "FAILFAST" if bad_lines == "error" else "PERMISSIVE",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    parsed = records.select(F.from_csv(F.rtrim(F.col("value"), F.lit("\r")), _ddl(kept), options).alias("row")).select("row.*")
    if bad_lines == "warn":
        return parsed
    return (parsed.where(F.col(corrupt_column).isNull()) if bad_lines == "skip" else parsed).drop(corrupt_column)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{item.name.replace('`', '``')}` {item.dataType.simpleString()}" for item in schema.fields)


def count_bad_lines(df: DataFrame, corrupt_column: str = "_corrupt_line") -> DataFrame:
    """Lines read and lines that did not fit the schema."""
    return df.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col(corrupt_column).isNotNull()).alias("bad_lines")
    )


def infer_schema(
    spark: SparkSession,
    path: str,
    sample_ratio: float = 1.0,
    separator: str = ",",
    quote: str = '"',
    encoding: str = "UTF-8",
    multiline: bool = True,
) -> T.StructType:
    """Types of the CSV columns from a sample; dates stay text until declared otherwise."""
    inferred = (
        spark.read.option("header", True).option("sep", separator).option("quote", quote).option("escape", quote)
        .option("encoding", encoding).option("multiLine", multiline).option("inferSchema", True)
        .option("samplingRatio", sample_ratio).csv(path).schema
    )

    def plain(data_type: T.DataType) -> T.DataType:
        if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return T.StringType()
        if isinstance(data_type, T.IntegerType):
            return T.LongType()
        if isinstance(data_type, T.DecimalType):
            return T.DoubleType()
        return data_type

    return T.StructType([T.StructField(item.name, plain(item.dataType)) for item in inferred.fields])


LOGICAL_TYPES = (
    (T.StringType, "string"), (T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.DecimalType, "float"),
    (T.FractionalType, "float"), (T.DateType, "date"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"),
    (T.ArrayType, "array"), (T.StructType, "json"), (T.MapType, "json"), (T.VariantType, "json"),
    (T.DayTimeIntervalType, "duration"),
)


def logical_type(data_type: T.DataType) -> str:
    """Name of the logical type a Spark type stands for."""
    return next((name for kind, name in LOGICAL_TYPES if isinstance(data_type, kind)), "unknown")


# Dictionary headings and type names, and what they mean.
HEADINGS = {
    "name": ("name", "column", "column_name", "field", "field_name", "attribute_name"),
    "business_name": ("attribute_business_name", "business_name", "display_name"),
    "description": ("description", "column_description", "business_description"),
    "source_type": ("type", "data_type", "datatype", "logical_type"),
    "mandatory": ("mandatory", "is_mandatory", "required"),
    "nullable": ("nullable",),
    "sensitive": ("sde", "sensitive", "is_sensitive", "contains_pii"),
    "lineage": ("lineage", "source"),
}
TYPE_NAMES = {
    "string": ("string", "str"),
    "integer": ("int", "int64", "integer"),
    "float": ("float", "float64", "double"),
    "boolean": ("boolean", "bool"),
    "date": ("date",),
    "datetime": ("datetime", "timestamp"),
    "json": ("json",),
    "array": ("array",),
}
YES = ("yes", "y", "true", "1")
NO = ("no", "n", "false", "0")
STOP_WORDS = ("the", "a", "an", "of", "and", "for", "in", "to", "is", "this")


def _heading_targets(columns: Sequence[str]) -> dict[str, str]:
    targets: dict[str, str] = {}
    for column in columns:
        key = "_".join(part for part in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in column.lower()).split())
        for target, aliases in HEADINGS.items():
            if key in aliases:
                if target == "name":
                    targets.setdefault(target, column)
                else:
                    targets[target] = column
    return targets


def _truth(column: Column) -> Column:
    word = F.lower(column)
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def normalize_dictionary(df: DataFrame, order: str) -> DataFrame:
    """Canonical column dictionary from a table with free headings.

    Blank names and ``source:`` rows are skipped; of entries with the same name
    the first one by ``order`` stands. It is chosen with an aggregate, so many
    repeats of one name do not gather in one task.
    """
    targets = _heading_targets([name for name in df.columns if name != order])
    if "name" not in targets:
        raise ValueError("the dictionary needs a name column")

    def cleaned(target: str) -> Column:
        if target not in targets:
            return F.lit(None).cast("string")
        text = tx.strip(F.col(f"`{targets[target]}`").cast("string"))
        return F.when(text != "", text)

    fields = df.select(F.col(order).alias("entry_order"), *[cleaned(target).alias(target) for target in HEADINGS])
    usable = fields.where(F.col("name").isNotNull() & ~F.lower("name").startswith("source:"))
    entry = F.struct("entry_order", *HEADINGS)
    first = usable.groupBy(F.lower("name").alias("column_key")).agg(F.min_by(entry, "entry_order").alias("entry"))
    flat = first.select("column_key", "entry.*")
    kind = F.when(F.col("source_type").isNull(), "unknown")
    for name, spellings in TYPE_NAMES.items():
        kind = kind.when(F.lower("source_type").isin(*spellings), name)
    words = F.filter(
        tx.word_tokens(F.concat_ws(" ", "business_name", "description")),
        lambda word: (F.length(word) > 1) & ~word.isin(*STOP_WORDS),
    )
    explicit, nullable = _truth(F.col("mandatory")), _truth(F.col("nullable"))
    return flat.select(
        "column_key",
        F.col("name").alias("column_name"),
        "business_name",
        "description",
        "source_type",
        kind.otherwise("unknown").alias("logical_type"),
        F.coalesce(explicit, ~nullable).alias("mandatory"),
        _truth(F.col("sensitive")).alias("sensitive"),
        "lineage",
        F.array_sort(words).alias("business_terms"),
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Column dictionary from a CSV file."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return normalize_dictionary(raw.withColumn("_line", F.monotonically_increasing_id()), "_line")


PARAMETER = (
    "struct<parameter_type:string,description:string,required:boolean,default:variant,minimum:double,"
    "maximum:double,allowed_values:variant>"
)
RULE_SCHEMA = (
    "rule_id string, version string, check_name string, title string, description string, dimension string, "
    "severity string, level string, lifecycle string, enabled boolean, owner string, "
    "selector struct<required_domains:array<string>,semantic_types:array<string>,column_name_patterns:array<string>,"
    "excluded_column_patterns:array<string>,required_relationship_types:array<string>,"
    "minimum_domain_confidence:double,match_mode:string>, "
    f"parameters map<string,{PARAMETER}>, depends_on array<string>, suggested_by_model boolean, approved_by string"
)


def read_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Rule definitions from JSON files at any depth, checked before use."""
    rules = (
        spark.read.schema(RULE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").option("mode", "FAILFAST").json(directory)
    )
    rules = rules.withColumns(
        {"enabled": F.coalesce("enabled", F.lit(True)), "lifecycle": F.coalesce("lifecycle", F.lit("approved"))}
    )
    problems = rule_problems(rules).take(1)
    if problems:
        raise ValueError(f"rule {problems[0]['rule_id']}: {problems[0]['problem']}")
    return rules


def rule_problems(rules: DataFrame) -> DataFrame:
    """Every reason for which a rule table must be refused."""
    repeated = (
        rules.groupBy("rule_id", "version").count().where("count > 1")
        .select("rule_id", F.lit("the version occurs twice").alias("problem"))
    )
    contested = (
        rules.where(F.col("enabled") & (F.col("lifecycle") == "approved")).groupBy("check_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("rule_id")).where("n > 1")
        .select("rule_id", F.lit("the check has more than one active rule").alias("problem"))
    )
    ungoverned = rules.where(
        (F.col("lifecycle") == "approved") & (F.col("approved_by").isNull() | F.coalesce("suggested_by_model", F.lit(False)))
    ).select("rule_id", F.lit("an approved rule needs an approver and must not be a suggestion").alias("problem"))
    circular = rules.where(F.array_contains(F.coalesce("depends_on", F.array()), F.col("rule_id"))).select(
        "rule_id", F.lit("a rule cannot depend on itself").alias("problem")
    )
    each = rules.select("rule_id", F.explode("parameters").alias("name", "definition"))
    number = F.try_variant_get(F.col("definition.default"), "$", "double")
    kind, held = F.col("definition.parameter_type"), F.schema_of_variant(F.col("definition.default"))
    fits = (
        F.when(kind == "string", held == "STRING")
        .when(kind == "boolean", held == "BOOLEAN")
        .when(kind == "integer", held == "BIGINT")
        .when(kind == "number", held.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        .when(kind == "string_list", held.isin("ARRAY<STRING>", "ARRAY<VOID>"))
        .otherwise(False)
    )
    lacking = F.coalesce(F.col("definition.required"), F.lit(False)) & F.col("definition.default").isNull()
    outside = (number < F.col("definition.minimum")) | (number > F.col("definition.maximum"))
    crossed = F.col("definition.minimum") > F.col("definition.maximum")
    problem = (
        F.when(lacking, "a required parameter has no default")
        .when(crossed, "a parameter minimum exceeds its maximum")
        .when(F.col("definition.default").isNotNull() & ~fits, "a default has the wrong type")
        .when(kind.isin("integer", "number") & outside, "a default is outside its bounds")
    )
    typed = each.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("rule_id", "problem")
    return repeated.unionByName(contested).unionByName(ungoverned).unionByName(circular).unionByName(typed)


def rule_options(rules: DataFrame) -> dict[str, dict[str, object]]:
    """Parameters of the active rules, as `Settings.rule_options` takes them. A rule table is configuration and small."""
    active = rules.where(F.col("enabled") & (F.col("lifecycle") == "approved"))
    each = active.select("rule_id", F.explode("parameters").alias("name", "definition")).where("definition.default is not null")
    found: dict[str, dict[str, object]] = {}
    for row in each.select("rule_id", "name", F.to_json("definition.default").alias("default")).collect():
        found.setdefault(row["rule_id"], {})[row["name"]] = json.loads(row["default"])
    return found


def lexicon_of(terms: DataFrame) -> dict[str, tuple[str, ...]]:
    """Suspected forms by category from a look-up table, as lexicon rules take them; look-ups are configuration and small."""
    forms = terms.select("category", F.explode("suspected_forms").alias("form")).distinct()
    rows = forms.groupBy("category").agg(F.array_sort(F.collect_list("form")).alias("forms")).orderBy("category").collect()
    return {row["category"]: tuple(row["forms"]) for row in rows}


LOOKUP_SCHEMAS: Mapping[str, str] = {
    "pii_patterns": "category string, pattern string, validator string, enabled boolean",
    "speaker_labels": "role string, labels array<string>",
    "lexicon": "canonical_term string, suspected_forms array<string>, category string, enabled boolean",
    "topics": "priority int, name string, patterns array<string>",
    "glossary": "term string",
    "scores": "rule_id string, metric_name string, weight double, formula string, bounds array<double>, scope string",
}


def read_lookup(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One look-up table from JSON lines; entries switched off are left out."""
    table = spark.read.schema(LOOKUP_SCHEMAS[name]).json(path)
    return table.where(F.coalesce("enabled", F.lit(True))).drop("enabled") if "enabled" in table.columns else table

