"""Queries over column profiles and what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as tb
from parlance import fixed_values as fixed
from parlance.operators import applicability as ap
from parlance.operators import columns as co
from parlance.operators import classify, relationships, runs, signals
from parlance.operators import profile as prof
from parlance.operators import sketches as sk
from parlance.operators.filters import Filter, apply_filters
from parlance.operators.grouping import Grouping, group_keys
from parlance.sources.storage import materialize
from parlance.sources import readers

SCHEMAS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
    "calls": {"call_id": "bigint", "lang": "string", "source": "string", "transcript": "string", "duration_ms": "double", "call_day": "date", "agent_group": "string"},
    "gappy_events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
}
SOURCES = {
    **{name: name for name in SCHEMAS},
    "calls": f"(select *, lang as agent_group from ({tb.CALLS_SQL}))",
    "gappy_events": f"({tb.sql(tb.EVENTS_FILL, 'events')})",
}
WIDE_OR_LONG = (*tb.LONG_TEXTS, "lineitem", "orders", "events", "customer", "part")
LOGICAL = {"int": "integer", "bigint": "integer", "double": "float", "string": "string", "timestamp_ntz": "datetime", "date": "date", "array<float>": "array"}
NUMERIC = ("int", "bigint", "double")
NULLS = "'','null','none','nan','n/a','na'"


def frames(spark, folder):
    """All tables, and two derived ones with gaps and speaker tags."""
    loaded = {name: tb.load(spark, folder, name, spread=name in WIDE_OR_LONG) for name in tb.TABLES}
    loaded["calls"] = tb.calls(spark, folder).withColumn("agent_group", F.col("lang"))
    loaded["gappy_events"] = tb.events_fill(spark, folder, spread=True)
    return loaded


# ---- the comparison side: one row per column -------------------------------------------------


def missing_sql(column: str, kind: str) -> str:
    if kind == "string":
        return f"({column} is null or lower(trim({column}, ' ' || chr(9) || chr(10) || chr(13))) in ({NULLS}))"
    if kind == "double":
        return f"({column} is null or isnan({column}))"
    return f"({column} is null)"


PATTERNS_SQL = {
    "email_like": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone_like": r"[0-9][0-9 .()-]{7,}[0-9]",
    "speaker_labels": r"(?i)(?:^|\n)\s*(?:agent|customer|caller|representative)\s*:",
    "pipe_delimited": r"\|",
}


def cells_sql(table: str, columns: dict[str, str]) -> str:
    """All cells of a table as text, one row a cell; nulls have none."""
    listed = ", ".join(f"cast({c} as varchar) as {c}" for c in columns)
    return f"select '{table}' as t, c, v from (unpivot (select {listed} from {SOURCES[table]}) on {', '.join(columns)} into name c value v)"


def statistics_sql() -> str:
    """Statistics of every column from its cells; a short statement, since planning a long one costs more than running it."""
    kinds = ", ".join(f"('{t}', '{c}', '{k}', '{LOGICAL[k]}')" for t, columns in SCHEMAS.items() for c, k in columns.items())
    rows = " union all ".join(f"select '{t}' as t, count(*) as n from {SOURCES[t]}" for t in SCHEMAS)
    cells = " union all ".join(cells_sql(t, columns) for t, columns in SCHEMAS.items())
    numeric = ", ".join(f"'{k}'" for k in NUMERIC)
    hits = ", ".join(
        f"{{'h': count(*) filter (where regexp_matches(s, '{pattern}')), 'r': {-position}, 'n': '{name}'}}"
        for position, (name, pattern) in enumerate(PATTERNS_SQL.items())
    )
    return f"""
select table_name, column_name, source_type, case when coalesce(filled, 0) = 0 then 'unknown' else logical end as inferred_type,
       case when coalesce(filled, 0) = 0 then 0.0::double else 1.0::double end as type_confidence,
       n as row_count, coalesce(filled, 0) as non_null_count, n - coalesce(filled, 0) as null_count,
       case when n = 0 then 0.0::double else coalesce(filled, 0) / cast(n as double) end as fill_rate,
       coalesce(number_count, 0) as number_count, number_minimum, number_maximum, number_mean, number_deviation,
       coalesce(text_count, 0) as text_count, minimum_length, maximum_length, average_length, coalesce(blank_count, 0) as blank_count,
       coalesce(whitespace_only_count, 0) as whitespace_only_count, coalesce(moment_count, 0) as moment_count, moment_minimum, moment_maximum,
       coalesce(detected_patterns, '') as detected_patterns, coalesce(distinct_values, 0) as distinct_values
from (values {kinds}) as kinds(table_name, column_name, source_type, logical)
join ({rows}) as sizes on sizes.t = table_name
left join (
  select t, c, count(v) as filled, count(number) as number_count, min(number) as number_minimum, max(number) as number_maximum,
         round(avg(number), 8) as number_mean, case when count(number) = 1 then 0.0::double else round(stddev_samp(number), 6) end as number_deviation,
         count(s) as text_count, cast(min(length(s)) as bigint) as minimum_length, cast(max(length(s)) as bigint) as maximum_length,
         sum(length(s)) / cast(count(s) as double) as average_length,
         count(*) filter (where s = '') as blank_count, count(*) filter (where s <> '' and trim(s) = '') as whitespace_only_count,
         count(moment) as moment_count, strftime(min(moment), '%Y-%m-%d %H:%M:%S.%f') as moment_minimum,
         strftime(max(moment), '%Y-%m-%d %H:%M:%S.%f') as moment_maximum,
         array_to_string(list_transform(list_reverse_sort(list_filter([{hits}], lambda x: x.h > 0)), lambda x: x.n), ',') as detected_patterns, count(distinct v) as distinct_values
  from (select t, c, v, case when source_type in ({numeric}) then cast(v as double) end as number, case when source_type = 'string' then v end as s,
               case when source_type in ('timestamp_ntz', 'date') then cast(v as timestamp) end as moment
        from ({cells}) join (values {kinds}) as k(table_name, column_name, source_type, logical) on t = table_name and c = column_name
        where lower(trim(v, ' ' || chr(9) || chr(10) || chr(13))) not in ({NULLS}))
  group by t, c) as cells on cells.t = table_name and c = column_name"""


STATISTICS_SQL = statistics_sql()
PROFILE_CTE = f"p as materialized ({STATISTICS_SQL})"


def _flat(statistics):
    def moment(name):
        return F.date_format(f"temporal.{name}", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f"moment_{name}")

    return statistics.select(
        "table_name", "column_name", "source_type", "inferred_type", "type_confidence", "row_count", "non_null_count", "null_count", "fill_rate",
        F.col("numeric.count").alias("number_count"), F.col("numeric.minimum").alias("number_minimum"), F.col("numeric.maximum").alias("number_maximum"),
        F.round("numeric.mean", 8).alias("number_mean"), F.round("numeric.standard_deviation", 6).alias("number_deviation"),
        F.col("text.count").alias("text_count"), "text.minimum_length", "text.maximum_length", "text.average_length", "text.blank_count",
        "text.whitespace_only_count", F.col("temporal.count").alias("moment_count"), moment("minimum"), moment("maximum"),
        F.array_join("detected_patterns", ",").alias("detected_patterns"),
    )


def column_statistics(spark, folder):
    return _flat(runs.union_results([prof.column_statistics(df, name) for name, df in frames(spark, folder).items()]))


COLUMN_STATISTICS_SQL = f"with {PROFILE_CTE} select * exclude (distinct_values) from p"


def value_counts(spark, folder):
    """Value counts of all columns but the vectors, whose JSON form differs between engines."""
    return runs.union_results([prof.value_counts(df.drop("embedding"), name) for name, df in frames(spark, folder).items()])


def hash_sql(column: str, kind: str) -> str:
    value = f"cast({column} as varchar)" if kind in ("timestamp_ntz", "date") else column
    return f"substr(sha256(cast(to_json({value}) as varchar)), 1, 16)"


VALUES_CTE = "v as (" + " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, {hash_sql(c, k)} as value_hash, count(*) as n from {SOURCES[t]} where not {missing_sql(c, k)} group by 3"
    for t, columns in SCHEMAS.items()
    for c, k in columns.items()
    if c != "embedding"
) + ")"


def distinct_counts(spark, folder):
    """Distinct values of every column, and which columns have more than a thousand."""
    return prof.distinct_counts(value_counts(spark, folder), many=1000)


DISTINCT_SQL = f"""with {PROFILE_CTE}
select table_name, column_name, distinct_values as distinct_count, 'exact' as distinct_count_mode,
       case when distinct_values > 1000 then 'many' else 'few' end as distinct_size from p where non_null_count > 0 and column_name <> 'embedding'"""


def top_values(spark, folder):
    statistics = runs.union_results([prof.column_statistics(df, name) for name, df in frames(spark, folder).items()])
    return prof.top_values(value_counts(spark, folder), statistics)


TOP_SQL = f"""with {VALUES_CTE},
r as (select *, row_number() over (partition by table_name, column_name order by n desc, value_hash) as position,
             sum(n) over (partition by table_name, column_name) as total from v)
select table_name, column_name, position, value_hash, n as "count", n / cast(total as double) * 100.0 as percentage from r where position <= 20"""


def hashed_samples(spark, folder):
    return prof.hashed_samples(value_counts(spark, folder))


SAMPLES_SQL = f"""with {VALUES_CTE},
r as (select *, row_number() over (partition by table_name, column_name order by value_hash) as position from v)
select table_name, column_name, position, value_hash as sample_hash from r where position <= 10"""

SKETCHED_MANY = 300


def sketched(spark, folder, *kinds):
    """Each table without its vectors, with its stored sketches of some kinds."""
    for name, df in frames(spark, folder).items():
        plain = df.drop("embedding")
        yield name, plain, materialize(sk.column_sketches(plain, name, kinds=kinds), "sketches")


def sketched_distinct_counts(spark, folder):
    """Distinct values, exact up to a bound and estimated beyond; whether estimates are within 3 % of the exact count."""
    found = runs.union_results([sk.distinct_counts(df, name, made, SKETCHED_MANY) for name, df, made in sketched(spark, folder, "distinct")])
    exact = prof.distinct_counts(value_counts(spark, folder)).select("table_name", "column_name", F.col("distinct_count").alias("true_count"))
    is_close = F.abs(F.col("distinct_count") - F.col("true_count")) <= 0.03 * F.col("true_count")
    return found.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", F.when(F.col("distinct_count_mode") == "exact", F.col("distinct_count")).alias("exact_count"),
        "distinct_count_mode", "distinct_size", is_close.alias("is_close"))


SKETCHED_DISTINCT_SQL = f"""with {PROFILE_CTE}
select table_name, column_name, case when distinct_values <= {SKETCHED_MANY} then distinct_values end as exact_count,
       case when distinct_values <= {SKETCHED_MANY} then 'exact' else 'estimate' end as distinct_count_mode,
       case when distinct_values <= {SKETCHED_MANY} then 'few' else 'many' end as distinct_size, true as is_close
from p where non_null_count > 0 and column_name <> 'embedding'"""


def sketched_top_values(spark, folder):
    """Top values counted among proposed ones, and in full only where the sketch cannot exclude others."""
    parts = []
    for name, df, made in sketched(spark, folder, "distinct", "frequent"):
        counts, _ = sk.frequent_value_counts(df, name, made)
        parts.append(prof.top_values(counts, prof.column_statistics(df, name)))
    return runs.union_results(parts)


def sketched_samples(spark, folder):
    return runs.union_results([
        prof.hashed_samples(sk.sampled_value_counts(df, name, made)) for name, df, made in sketched(spark, folder, "distinct")])


def merged_sketch_quantiles(spark, folder):
    """Quantiles from sketches of two halves of each table, merged: whether their ranks are within 2 % of those asked for."""
    parts = []
    for name in ALL_QUANTILE_TABLES:
        df = tb.load(spark, folder, name).drop("embedding")
        half = F.pmod(F.xxhash64(df.columns[0]), F.lit(2))
        sketches = sk.column_sketches(df.where(half == 0), name).union(sk.column_sketches(df.where(half == 1), name))
        asked = sk.quantile_estimates(sk.merge_sketches(materialize(sketches, "sketches"))).collect()
        ranks = [F.struct(
            F.lit(row["column_name"]).alias("column_name"), F.lit(row["probability"]).alias("probability"),
            (F.avg((F.col(row["column_name"]) < row["quantile"]).cast("int")) - row["probability"]).alias("below"),
            (F.avg((F.col(row["column_name"]) <= row["quantile"]).cast("int")) - row["probability"]).alias("reached"),
        ) for row in asked]
        parts.append(df.agg(F.array(*ranks).alias("ranks")).select(F.lit(name).alias("table_name"), F.inline("ranks")))
    is_close = (F.col("below") <= 0.02) & (F.col("reached") >= -0.02)
    return runs.union_results(parts).select("table_name", "column_name", "probability", is_close.alias("is_close"))


MERGED_QUANTILES_SQL = " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, unnest([{', '.join(f'{p}::double' for p in fixed.PROFILE_QUANTILES)}]) as probability, true as is_close from (select count({c}) as n from {t}) where n > 0"
    for t in tb.TABLES for c, k in SCHEMAS[t].items() if k in NUMERIC
)


# Every stored table with a numeric column.
ALL_QUANTILE_TABLES = tuple(t for t in tb.TABLES if any(k in NUMERIC for k in SCHEMAS[t].values()))


def _quantiles(distinct, tables=ALL_QUANTILE_TABLES):
    def query(spark, folder):
        parts = [
            prof.quantiles(tb.load(spark, folder, name), name, distinct=distinct, exact=True) for name in tables
        ]
        return runs.union_results(parts).withColumn("quantile", F.round("quantile", 6))

    return query


def _quantiles_sql(function: str, distinct: str, tables: tuple[str, ...] = ALL_QUANTILE_TABLES) -> str:
    return " union all ".join(
        f"""select '{t}' as table_name, '{c}' as column_name, unnest([{', '.join(f'{p}::double' for p in fixed.PROFILE_QUANTILES)}]) as probability,
                   unnest({function}(x, [{', '.join(map(str, fixed.PROFILE_QUANTILES))}])) as quantile
            from (select {distinct} cast({c} as double) as x from {t})"""
        for t in tables
        for c, k in SCHEMAS[t].items()
        if k in NUMERIC
    )


QUANTILES_SQL = {
    True: f"select table_name, column_name, probability, round(quantile, 6) as quantile from ({_quantiles_sql('quantile_cont', 'distinct')})",
    False: f"select table_name, column_name, probability, round(quantile, 6) as quantile from ({_quantiles_sql('quantile_cont', '')})",
}
ALL_QUANTILES_SQL = {
    distinct: f"select table_name, column_name, probability, round(quantile, 6) as quantile from ({_quantiles_sql('quantile_cont', word, ALL_QUANTILE_TABLES)})"
    for distinct, word in ((True, "distinct"), (False, ""))
}
AS_TEXT = {
    "key_text": "case when o_orderkey % 10 = 0 then 'none' else cast(o_orderkey as string) end",
    "price_text": "case when o_orderkey % 4 = 0 then 'unpriced' else cast(o_totalprice as string) end",
    "flag_text": "case when o_orderstatus = 'F' then 'true' else 'false' end",
    "date_text": "case when o_orderkey % 5 = 0 then 'soon' else cast(cast(o_orderdate as date) as string) end",
}


def text_type_shares(spark, folder):
    return prof.text_type_shares(tb.derived(tb.load(spark, folder, "orders"), AS_TEXT), "orders_as_text")


READS_SQL = {
    "integer": "try_cast(k as bigint) is not null and regexp_matches(k, '^\\s*[+-]?[0-9]+\\s*$')",
    "float": "try_cast(k as double) is not null",
    "boolean": "lower(trim(k)) in ('true', 'false')",
    "datetime": "try_cast(k as timestamp) is not null and regexp_matches(k, '^\\s*[0-9]{4}-?[0-9]{2}-?[0-9]{2}')",
}
TYPE_SHARES_SQL = " union all ".join(
    f"""select 'orders_as_text' as table_name, '{c}' as column_name, '{kind}' as reads_as, count(*) filter (where {test}) / cast(count(k) as double) as share
        from (select case when lower(trim({c})) not in ({NULLS}) then {c} end as k from ({tb.sql(AS_TEXT, 'orders')}))"""
    for c in AS_TEXT
    for kind, test in READS_SQL.items()
)

# ---- dictionary, domains, relationships ----------------------------------------------------------

DESCRIPTION = (
    "case when source_type = 'string' and {average} >= 200 then 'cleaned transcript text transcription' "
    "when source_type in ('timestamp_ntz', 'date') then 'date of the interaction time' "
    "when source_type = 'bigint' and {ratio} >= 0.99 then 'unique id key' "
    "when source_type in ('bigint', 'double', 'int') then 'total duration segments' "
    "when {distinct} <= 4 then 'agent group speaker' else 'topic names category' end"
)
_known: dict = {}


def profiles(spark, folder):
    """Full profiles of all tables, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _known:
        made = runs.union_results([prof.profile(df, name) for name, df in frames(spark, folder).items()])
        _known[key] = materialize(made, "profiles").inputFiles()[0].rsplit("/", 1)[0]
    return spark.read.parquet(_known[key])


def raw_dictionary(spark, folder):
    """A dictionary with free headings, described from what the profiles show."""
    words = F.replace("column_name", F.lit("_"), F.lit(" "))
    text = DESCRIPTION.format(
        average="coalesce(text.average_length, 0)", ratio="coalesce(distinct_count, non_null_count) / greatest(non_null_count, 1)",
        distinct="coalesce(distinct_count, 50000)",
    )
    return profiles(spark, folder).select(
        F.concat_ws("|", "table_name", "column_name").alias("line"),
        F.concat(F.lit(" "), "column_name").alias("Attribute Name"),
        words.alias("Business Name"),
        F.expr(text).alias("Description"),
        F.when(F.col("source_type") == "timestamp_ntz", "Timestamp").otherwise(F.col("source_type")).alias("Data-Type"),
        F.when(F.col("null_count") > 0, "Yes").otherwise("n").alias("Nullable"),
        F.when(F.col("column_name").contains("name"), "TRUE").otherwise("unsure").alias("Contains PII"),
    )


def dictionary(spark, folder):
    return readers.normalize_dictionary(raw_dictionary(spark, folder), "line")


def column_dictionary(spark, folder):
    return dictionary(spark, folder).withColumn("business_terms", F.array_join("business_terms", " "))


DICTIONARY_CTE = f"""{PROFILE_CTE},
raw as (select table_name || '|' || column_name as line, column_name, replace(column_name, '_', ' ') as business_name,
        {DESCRIPTION.format(average='coalesce(average_length, 0)', ratio='distinct_values / greatest(non_null_count, 1)', distinct='distinct_values')} as description,
        case when source_type = 'timestamp_ntz' then 'Timestamp' else source_type end as source_type, null_count from p),
dict as (select lower(column_name) as column_key, column_name, business_name, description, source_type,
         case when lower(source_type) = 'string' then 'string' when lower(source_type) = 'int' then 'integer' when lower(source_type) = 'double' then 'float'
              when lower(source_type) = 'date' then 'date' when lower(source_type) = 'timestamp' then 'datetime' else 'unknown' end as logical_type,
         null_count = 0 as mandatory, case when contains(column_name, 'name') then true end as sensitive, cast(null as varchar) as lineage
         from (select *, row_number() over (partition by lower(column_name) order by line) as rn from raw) where rn = 1)
"""
WORDS_SQL = "list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+'))"
DICTIONARY_SQL = f"""with {DICTIONARY_CTE}
select *, array_to_string(list_sort(list_filter({WORDS_SQL.format(text="business_name || ' ' || description")},
       lambda w: length(w) > 1 and w not in ({', '.join(f"'{w}'" for w in readers.STOP_WORDS)}))), ' ') as business_terms from dict"""


def part_dictionary(spark, folder):
    """Parts read as dictionary entries: names repeat, and the first entry of each stands."""
    raw = tb.load(spark, folder, "part").select(
        F.col("p_partkey").alias("line"), F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("FIELD"),
        F.col("p_type").alias("Column Description"), F.when(F.col("p_size") % 2 == 0, "double").otherwise("str").alias("datatype"),
        F.when(F.col("p_size") % 3 == 0, "y").when(F.col("p_size") % 3 == 1, "0").alias("Required"),
    )
    return readers.normalize_dictionary(raw, "line").select(
        "column_key", "description", "logical_type", "mandatory", F.array_join("business_terms", " ").alias("terms")
    )


PART_DICTIONARY_SQL = f"""
with r as (select *, lower(trim(p_brand || ' ' || p_size)) as column_key, row_number() over (partition by lower(trim(p_brand || ' ' || p_size)) order by p_partkey) as rn from part)
select column_key, p_type as description, case when p_size % 2 = 0 then 'float' else 'string' end as logical_type,
       case p_size % 3 when 0 then true when 1 then false end as mandatory,
       array_to_string(list_sort(list_filter({WORDS_SQL.format(text='p_type')}, lambda w: length(w) > 1)), ' ') as terms from r where rn = 1"""


def dictionary_gaps(spark, folder):
    """Gaps between all columns and a dictionary of the long texts and the parts' brands."""
    made = dictionary(spark, folder).where(F.col("description").startswith("cleaned") | F.col("sensitive"))
    brands = part_dictionary(spark, folder).select("column_key", F.col("column_key").alias("column_name"))
    return classify.dictionary_gaps(profiles(spark, folder), made.select("column_key", "column_name").unionByName(brands))


GAPS_SQL = f"""with {DICTIONARY_CTE},
d2 as (select column_key, column_name from dict where starts_with(description, 'cleaned') or sensitive
       union all select distinct lower(trim(p_brand || ' ' || p_size)), lower(trim(p_brand || ' ' || p_size)) from part),
c as (select distinct lower(column_name) as column_key, column_name from p)
select 'unmatched_source_column' as gap, column_name from c where column_key not in (select column_key from d2)
union all select 'dictionary_only_column', column_name from d2 where column_key not in (select column_key from c)"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::varchar[]"


# Words in the names of the test tables' columns.
FIXTURE_ONTOLOGY = classify.extended({
    "conversation.transcript": ("summary",),
    "interaction.identifier": ("orderkey", "partkey", "suppkey"),
    "party.customer": ("cust", "custkey"),
    "interaction.time": ("ts", "orderdate", "shipdate"),
    "interaction.duration": ("chars", "turn", "dur"),
    "conversation.topic": ("type", "priority"),
    "conversation.sentiment": ("quality", "toxic"),
    "product": ("brand", "part"),
    "platform.lineage": ("source", "url"),
})


def _score_sql() -> str:
    weights = fixed.DOMAIN_WEIGHTS
    selects = []
    for entry in FIXTURE_ONTOLOGY:
        names = list(entry["name_tokens"])
        phrases = list(dict.fromkeys(classify._words(entry["description_phrases"]) + names))
        hints = list(dict.fromkeys(classify._words(entry["value_hints"]) + names))
        types = ", ".join(f"'{t}'" for t in entry["logical_types"])
        selects.append(f"""
select table_name, column_name, '{entry["domain"]}' as domain,
       {weights["column_name"]}::double * least(1.0::double, len(list_intersect(name_words, {_list(names)})) / 2.0::double)
       + {weights["metadata_description"]}::double * least(1.0::double, len(list_intersect(description_words, {_list(phrases)})) / 2.0::double)
       + {weights["observed_pattern"]}::double * least(1.0::double, len(list_intersect(pattern_words, {_list(hints)})) / 1.0::double)
       + {weights["logical_data_type"]}::double * (case when effective_type in ({types}) then 1.0::double else 0.0::double end)
       + {weights["related_columns"]}::double * (len(list_intersect(table_words, {_list(names)})) / least(len(table_words), {len(names)})::double) as score,
       {_list(entry["semantic_types"])} as semantic_types, name_words, description_words from words""")
    return " union all ".join(selects)


DOMAINS_CTE = f"""{DICTIONARY_CTE},
base as (select p.table_name, p.column_name, {WORDS_SQL.format(text='p.column_name')} as name_words,
         {WORDS_SQL.format(text="d.business_name || ' ' || d.description")} as description_words,
         {WORDS_SQL.format(text='p.detected_patterns')} as pattern_words,
         case when d.logical_type <> 'unknown' then d.logical_type else p.inferred_type end as effective_type
         from p left join dict d on lower(p.column_name) = d.column_key),
per_table as (select table_name, list(distinct w) as table_words from (select table_name, unnest(name_words) as w from base) group by 1),
words as (select * from base join per_table using (table_name)),
scored as ({_score_sql()}),
ordered as (select *, row_number() over w as pos, coalesce(lead(score) over w, 0.0) as second from scored
            window w as (partition by table_name, column_name order by round(score, 12) desc, domain)),
best as (select * from ordered where pos = 1),
sem as (select table_name, column_name, unnest(semantic_types) as st, list_distinct(list_concat(name_words, description_words)) as ev from best),
sem2 as (select table_name, column_name, st, len(list_intersect(ev, string_split(st, '_'))) / least(len(ev), len(string_split(st, '_')))::double as ov from sem),
sem3 as (select table_name, column_name, st from (select *, row_number() over (partition by table_name, column_name order by ov desc, st) as rn from sem2) where rn = 1),
dom as (select table_name, column_name, case when score >= 0.55 then domain else 'unknown' end as domain, case when score >= 0.55 then st end as semantic_type,
        round(score, 6) as confidence, case when score >= 0.8 and score - second >= 0.1 then 'high' when score >= 0.55 then 'medium' else 'low' end as confidence_level,
        score < 0.55 or score - second < 0.1 as requires_review from best join sem3 using (table_name, column_name))
"""


def domains(spark, folder):
    return classify.classify_columns(profiles(spark, folder), dictionary(spark, folder), FIXTURE_ONTOLOGY)


def column_domains(spark, folder):
    return domains(spark, folder).drop("matched_features")


DOMAINS_SQL = f"with {DOMAINS_CTE} select * from dom"


def domain_scores(spark, folder):
    return classify.domain_scores(profiles(spark, folder), dictionary(spark, folder), FIXTURE_ONTOLOGY).select(
        "table_name", "column_name", "domain", F.round("score", 9).alias("score")
    )


DOMAIN_SCORES_SQL = f"with {DOMAINS_CTE} select table_name, column_name, domain, round(score, 9) as score from scored"


def grouping_guard(spark, folder):
    return classify.grouping_guard(profiles(spark, folder), domains(spark, folder))


GUARD_SQL = f"""with {DOMAINS_CTE},
g as (select p.table_name, p.column_name,
      regexp_matches(lower(coalesce(semantic_type, '')), 'pii|secret|identifier|customer|account') or regexp_matches(lower(domain), 'pii|secret|identifier|customer|account') as sensitive,
      lower(coalesce(semantic_type, '')) in ('transcript','free_text','customer_identifier','interaction_identifier','pii','secret')
      or regexp_matches(p.column_name, '(?i)(^|_)(transcript|summary|comment|detail|text)(_|$)|(^|_)(customer|cust|account|member).*_?id$')
      or (inferred_type = 'string' and coalesce(average_length, 0) >= 256) as free_text
      from p join dom using (table_name, column_name))
select *, not sensitive and not free_text as allowed from g"""


def refused_columns(spark, folder):
    """For every column whether it is refused as a filter and as a dimension, on frames that carry the guard's notes."""
    guard = materialize(grouping_guard(spark, folder), "guard")
    found = []
    for name, df in frames(spark, folder).items():
        noted = co.annotated(df, name, guard)
        for column in noted.columns:
            refused = []
            for use in (lambda: apply_filters(noted, [Filter(column, "is_not_null")]), lambda: group_keys(noted, Grouping(dimensions={"d": column}))):
                try:
                    use()
                    refused.append(False)
                except co.UnsafeColumnError:
                    refused.append(True)
            found.append((name, column, *refused))
    return spark.createDataFrame(found, "table_name string, column_name string, refused_filter boolean, refused_dimension boolean")


REFUSED_SQL = f"select table_name, column_name, not allowed as refused_filter, not allowed as refused_dimension from ({GUARD_SQL})"


def retyped_columns(spark, folder):
    return prof.retype_profile(profiles(spark, folder), dictionary(spark, folder), domains(spark, folder)).select(
        "table_name", "column_name", "inferred_type", "type_confidence"
    )


RETYPED_SQL = f"""with {DOMAINS_CTE},
t as (select p.table_name, p.column_name, p.inferred_type, p.type_confidence,
      case when p.inferred_type in ('date', 'datetime') then p.inferred_type
           when contains(lower(d.source_type), 'timestamp') or contains(coalesce(semantic_type, ''), 'timestamp') then 'datetime'
           when lower(d.source_type) = 'date' or ends_with(coalesce(semantic_type, ''), '_date') or domain = 'interaction.time' then 'date' else p.inferred_type end as target
      from p join dict d on lower(p.column_name) = d.column_key join dom on dom.table_name = p.table_name and dom.column_name = p.column_name)
select table_name, column_name, target as inferred_type, case when target <> inferred_type then greatest(type_confidence, 0.8) else type_confidence end as type_confidence from t"""

RELATION_COLUMNS = ("table_name", "relationship_type", "source_column", "target_column", "confidence", "method", "relationship_id")


def _relation(kind: str, source: str, target: str, confidence: str, method: str) -> str:
    identity = f"'{kind}' || '|' || table_name || '|' || {source} || '|->|' || coalesce({target}, '')"
    return (
        f"select table_name, '{kind}' as relationship_type, {source} as source_column, cast({target} as varchar) as target_column, "
        f"round({confidence}, 6) as confidence, '{method}' as method, 'rel-' || substr(sha256({identity}), 1, 16) as relationship_id"
    )


RATIO = "(distinct_values / cast(non_null_count as double))"
IDENTIFIERS_SQL = _relation("identifier", "column_name", "null", f"least(1.0, {RATIO})", "exact_distinct_ratio") + f" from p where non_null_count > 0 and {RATIO} >= 0.995"
CATEGORICAL_SQL = _relation("categorical_dimension", "column_name", "null", f"least(0.95, 1.0 - {RATIO})", "exact_distinct_ratio") + f" from p where distinct_values > 1 and {RATIO} <= 0.05"
DURATION_PAIRS_SQL = _relation("transcript_duration", "a", "b", "least(0.9, fa, fb)", "domain_and_coverage") + """
 from (select x.table_name, x.column_name as a, y.column_name as b, x.fill_rate as fa, y.fill_rate as fb from pd x join pd y using (table_name)
       where x.domain = 'conversation.transcript' and y.domain = 'interaction.duration' and least(x.fill_rate, y.fill_rate) >= 0.8)"""
SPEAKER_PAIRS_SQL = _relation("speaker_structure", "a", "b", "least(0.9, fa, fb)", "speaker_pattern_and_domain") + """
 from (select x.table_name, x.column_name as a, y.column_name as b, x.fill_rate as fa, y.fill_rate as fb from pd x join pd y using (table_name)
       where contains(x.detected_patterns, 'speaker_labels') and y.domain = 'conversation.speaker' and x.column_name <> y.column_name)"""
RELATIONS_CTE = f"""{DOMAINS_CTE}, pd as (select p.*, domain from p join dom using (table_name, column_name)),
rel as ({IDENTIFIERS_SQL} union all {CATEGORICAL_SQL} union all {DURATION_PAIRS_SQL} union all {SPEAKER_PAIRS_SQL})"""


def identifier_candidates(spark, folder):
    return relationships.identifier_candidates(profiles(spark, folder)).select(*RELATION_COLUMNS)


def categorical_dimensions(spark, folder):
    return relationships.categorical_dimensions(profiles(spark, folder)).select(*RELATION_COLUMNS)


def transcript_duration_pairs(spark, folder):
    return relationships.transcript_duration_pairs(profiles(spark, folder), domains(spark, folder)).select(*RELATION_COLUMNS)


def speaker_structure_pairs(spark, folder):
    return relationships.speaker_structure_pairs(profiles(spark, folder), domains(spark, folder)).select(*RELATION_COLUMNS)


def ranked_relationships(spark, folder):
    return relationships.discover(profiles(spark, folder), domains(spark, folder)).select(*RELATION_COLUMNS)


# ---- signals and applicability ---------------------------------------------------------------------


def profile_observations(spark, folder):
    return signals.profile_observations(profiles(spark, folder), domains(spark, folder))


TOP_COUNTS_SQL = "tops as (" + " union all ".join(
    f"select '{t}' as table_name, '{c}' as column_name, max(n) as top_count from (select count(*) as n from {SOURCES[t]} where not {missing_sql(c, k)} group by {c})"
    for t, columns in SCHEMAS.items()
    for c, k in columns.items()
) + ")"
OBSERVATIONS_CTE = f"""{DOMAINS_CTE}, {TOP_COUNTS_SQL},
obs as (select 'fill_rate' as check_name, 'fill_rate' as metric_name, p.table_name, p.column_name, domain, fill_rate as value, row_count as sample_size,
               1.0::double as confidence, true as exact, cast(null as bigint) as distinct_topics from p join dom using (table_name, column_name)
        union all
        select 'topic_distribution', 'dominant_topic_share', p.table_name, p.column_name, domain, least(1.0, top_count / cast(non_null_count as double)), non_null_count,
               0.75::double, false, case when distinct_values <= 50000 then distinct_values end
        from p join dom using (table_name, column_name) join tops using (table_name, column_name) where domain = 'conversation.topic' and non_null_count > 0)
"""
OBSERVATIONS_SQL = f"with {OBSERVATIONS_CTE} select * from obs"


def emptiness_observations(profiles_of, domains_of):
    """An extractor of one's own: the share of blank texts in every text column."""
    share = F.try_divide(F.col("text.blank_count").cast("double"), F.col("row_count").cast("double"))
    known = profiles_of.where("source_type = 'string'").join(domains_of.select("table_name", "column_name", "domain"), ["table_name", "column_name"])
    return known.select(
        "table_name", "column_name", "domain", F.lit("blank_share").alias("check_name"), F.lit("blank_share").alias("metric_name"), share.alias("value"),
        F.col("row_count").alias("sample_size"), F.lit(1.0).alias("confidence"), F.lit(True).alias("exact"), F.lit(None).cast("bigint").alias("distinct_topics"))


def observations_of_two_extractors(spark, folder):
    """Observations by check, from the built-in extractor and one of the caller's own."""
    observed = signals.observe(profiles(spark, folder), domains(spark, folder), (signals.profile_observations, emptiness_observations))
    return observed.groupBy("table_name", "check_name", "metric_name").agg(
        F.count(F.lit(1)).alias("observations"), F.sum("sample_size").alias("sample_total"), F.round(F.sum("value"), 8).alias("value_total"))


TWO_EXTRACTORS_SQL = f"""with {OBSERVATIONS_CTE},
both_of as (select table_name, check_name, metric_name, value, sample_size from obs
            union all select table_name, 'blank_share', 'blank_share', case when row_count > 0 then blank_count / cast(row_count as double) end, row_count from p where source_type = 'string')
select table_name, check_name, metric_name, count(*) as observations, cast(sum(sample_size) as bigint) as sample_total, round(sum(value), 8) as value_total from both_of group by all"""


def detected_signals(spark, folder):
    return signals.detect(profiles(spark, folder), domains(spark, folder), signals.policy_table(spark)).select(
        "signal_id", "policy_id", "table_name", "column_name", "signal_type", "severity", "confidence", "observed_value", "threshold", "message"
    )


SIGNALS_SQL = f"""with {OBSERVATIONS_CTE},
strong as (select * from obs where check_name = 'fill_rate' or (distinct_topics >= 2 and sample_size >= 100)),
banded as (select *, case when check_name = 'fill_rate' then 'fill-rate' else 'topic-concentration' end as policy_id,
           case when check_name = 'fill_rate' then (case when value < 0.8 then 0.8 when value < 0.95 then 0.95 when value < 0.99 then 0.99 end)
                else (case when value > 0.95 then 0.95 when value > 0.8 then 0.8 end) end as threshold from strong)
select 'sig-' || substr(sha256(policy_id || '|' || metric_name || '|' || table_name || '|' || column_name), 1, 16) as signal_id, policy_id, table_name, column_name,
       case when policy_id = 'fill-rate' then 'LOW_FILL_RATE' when threshold > 0.9 then 'EXTREME_TOPIC_CONCENTRATION' else 'HIGH_TOPIC_CONCENTRATION' end as signal_type,
       case when policy_id = 'fill-rate' then (case when threshold < 0.9 then 'critical' when threshold < 0.98 then 'high' else 'medium' end)
            else (case when threshold > 0.9 then 'high' else 'medium' end) end as severity,
       confidence, round(value, 8) as observed_value, cast(threshold as double) as threshold,
       case when policy_id = 'fill-rate' then printf('Column %s is filled at %.2f%%, below the expected %.2f%%.', column_name, cast(value * 100 as double), cast(threshold * 100 as double))
            else printf('In column %s one topic covers %.2f%% of rows, above the expected %.2f%%.', column_name, cast(value * 100 as double), cast(threshold * 100 as double)) end as message
from banded where threshold is not null"""


def suppressed_observations(spark, folder):
    matched = signals.with_policies(signals.observe(profiles(spark, folder), domains(spark, folder)), signals.policy_table(spark))
    _, weak = signals.suppress_weak(matched, minimum_rows=12000)
    return weak.select("table_name", "column_name", "metric_name", "suppressed_because")


SUPPRESSED_SQL = f"""with {OBSERVATIONS_CTE}
select table_name, column_name, metric_name, case when distinct_topics is null or distinct_topics < 2 then 'distinct-topic coverage is insufficient' else 'the sample is too small' end as suppressed_because
from obs where check_name = 'topic_distribution' and (distinct_topics is null or distinct_topics < 2 or sample_size < 12000)"""


def check_coverage(spark, folder):
    return signals.check_coverage(profile_observations(spark, folder))


COVERAGE_SQL = f"""with {OBSERVATIONS_CTE}, n as (select check_name, count(*) as c from obs group by 1)
select k.check_name, c is not null as available, case when c is null then 'must be measured on the rows' else 'observed in the profile' end as reason, coalesce(c, 0) as observation_count
from (select unnest({_list(fixed.REQUIRED_CHECKS)}) as check_name) k left join n using (check_name)"""

SELECTORS = [
    ap.Selector("fill_rate", column_name_patterns=("(^|_)(id|key|date)$", "type$"), excluded_column_patterns=("^l_",)),
    ap.Selector("topic_distribution", required_domains=("conversation.topic",), minimum_domain_confidence=0.58),
    ap.Selector("agent_speaker_tag_validation", required_relationship_types=("speaker_structure",)),
    ap.Selector("speech_per_duration_rate", required_relationship_types=("transcript_duration",), semantic_types=("transcript_length",), match_mode="all"),
    ap.Selector("pii_detection", required_domains=("conversation.transcript", "party.customer"), column_name_patterns=("text",), match_mode="all"),
    ap.Selector("mistranslated_rate", required_domains=("*",), enabled=False),
    ap.Selector("non_english_spelling", required_domains=("conversation.transcript",), approved=False),
]


def rule_applicability(spark, folder):
    found = domains(spark, folder)
    related = relationships.discover(profiles(spark, folder), found)
    decided = ap.rule_applicability(SELECTORS, profiles(spark, folder), found, related)
    return decided.withColumns(
        {name: F.array_join(name, ",") for name in ("target_columns", "matched_domains")}
    ).withColumn("confidence", F.round("confidence", 5))


APPLICABILITY_SQL = f"""with {RELATIONS_CTE},
kept as (select * from rel order by confidence desc, relationship_id limit 250),
ends as (select table_name, relationship_type, source_column as column_name from kept union select table_name, relationship_type, target_column from kept where target_column is not null),
c as (select d.*, exists(select 1 from ends e where e.table_name = d.table_name and e.column_name = d.column_name and relationship_type = 'speaker_structure') as in_speaker,
             exists(select 1 from ends e where e.table_name = d.table_name and e.column_name = d.column_name and relationship_type = 'transcript_duration') as in_pair from dom d),
t as (
  select 'fill_rate' as rule_id, * from c where regexp_matches(column_name, '(?i)(^|_)(id|key|date)$|type$') and not regexp_matches(column_name, '(?i)^l_')
  union all select 'topic_distribution', * from c where domain = 'conversation.topic' and confidence >= 0.58
  union all select 'agent_speaker_tag_validation', * from c where in_speaker
  union all select 'speech_per_duration_rate', * from c where in_pair and coalesce(semantic_type, '') = 'transcript_length'
  union all select 'pii_detection', * from c where domain in ('conversation.transcript', 'party.customer') and contains(column_name, 'text')
  union all select 'mistranslated_rate', * from c
  union all select 'non_english_spelling', * from c where domain = 'conversation.transcript'),
f as (select table_name, rule_id, string_agg(distinct column_name, ',' order by column_name) as target_columns, string_agg(distinct domain, ',' order by domain) as matched_domains,
             round(avg(confidence), 5) as mean_confidence from t group by 1, 2)
select x.table_name, r.rule_id, case when r.rule_id = 'mistranslated_rate' then 'disabled' when r.rule_id = 'non_english_spelling' then 'needs_review'
       when target_columns is null then 'not_applicable' else 'applicable' end as status,
       case when r.rule_id <> 'mistranslated_rate' and target_columns is not null then mean_confidence else 1.0 end as confidence,
       coalesce(target_columns, '') as target_columns, coalesce(matched_domains, '') as matched_domains
from (select distinct table_name from p) x, (select unnest({_list([s.rule_id for s in SELECTORS])}) as rule_id) r
left join f on f.table_name = x.table_name and f.rule_id = r.rule_id"""

QUERIES = {
    "column_statistics": column_statistics,
    "column_distinct_counts": distinct_counts,
    "column_top_values": top_values,
    "column_samples": hashed_samples,
    "column_quantiles_of_distinct_values": _quantiles(True),
    "column_quantiles_of_rows": _quantiles(False),
    "all_column_quantiles_of_distinct_values": _quantiles(True, ALL_QUANTILE_TABLES),
    "all_column_quantiles_of_rows": _quantiles(False, ALL_QUANTILE_TABLES),
    "sketched_distinct_counts": sketched_distinct_counts,
    "sketched_top_values": sketched_top_values,
    "sketched_samples": sketched_samples,
    "merged_sketch_quantiles": merged_sketch_quantiles,
    "text_type_shares": text_type_shares,
    "column_dictionary": column_dictionary,
    "part_dictionary": part_dictionary,
    "dictionary_gaps": dictionary_gaps,
    "domain_scores": domain_scores,
    "column_domains": column_domains,
    "grouping_guard": grouping_guard,
    "retyped_columns": retyped_columns,
    "refused_columns": refused_columns,
    "observations_of_two_extractors": observations_of_two_extractors,
    "identifier_candidates": identifier_candidates,
    "categorical_dimensions": categorical_dimensions,
    "transcript_duration_pairs": transcript_duration_pairs,
    "speaker_structure_pairs": speaker_structure_pairs,
    "ranked_relationships": ranked_relationships,
    "profile_observations": profile_observations,
    "detected_signals": detected_signals,
    "suppressed_observations": suppressed_observations,
    "check_coverage": check_coverage,
    "rule_applicability": rule_applicability,
}
ORACLES = {
    "column_statistics": COLUMN_STATISTICS_SQL,
    "column_distinct_counts": DISTINCT_SQL,
    "column_top_values": TOP_SQL,
    "column_samples": SAMPLES_SQL,
    "column_quantiles_of_distinct_values": QUANTILES_SQL[True],
    "column_quantiles_of_rows": QUANTILES_SQL[False],
    "all_column_quantiles_of_distinct_values": ALL_QUANTILES_SQL[True],
    "all_column_quantiles_of_rows": ALL_QUANTILES_SQL[False],
    "sketched_distinct_counts": SKETCHED_DISTINCT_SQL,
    "sketched_top_values": TOP_SQL,
    "sketched_samples": SAMPLES_SQL,
    "merged_sketch_quantiles": MERGED_QUANTILES_SQL,
    "text_type_shares": TYPE_SHARES_SQL,
    "column_dictionary": DICTIONARY_SQL,
    "part_dictionary": PART_DICTIONARY_SQL,
    "dictionary_gaps": GAPS_SQL,
    "domain_scores": DOMAIN_SCORES_SQL,
    "column_domains": DOMAINS_SQL,
    "grouping_guard": GUARD_SQL,
    "retyped_columns": RETYPED_SQL,
    "refused_columns": REFUSED_SQL,
    "observations_of_two_extractors": TWO_EXTRACTORS_SQL,
    "identifier_candidates": f"with {PROFILE_CTE} {IDENTIFIERS_SQL}",
    "categorical_dimensions": f"with {PROFILE_CTE} {CATEGORICAL_SQL}",
    "transcript_duration_pairs": f"with {RELATIONS_CTE} select * from rel where relationship_type = 'transcript_duration'",
    "speaker_structure_pairs": f"with {RELATIONS_CTE} select * from rel where relationship_type = 'speaker_structure'",
    "ranked_relationships": f"with {RELATIONS_CTE} select * from rel",
    "profile_observations": OBSERVATIONS_SQL,
    "detected_signals": SIGNALS_SQL,
    "suppressed_observations": SUPPRESSED_SQL,
    "check_coverage": COVERAGE_SQL,
    "rule_applicability": APPLICABILITY_SQL,
}
