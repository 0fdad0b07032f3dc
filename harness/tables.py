"""Test tables and the inputs derived from them.

Derived inputs use the same expressions in Spark and in the comparison SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.readers import read_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

LONG_TEXTS = ("documents", "pages", "conversations")

EVENTS_FILL = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "event_type": "case when user_id % 9 = 0 then 'N/A' else event_type end",
    "value": "case when value < 20 then null else value end",
    "props": "case when user_id % 7 = 0 then ' none ' else props end",
}
EVENTS_BAD_TIME = {
    "event_id": "event_id",
    "moment": "case when event_id % 50 = 0 then 'bad' else cast(ts as string) end",
    "event_type": "case when user_id % 9 = 0 then null else event_type end",
    "cents": "cast(round(value * 100) as bigint)",
}
CALLS = {
    "call_id": "doc_id",
    "lang": "lang",
    "source": "source",
    "transcript": (
        "case when doc_id % 13 = 0 then null when doc_id % 17 = 0 then '   ' when doc_id % 11 = 0 then text "
        "else concat('Agent: ', replace(text, chr(10), concat(chr(10), 'Customer: ')), "
        "case when doc_id % 5 = 0 then concat(chr(10), 'Agent:') else '' end) end"
    ),
    "duration_ms": "cast(doc_id % 7 * 20000 as double)",
    "call_month": "cast(1 + doc_id % 6 as bigint)",
}
ORDER_TOPICS = {
    "o_orderkey": "o_orderkey",
    "o_orderdate": "o_orderdate",
    "parity": "cast(o_custkey % 2 as string)",
    "topic": "concat(o_orderpriority, ';', o_orderstatus)",
}
TOPIC_ONTOLOGY = (
    (10, "Pressing", ("urgent", "high")),
    (20, "Routine", ("medium", "low")),
    (30, "Open", ("^o$",)),
    (40, "Done", ("^f$",)),
)
LEXICON = {"domain_term": ("the of", "ition"), "domain_phrase": ("and the", "le la", "of the of")}
SALT = b"test-salt"
SOURCE = "documents"


def load(spark: SparkSession, folder: str, name: str, spread: bool | None = None) -> DataFrame:
    wanted = name in LONG_TEXTS if spread is None else spread
    return read_table(spark, f"{folder.rstrip('/')}/{name}.parquet", spread=wanted)


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in columns.items()])


def sql(columns: dict[str, str], table: str) -> str:
    """The same derivation for the comparison engine."""
    listed = ", ".join(f"{text} as {name}" for name, text in columns.items())
    return f"select {listed} from {table}"


def events_fill(spark: SparkSession, folder: str, spread: bool | None = None) -> DataFrame:
    return derived(load(spark, folder, "events", spread), EVENTS_FILL)


def events_bad_time(spark: SparkSession, folder: str) -> DataFrame:
    return derived(load(spark, folder, "events"), EVENTS_BAD_TIME)


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as call transcripts: every line a turn, some untagged, blank, null or ending in an empty turn."""
    return as_calls(load(spark, folder, "documents"))


def as_calls(documents: DataFrame) -> DataFrame:
    made = derived(documents, CALLS)
    month = F.format_string("2024-%02d-01", F.col("call_month"))
    return made.withColumn("call_day", month.cast("date")).drop("call_month")


CALLS_SQL = (
    "select call_id, lang, source, transcript, duration_ms, make_date(2024, call_month::int, 1) as call_day from ("
    + sql(CALLS, "documents")
    + ")"
)


def order_topics(spark: SparkSession, folder: str) -> DataFrame:
    return derived(load(spark, folder, "orders"), ORDER_TOPICS)


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Two consecutive turns of a conversation as one transcript; turn numbers make the keys unique."""
    turns = load(spark, folder, "conversations").where(F.col("text").isNotNull())
    label = F.initcap(F.replace(F.replace("role", F.lit("assistant"), F.lit("agent")), F.lit("user"), F.lit("customer")))
    line = F.concat(label, F.lit(": "), F.col("text"))
    first = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), line.alias("first_line"))
    second = turns.select("conv_id", "turn", line.alias("second_line"))
    return first.join(second, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.concat_ws("\n", "first_line", "second_line").alias("transcript")
    )


EXCHANGES_SQL = """
select b.conv_id, b.turn, a.line || chr(10) || b.line as transcript
from (select conv_id, turn + 1 as turn, case role when 'assistant' then 'Agent' when 'user' then 'Customer' else 'System' end || ': ' || text as line from conversations) a
join (select conv_id, turn, case role when 'assistant' then 'Agent' when 'user' then 'Customer' else 'System' end || ': ' || text as line from conversations) b
on a.conv_id = b.conv_id and a.turn = b.turn
"""
