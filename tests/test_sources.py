import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import applicability
from parlance.operators.grouping import Grouping
from parlance.operators.rules import base, fill_rate
from parlance.sources import readers, sinks, storage


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "calls.csv"
    path.write_bytes(
        b'id,transcript,score,when,flag\n1,"Agent: hi, ""you""\nCustomer: yo",1.5,2024-01-05,true\n\n'
        b"2,caf\xe9 \xff,2,2024-01-06,false\n3,x,oops,2024-01-07,true\n4,short\n"
    )
    return str(path)


SCHEMA = "id bigint, transcript string, score double, when string, flag boolean"


def test_csv(spark, csv):
    rows = {row["id"]: row for row in readers.read_transcripts(spark, csv, SCHEMA).collect()}
    assert len(rows) == 4 and rows[1]["transcript"] == 'Agent: hi, "you"\nCustomer: yo'
    assert "�" in rows[2]["transcript"]
    assert rows[3]["_corrupt_line"] and rows[4]["_corrupt_line"] and not rows[1]["_corrupt_line"]
    counted = readers.count_bad_lines(readers.read_transcripts(spark, csv, SCHEMA).cache()).first()
    assert tuple(counted) == (4, 2)
    assert {row["id"] for row in readers.read_transcripts(spark, csv, SCHEMA, bad_lines="skip").collect()} == {1, 2}
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        readers.read_transcripts(spark, csv, SCHEMA, bad_lines="error").collect()
    with pytest.raises(ValueError):
        readers.read_transcripts(spark, csv, "a int, A int")


def test_inferred_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a;b;c;d;e\n1;1.5;x;2024-01-01;true\n2;2;y;2024-01-02;false\n")
    found = readers.infer_schema(spark, str(path), separator=";")
    assert [(item.name, item.dataType.simpleString()) for item in found] == [
        ("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "string"), ("e", "boolean"),
    ]


def test_parquet_and_spreading(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).coalesce(1).write.parquet(path)
    assert readers.read_transcripts(spark, path).count() == 100
    assert readers.read_table(spark, path, spread=True).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "Exchange" not in plan(readers.read_table(spark, path, spread=True, small_input_bytes=1))


def test_a_large_row_group_is_spread(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10_000).coalesce(1).write.parquet(path)
    spread = readers.read_table(spark, path, spread=True, small_input_bytes=1, split_bytes=5_000)
    assert "Exchange" in plan(spread) and spread.count() == 10_000
    assert spread.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dictionary(spark, tmp_path):
    path = tmp_path / "dictionary.csv"
    path.write_text(
        "Field Name,Business-Name,Description,DATA TYPE,Is Mandatory,Nullable,Contains PII,Source\n"
        "call_id,Call ID,The id of a call,INT64,,no,No,feed\n"
        "Source: feed,,,,,,,\n,,,,,,,\n"
        "CALL_ID,again,,string,,,,\n"
        "text,,What was said,str,Yes,Yes,TRUE,\n"
        "day,,,weird,,maybe,,\n"
    )
    found = {row["column_key"]: row for row in readers.read_dictionary(spark, str(path)).collect()}
    assert set(found) == {"call_id", "text", "day"}
    call = found["call_id"]
    assert (call["logical_type"], call["mandatory"], call["sensitive"], call["lineage"]) == ("integer", True, False, "feed")
    assert call["business_terms"] == ["call", "id"]
    assert (found["text"]["mandatory"], found["text"]["sensitive"], found["text"]["logical_type"]) == (True, True, "string")
    assert (found["day"]["mandatory"], found["day"]["logical_type"], found["day"]["description"]) == (None, "unknown", None)
    with pytest.raises(ValueError):
        readers.normalize_dictionary(spark.createDataFrame([(1, "x")], "line int, other string"), "line")


RULE = {
    "rule_id": "fill_rate", "version": "1.0.0", "check_name": "fill_rate", "title": "Fill rate", "enabled": True, "lifecycle": "approved", "approved_by": "owner",
    "selector": {"column_name_patterns": ["_id$"], "minimum_domain_confidence": 0.4},
    "parameters": {"minimum": {"parameter_type": "number", "description": "d", "required": True, "default": 0.9, "minimum": 0.0, "maximum": 1.0}},
}


def write_rules(folder, *changes):
    (folder / "deep").mkdir(exist_ok=True)
    for position, change in enumerate(changes):
        (folder / "deep" / f"rule{position}.json").write_text(json.dumps({**RULE, **change}, indent=1))
    return str(folder)


def test_rules(spark, tmp_path):
    found = readers.read_rules(spark, write_rules(tmp_path, {}, {"rule_id": "old", "enabled": False}))
    assert found.count() == 2
    chosen = {item.rule_id: item for item in applicability.selectors(found)}
    assert chosen["fill_rate"].column_name_patterns == ("_id$",) and chosen["fill_rate"].approved and not chosen["old"].enabled


@pytest.mark.parametrize(
    ("changes", "problem"),
    [
        (({}, {"enabled": False}), "version occurs twice"),
        (({}, {"rule_id": "other"}), "more than one active"),
        (({"approved_by": None},), "needs an approver"),
        (({"suggested_by_model": True},), "needs an approver"),
        (({"depends_on": ["fill_rate"]},), "depend on itself"),
        (({"parameters": {"p": {"parameter_type": "number", "required": True}}},), "no default"),
        (({"parameters": {"p": {"parameter_type": "number", "default": "x"}}},), "wrong type"),
        (({"parameters": {"p": {"parameter_type": "integer", "default": 1.5}}},), "wrong type"),
        (({"parameters": {"p": {"parameter_type": "number", "default": 2, "maximum": 1.0}}},), "outside its bounds"),
        (({"parameters": {"p": {"parameter_type": "number", "default": 2, "minimum": 3.0, "maximum": 1.0}}},), "exceeds its maximum"),
    ],
)
def test_refused_rules(spark, tmp_path, changes, problem):
    with pytest.raises(ValueError, match=problem):
        readers.read_rules(spark, write_rules(tmp_path, *changes))


def test_good_parameters(spark, tmp_path):
    parameters = {
        "a": {"parameter_type": "string_list", "default": ["x"]}, "b": {"parameter_type": "boolean", "default": False},
        "c": {"parameter_type": "integer", "default": 3, "minimum": 1.0}, "d": {"parameter_type": "string", "default": "x"}, "e": {"parameter_type": "number"},
    }
    assert readers.read_rules(spark, write_rules(tmp_path, {"parameters": parameters})).count() == 1


def test_tables_become_options(spark, tmp_path):
    parameters = {"maximum_record_rate": {"parameter_type": "number", "default": 0.5}, "categories": {"parameter_type": "string_list", "default": ["email"]},
                  "unset": {"parameter_type": "number"}}
    rules = readers.read_rules(spark, write_rules(tmp_path, {"rule_id": "pii_detection", "parameters": parameters}, {"rule_id": "off", "enabled": False, "parameters": parameters}))
    assert readers.rule_options(rules) == {"pii_detection": {"maximum_record_rate": 0.5, "categories": ["email"]}}
    terms = spark.createDataFrame([("a", ["b", "c"], "x"), ("d", ["b"], "x"), ("e", [], "y")], "canonical_term string, suspected_forms array<string>, category string")
    assert readers.lexicon_of(terms) == {"x": ("b", "c")}


def test_lookup(spark, tmp_path):
    path = tmp_path / "lexicon.json"
    path.write_text('{"canonical_term": "a", "suspected_forms": ["b"], "category": "c"}\n{"canonical_term": "d", "suspected_forms": [], "category": "c", "enabled": false}\n')
    assert [row["canonical_term"] for row in readers.read_lookup(spark, "lexicon", str(path)).collect()] == ["a"]


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_written_metrics(spark, tmp_path, form):
    df = spark.createDataFrame([("x", "2024-01-01"), (None, "2024-02-01")], "c string, day string")
    table = base.run_rules(df, [fill_rate.fill_rate_rule(df, ["c"])], Grouping("day", "month"))
    path = str(tmp_path / form)
    sinks.write_metrics(table, path, form)
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    back = reader.format(form).load(path)
    assert back.count() == table.count() and {"rule_id", "is_overall", "reporting_name"} <= set(back.columns)
    assert (tmp_path / form / "rule_id=fill_rate" / "is_overall=true").is_dir()


def test_redaction_checks(spark):
    good = spark.createDataFrame([("0" * 16, "sha256:" + "a" * 64)], "value_hash string, row_fingerprint string")
    assert sinks.assert_redacted(good, hashed=("value_hash",), fingerprints=("row_fingerprint",)) is good
    for df, options in (
        (spark.createDataFrame([("x",)], "transcript string"), {}),
        (spark.createDataFrame([("raw",)], "value_hash string"), {"hashed": ("value_hash",)}),
        (spark.createDataFrame([(None,)], "row_fingerprint string"), {"fingerprints": ("row_fingerprint",)}),
    ):
        with pytest.raises(sinks.RedactionError):
            sinks.assert_redacted(df, **options)
    with pytest.raises(ValueError):
        sinks._write(good, "x", "xml")


def test_profile_tables(spark, tmp_path):
    sinks.write_profile_tables({"a": spark.range(3), "b": spark.createDataFrame([("0" * 16,)], "sample_hash string")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3


def test_own_tables_are_written(spark, tmp_path):
    from parlance.operators import signals
    from parlance.operators.applicability import Selector
    from parlance.plans import assessment

    df = spark.createDataFrame([("Agent: hi", 1.0, "x"), ("Customer: yo", 2.0, None)], "transcript string, duration double, topic string")
    tables = assessment.understand({"calls": df}, signals.policy_table(spark), [Selector("pii_detection", required_domains=("conversation.transcript",))])
    sinks.write_profile_tables(tables, str(tmp_path))
    for name, table in tables.items():
        assert spark.read.parquet(str(tmp_path / name)).count() == table.count()
    hidden = spark.createDataFrame([(("raw",),)], "outer struct<transcript: string>")
    with pytest.raises(sinks.RedactionError):
        sinks.assert_redacted(hidden)


def test_materialize_cuts_lineage(spark):
    stored = storage.materialize(spark.range(10).select(F.rand().alias("x")), "t")
    assert stored.collect() == stored.collect()
    assert isinstance(stored.schema["x"].dataType, T.DoubleType)


def test_csv_records_over_many_blocks(spark, tmp_path):
    """Records with line breaks, doubled quotes, blank lines and fields longer than a block, read by many tasks."""
    import csv
    import random

    chance = random.Random(2)
    pieces = ["a", "b,", "\n", "\n\n", '"', '""', " ", "é", "\r\n", "long " * 60]
    rows = [(i, "".join(chance.choice(pieces) for _ in range(chance.randint(1, 12)))) for i in range(300)]
    (tmp_path / "in").mkdir()
    for number, part in enumerate((rows[:1], rows[1:250], rows[250:])):
        with open(tmp_path / "in" / f"{number}.csv", "w", newline="") as target:
            writer = csv.writer(target, lineterminator="\r\n" if number == 2 else "\n", quoting=csv.QUOTE_ALL)
            writer.writerow(["id", "text"])
            writer.writerows(part)
            target.write("\n \n" if number == 1 else "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        read = readers.read_split_csv(spark, str(tmp_path / "in"), "id int, text string")
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
        found = read.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(row["_corrupt_line"] is None for row in found)
    assert sorted((row["id"], row["text"]) for row in found) == rows


def test_bad_records_of_split_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"x\ny"\n2,z,too,many\nthree,"w"\n')
    schema = "id int, text string"
    kept = readers.read_split_csv(spark, str(tmp_path / "a.csv"), schema).collect()
    assert [row["id"] for row in kept if row["_corrupt_line"] is None] == [1] and len(kept) == 3
    assert [tuple(row) for row in readers.read_split_csv(spark, str(tmp_path / "a.csv"), schema, "skip").collect()] == [(1, "x\ny")]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.read_split_csv(spark, str(tmp_path / "a.csv"), schema, "error").collect()
