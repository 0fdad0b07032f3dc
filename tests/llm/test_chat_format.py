"""Folding of event logs, and reversible rendering."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from parlance.llm import chat_format
from parlance.llm.queries import ORACLES, PROBE, op9_chat_events

FOLDER = "/root/testdata/sf0.001"


def test_query(spark):
    turns: dict = {-7: [(0, "user", PROBE), (1, "assistant", PROBE)]}
    for row in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        turns.setdefault(row["conv_id"], []).append((row["turn"], row["role"], row["text"] or ""))
    found = {row["conv_id"]: row for row in op9_chat_events(spark, FOLDER).collect()}
    assert set(found) == set(turns)
    for key, rows in turns.items():
        rows.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        loss = "".join(text for _, role, text in rows if role == "assistant")
        row = found[key]
        assert row["n_turns"] == len(rows)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row["formatted_chars"] >= len(whole)


def folded(spark, events):
    df = spark.createDataFrame(events, "conversation bigint, turn bigint, seq bigint, kind string, role string, text string")
    df = df.withColumn("log", F.lit(1)).repartition(3)
    return sorted((tuple(row) for row in chat_format.fold_events(df).collect()), key=repr)


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "open", "user", "he"), (1, 0, 1, "delta", None, "llo"), (1, 0, 5, "edit", None, "bye"), (1, 0, 6, "delta", None, "!"),
        (1, 1, 0, "open", "assistant", None), (1, 1, 1, "delta", None, "bad"), (1, 1, 2, "regenerate", None, "x"),
        (1, 1, 3, "delta", None, "go"), (1, 1, 4, "delta", None, "od"), (2, 0, 0, "open", "user", "a"), (2, 0, 1, "open", "system", "b"),
        (2, 1, None, None, None, None), (None, None, 1, "delta", None, "n"), (3, 0, 1, "delta", None, "r"), (3, 0, 1, "delta", None, "r"),
    ]
    assert folded(spark, events) == sorted([
        (1, 0, "user", "bye!"), (1, 1, "assistant", "good"), (2, 0, "system", "b"), (2, 1, "", ""), (None, None, "", "n"),
        (3, 0, "", "rr")], key=repr)
    assert folded(spark, []) == []


def test_rendering_is_reversible(spark):
    texts = [
        "", "\\", "<s>", "[INST]", chat_format.TURN_CLOSE, chat_format.ROLE_CLOSE, "a\\[b\\<c\\\\", "\n\n", "]<", "]\\", "\U0001f600é[",
        "x" * 3000, "<[" * 2000, "$1 \\1 (?s)",
    ]
    rows = [(i // 4, i, "assistant" if i % 2 else f"r[{i}]\\", text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "conversation bigint, turn bigint, role string, text string")
    found = chat_format.parse(chat_format.render(df)).orderBy("conversation").collect()
    got = [(row["conversation"], turn["role"], turn["text"]) for row in found for turn in row["turns"]]
    assert got == [(c, role, text) for c, _, role, text in rows]
    for row in found:
        own = [text for c, _, role, text in rows if c == row["conversation"] and role == "assistant"]
        assert row["loss_text"] == "".join(own) and len(row["loss_spans"]) == len(own)


def test_streamed_turns_fold_back(spark):
    rows = [(1, 0, "user", "é" * 1000), (1, 1, None, None), (1, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("seq", F.lit(9))
    events = chat_format.events_from_turns(df, delta_chars=7)
    assert events.count() == 3 + 143
    found = sorted(tuple(row) for row in chat_format.fold_events(events).collect())
    assert found == [(1, 0, "user", "é" * 1000), (1, 1, "", ""), (1, 2, "assistant", "")]


def test_no_python_in_the_plan(spark):
    plan = op9_chat_events(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_every_row_of_a_turn_is_a_message(spark, tmp_path):
    rows = [
        (1, 0, "user", "a" * 900), (1, 0, "user", "a" * 900), (1, 0, "user", "a" * 900), (1, 1, "assistant", "twice"),
        (2, 5, "user", "b" * 850), (2, 5, "assistant", "c" * 1250), (2, 5, "user", "B" * 401), (2, 4, "assistant", "é<["),
        (3, None, "user", "n" * 500), (3, None, "assistant", "m" * 700), (3, None, "user", "n" * 500), (3, None, None, None),
        (3, 0, "assistant", "placed"), (None, None, "user", "x"), (None, None, "user", "x"), (None, 1, None, None), (None, 1, "", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    engine = duckdb.connect()
    engine.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = engine.execute(ORACLES["op9_chat_events"])
    names = [item[0] for item in want.description]
    found = op9_chat_events(spark, str(tmp_path)).select(*names).collect()
    assert sorted((tuple(row) for row in found), key=repr) == sorted(want.fetchall(), key=repr)
    assert {row["conv_id"]: row["n_turns"] for row in found} == {1: 4, 2: 4, 3: 5, None: 4, -7: 2}
