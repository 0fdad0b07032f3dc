"""Event-sourced chat logs folded into final messages and rendered with a reversible template.

Only DataFrame functions are used. A log row is (conversation, turn, seq, kind, role, text), and perhaps (message, copy) to tell
messages of one turn apart, with these kinds:

* ``open``: starts a message with a role and perhaps text; a second one starts it anew;
* ``delta``: appends text to the message;
* ``edit``: replaces the text;
* ``regenerate``: throws the text away, so that later deltas build it again.

`fold_events` partitions the log by conversation, turn and message, sorts by sequence and folds. `render` joins the final messages
of a conversation by turn. Every control string begins with ``<`` or ``[``; inside roles and texts these two and the
backslash are preceded by a backslash, so no text can close a turn, and `parse` gets every role and text back.

Cases: null roles and texts are empty; a null sequence sorts first, equal ones by kind, role and text, so the result does
not depend on row order; a repeated event counts twice, as in the log; a null kind counts as ``delta``; a null turn sorts
last; null conversation ids form one conversation; an empty log gives an empty result. Every row of turns is a message of
its own: rows that repeat a turn, or have none, are ordered by role and text, and equal rows stay as often as they occur. A
log without message and copy has one message per turn. A conversation becomes one row, so its messages must fit in a task,
like any single value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("open", "delta", "edit", "regenerate")
ASSISTANT = "assistant"
# Control strings of the template; none can arise from escaped text, where "<" and "[" always follow a backslash.
TURN_OPEN = "<s>"
ROLE_CLOSE = "<|>[INST]<|>"
TURN_CLOSE = "<|>[/INST]</s>"
DELTA_CHARS = 400
MESSAGE_KEY = ("message", "copy")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_from_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text", delta_chars: int = DELTA_CHARS) -> DataFrame:
    """The log that streaming these turns would have left: an ``open`` event and a ``delta`` for each piece of text.

    Rows are numbered among those of equal content only, so numbers mean the same whatever the row order, a long
    conversation is spread over tasks, and the fold needs no shuffle of its own.
    """
    whole = F.coalesce(turns[text].cast("string"), F.lit(""))
    pieces = F.ceil(F.char_length(whole) / F.lit(delta_chars)).cast("int")
    flat = turns.select(
        turns[conversation].alias("conversation"), turns[turn].alias("turn"),
        F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"), whole.alias("whole"), pieces.alias("pieces"),
    )
    told = flat.withColumn("message", F.sha2(F.concat_ws("\0", "role", "whole"), 256))
    alike = Window.partitionBy("conversation", "turn", "message").orderBy("role")
    keyed = told.withColumn("copy", F.row_number().over(alike))
    numbered = keyed.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces"))).alias("seq"))
    opened = F.col("seq") == 0
    return numbered.select(
        "conversation", "turn", *MESSAGE_KEY, F.col("seq").cast("bigint").alias("seq"),
        F.when(opened, "open").otherwise("delta").alias("kind"),
        F.when(opened, F.col("role")).alias("role"),
        F.when(opened, "").otherwise(
            F.substring(F.col("whole"), (F.col("seq") - 1) * delta_chars + 1, F.lit(delta_chars))
        ).alias("text"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """One row per message, or per conversation and turn if the log names no messages: its final role and text."""
    entry = F.struct(
        "seq", F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    log = F.array_sort(F.collect_list(entry))
    text_type = "struct<role: string, parts: array<string>>"

    def step(state: Column, event: Column) -> Column:
        fresh = F.array(event["text"])
        role = F.when(event["role"] != "", event["role"]).otherwise(state["role"])
        parts = (
            F.when(event["kind"].isin("open", "edit"), fresh)
            .when(event["kind"] == "regenerate", F.array().cast("array<string>"))
            .otherwise(F.concat(state["parts"], fresh))
        )
        return F.struct(role.alias("role"), parts.alias("parts"))

    start = F.struct(F.lit("").alias("role"), F.array().cast("array<string>").alias("parts")).cast(text_type)
    named = [name for name in MESSAGE_KEY if name in events.columns]
    folded = events.groupBy("conversation", "turn", *named).agg(log.alias("log"))
    return folded.select(
        "conversation", "turn",
        F.aggregate("log", start, step, lambda state: F.struct(
            state["role"].alias("role"), F.array_join(state["parts"], "").alias("text"))).alias("message"),
    ).select("conversation", "turn", "message.role", "message.text")


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: the formatted text and the loss mask, as spans of characters of assistant texts."""
    turn = F.struct(F.isnull("turn").alias("unplaced"), "turn", "role", "text")
    ordered = F.array_sort(F.collect_list(turn))
    heads = F.transform("turns", lambda x: F.concat(F.lit(TURN_OPEN), escape(x["role"]), F.lit(ROLE_CLOSE)))
    bodies = F.transform("turns", lambda x: escape(x["text"]))
    pieces = messages.groupBy("conversation").agg(ordered.alias("turns")).select(
        "conversation", F.transform("turns", lambda x: x["role"]).alias("roles"), heads.alias("heads"),
        bodies.alias("bodies"),
    )
    sized = F.zip_with("heads", "bodies", lambda head, body: F.struct(
        F.char_length(head).cast("bigint").alias("head"), F.char_length(body).cast("bigint").alias("body")))
    close = len(TURN_CLOSE)

    def advance(state: Column, item: Column) -> Column:
        begin = state["at"] + item["head"]
        return F.struct(
            (begin + item["body"] + close).alias("at"),
            F.concat(state["spans"], F.array(F.struct(begin.alias("start"), item["body"].alias("length")))).alias("spans"),
        )

    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(
        "array<struct<start: bigint, length: bigint>>").alias("spans"))
    spans = F.aggregate(sized, nothing, advance, lambda state: state["spans"])
    formatted = F.array_join(
        F.zip_with("heads", "bodies", lambda head, body: F.concat(head, body, F.lit(TURN_CLOSE))), "")
    chosen = F.filter(
        F.zip_with("roles", "spans", lambda role, span: F.struct(role.alias("role"), span.alias("span"))),
        lambda x: x["role"] == ASSISTANT,
    )
    return pieces.select("conversation", "roles", formatted.alias("formatted"), spans.alias("spans")).select(
        "conversation", "formatted", F.transform(chosen, lambda x: x["span"]).alias("loss_spans"))


def parse(rendered: DataFrame) -> DataFrame:
    """Read roles and texts, and the unescaped text under the loss mask, back from the formatted text."""
    closed = F.split("formatted", r"<\|>\[/INST\]</s>")
    turns = F.transform(F.slice(closed, 1, F.size(closed) - 1), lambda x: F.split(x, r"<\|>\[INST\]<\|>"))
    start = len(TURN_OPEN) + 1
    return rendered.select(
        "*",
        F.transform(turns, lambda x: F.struct(
            unescape(F.substring(x[0], F.lit(start), F.char_length(x[0]))).alias("role"),
            unescape(x[1]).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda x: unescape(
            F.substring("formatted", (x["start"] + 1).cast("int"), x["length"].cast("int")))), "").alias("loss_text"),
    )
