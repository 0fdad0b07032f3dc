"""Repetition coverage against a plain count."""

import re
from collections import Counter

from pyspark.sql import functions as F

from parlance.llm import quality_rules
from parlance.llm.queries import op7_repetition_coverage

FOLDER = "/root/testdata/sf0.001"


def covered(words, length, first_too):
    windows = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
    counts, seen, inside = Counter(windows), set(), set()
    for i, window in enumerate(windows):
        if counts[window] > 1 and (first_too or window in seen):
            inside.update(range(i, i + length))
        seen.add(window)
    return inside


def expected(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    lines, seen, again, again_chars = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")], set(), 0, 0
    for line in lines:
        if line in seen:
            again += 1
            again_chars += sum(len(w) for w in re.findall("[^\x20\x09-\x0D]+", line))
        seen.add(line)
    repeat = len(covered(words, 3, True))
    base = len(words) < 50 or 100 * repeat > 50 * len(words)
    bad = again > 0.30 * len(lines) or again_chars > 0.20 * chars
    grams = {}
    for length, share in quality_rules.NGRAM_SHARES.items():
        grams[length] = sum(len(words[i]) for i in covered(words, length, False))
        bad |= grams[length] > share * chars
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), chars, symbols, again, repeat, base, not base and not bad, len(lines), again_chars, *grams.values())


def test_query(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    found = op7_repetition_coverage(spark, FOLDER).collect()
    assert {row[0]: tuple(row)[1:] for row in found} == {key: expected(text) for key, text in texts.items()}
    assert {row["kept"] for row in found} == {True, False}


def test_awkward_texts(spark):
    line = "uno dos tres\tcuatro "
    texts = [
        None, "", "\n \n", "a", "a a a", "#*$%&|<> é", line * 40, "\n".join(["same line here"] * 30), "x\n\nx\n \n x\nx",
        "tail\n", "\n" + "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 20, " ".join(f"w{i}" for i in range(3000)), "é" * 2000, "dup", "dup",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "key bigint, body string").withColumn("kept", F.lit("mine"))
    found = quality_rules.repetition_coverage(df, "key", "body").collect()
    assert {row[0]: tuple(row)[1:] for row in found} == {i: expected(text) for i, text in enumerate(texts)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality_rules.repetition_coverage(df).collect() == []
