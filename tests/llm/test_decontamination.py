"""Winnowing against all windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontamination
from parlance.llm.queries import op10_winnowing

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def split(text):
    lowered = (text or "").encode().lower().decode()
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def expected(docs, items, n=10):
    windows: dict = {}
    for key, text in items:
        words = split(text)
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(key))
    found = []
    for key, text in docs:
        words = split(text)
        hit, named = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                names = windows.get(tuple(words[i : i + size]))
                if names:
                    hit.update(range(i, i + size))
                    named |= names
        found.append((key, len(words), len(hit), sorted(named), bool(hit)))
    return sorted(found, key=repr)


def check(spark, docs, items, **options):
    left = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1)).withColumn("window", F.lit(2)).repartition(3)
    right = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1))
    found = decontamination.contamination(left, right, **options)
    got = sorted(((r[0], r[1], r[2], r[3], r[4]) for r in found.collect()), key=repr)
    assert got == expected(docs, items, options.get("window_words", 10))
    return got


@pytest.mark.parametrize(("seed", "gram"), [(1, 5), (2, 5), (3, 1), (4, 10)])
def test_random_texts(spark, seed, gram):
    rng = random.Random(seed)
    words = ["Ab", "c", "é", "7", "dd"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([4, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randrange(30))]
        if rng.random() < 0.5:
            source = split(rng.choice(items)[1])
            begin = rng.randrange(len(source))
            text[3:3] = source[begin : begin + rng.randrange(8, 16)]
        docs.append((i, ", ".join(text)))
    got = check(spark, docs, items, gram_words=gram)
    assert 0 < sum(row[4] for row in got) < len(got)


def test_awkward_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(1, passage), (2, passage.upper()), (10, None), (11, ""), (12, "?!"), (20, "lone"), (21, "É x"), (None, "nameless item")]
    long = " ".join(f"u{i}" for i in range(20_000))
    docs = [
        (1, None), (2, ""), (3, "..."), (4, passage), (5, "lone"), (6, "a-lone LONE alone"), (7, "é X"), (8, "É x"), (9, long + " " + passage),
        (10, "nameless  item"), (11, passage[:30]), (12, "same"), (12, "same"), (13, "one text"), (13, passage), (None, passage),
    ]
    found = spark.createDataFrame(items, ITEMS).filter("item_id is not null")
    check(spark, docs, [tuple(row) for row in found.collect()])
    nameless = decontamination.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert {row["doc_id"]: row["contaminated"] for row in nameless.collect()}[10]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert [tuple(r) for r in decontamination.contamination(docs, items.limit(0)).collect()] == [(1, 2, 0, [], False)]
    assert decontamination.contamination(docs.limit(0), items).collect() == []


def test_no_python_in_the_plan(spark):
    plan = op10_winnowing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
