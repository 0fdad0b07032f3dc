"""Removal of repeated runs against a table of all windows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.llm import substring_dedup


def expected(rows, n):
    words = [(key, (text or "").encode().split()) for key, text in rows]
    counts = Counter(tuple(w[i : i + n]) for _, w in words for i in range(len(w) - n + 1))
    found = []
    for key, w in words:
        gone = {j for i in range(len(w) - n + 1) if counts[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        found.append((key, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(found, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(5, 40))] for _ in range(6)]
    texts = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        if rng.random() < 0.2:
            text += [rng.choice(words)] * rng.randrange(30)
        texts.append(" ".join(text))
    return list(enumerate(texts + texts[:5]))


@pytest.mark.parametrize(("seed", "regions"), [(1, 512), (2, 512), (3, 1), (4, 2)])
def test_against_all_windows(spark, seed, regions):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("marks", F.lit(0)).repartition(3)
    found = substring_dedup.remove_repeated(df, min_words=12, anchor_words=4, shard_regions=regions)
    assert sorted((tuple(row) for row in found.collect()), key=repr) == expected(rows, 12)


def test_awkward_rows(spark):
    run = " ".join(f"r{i}" for i in range(40))
    rows = [
        (1, None), (2, ""), (3, " \t"), (4, run), (5, f"start {run} end"), (6, "x " * 100), (7, f"é\n{run}\n{run}"),
        (8, " ".join(f"u{i}" for i in range(20_000))), (8, run), (9, "short"), (9, "short"),
    ]
    df = spark.createDataFrame(rows, "key bigint, body string")
    found = substring_dedup.remove_repeated(df, "key", "body").collect()
    assert sorted((tuple(row) for row in found), key=repr) == expected(rows, 35)
    nameless = spark.createDataFrame([(None, run), (None, run + " z")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in substring_dedup.remove_repeated(nameless).select("n_words", "n_removed").collect()) == [(40, 40), (41, 40)]
    assert substring_dedup.remove_repeated(df.limit(0), "key", "body").collect() == []


def test_text_around_a_removed_run_stays(spark):
    run = "\n".join(f"r{i}" for i in range(40))
    rows = [(1, f"  before,\n\n{run}\n after  "), (2, f"{run}"), (3, "as\t it  was\n"), (4, f"x {run}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    found = substring_dedup.remove_repeated(df, rejoin=False, carried=("lang",)).orderBy("doc_id").collect()
    assert [row["kept_text"] for row in found] == ["  before,\n\nafter  ", "", "as\t it  was\n", "x "]
    assert {row["lang"] for row in found} == {"en"}


def test_automaton_counts_places():
    rng = random.Random(9)
    for _ in range(60):
        regions = [([rng.randrange(3) for _ in range(rng.randrange(1, 14))], rng.randrange(1, 3)) for _ in range(rng.randrange(1, 6))]
        n = rng.randrange(1, 5)
        counts: Counter = Counter()
        for words, copies in regions:
            for i in range(len(words) - n + 1):
                counts[tuple(words[i : i + n])] += copies
        want = [sum(1 << i for i in range(len(w) - n + 1) if counts[tuple(w[i : i + n])] > 1) for w, _ in regions]
        assert substring_dedup.repeated_windows(regions, n) == want
