"""Periodic runs against a plain scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from parlance.llm import periodic_runs
from parlance.llm.queries import op12_periodic_runs

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, exponent=4, least=6):
    smallest = {}
    for period in range(1, len(words) // exponent + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end + period - start >= max(least, exponent * period):
                smallest.setdefault((start, end + period), period)
            start = max(end, start + 1)
    return sorted((start, end - start, period) for (start, end), period in smallest.items())


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def test_kernel_against_plain_scan():
    chance = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(chance.randint(1, 4)):
            kinds, words = chance.randint(1, 5), []
            words = [chance.randint(0, kinds) for _ in range(chance.randint(0, 90))]
            for _ in range(chance.randint(0, 3) if words else 0):
                start, period = chance.randrange(len(words)), chance.randint(1, 20)
                for i in range(start, min(len(words), start + chance.randint(1, 90))):
                    words[i] = words[start + (i - start) % period]
            texts.append(words)
        exponent = chance.choice([3, 4, 4, 5])
        ids = np.array([x for i, words in enumerate(texts) for x in (*words, -1 - i)], dtype=np.int64)
        starts, ends, periods = periodic_runs.find_runs(ids, np.array([len(words) + 1 for words in texts]), exponent, 6)
        want, offset = [], 0
        for words in texts:
            want += [(start + offset, length, period) for start, length, period in plain_runs(words, exponent)]
            offset += len(words) + 1
        assert list(zip(starts.tolist(), (ends - starts).tolist(), periods.tolist(), strict=True)) == want


def test_highly_periodic_texts():
    for words in (np.zeros(5000), np.arange(5000) % 7, np.repeat(np.arange(2), 2500), np.tile(np.repeat([1, 2], 9), 300)):
        ids = np.append(words, -1).astype(np.int64)
        found = periodic_runs.find_runs(ids, np.array([len(ids)]))
        assert [(int(s), int(e - s), int(p)) for s, e, p in zip(*found, strict=True)] == plain_runs(words.tolist())


def test_small_exponents_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame([(1, "a")], "doc_id int, text string"), min_exponent=2)


def test_query(spark):
    found = {row["doc_id"]: row for row in op12_periodic_runs(spark, FOLDER).collect()}
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(found) == len(documents)
    with_runs = 0
    for document in documents:
        words = [word.decode() for word in (document["text"] or "").encode().split()]
        check = zlib.crc32(str(document["doc_id"]).encode())
        if check % 10 == 0 and words:
            first = check // 10 % len(words)
            period = 1 + (len(words) - first) // (3 + check // 10 % 8)
            words = words[:first] + [words[first + i % period] for i in range(len(words) - first)]
        runs = plain_runs(words) if len(words) < 3000 else None
        row = found[document["doc_id"]]
        if runs is None:
            continue
        with_runs += bool(runs)
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert with_runs > 5


def test_awkward_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "a a a a a a", "x"), (4, "a a a a a a", "x"), (None, "b  c b\nc b c b c", "x"),
        (5, "é é é é é é é é é é é é", "x"), (6, "w " * 30000 + "end", "x"), (7, "one two three", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs string").withColumnRenamed("runs", "id")
    found = periodic_runs.periodic_runs(df).collect()
    assert found[0].asDict().keys() == {"doc_id", "n_words", "runs", "collapsed"}
    by_id = {}
    for row in found:
        by_id.setdefault(row["doc_id"], []).append((row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]))
    assert by_id[1] == by_id[2] == by_id[3] == [(0, [], "")]
    assert by_id[4] == [(6, [(0, 6, 1)], "a")] * 2
    assert by_id[None] == [(8, [(0, 8, 2)], "b c")]
    assert by_id[5] == [(6, [(0, 6, 1)], "é é")]
    assert by_id[6] == [(30001, [(0, 30000, 1)], "w end")]
    assert by_id[7] == [(3, [], "one two three")]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
