"""Near-duplicates against all pairs, and the pieces they are found with."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import minhash_dedup
from parlance.llm.components import components


def roots(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in nodes}


def shingles(text, length):
    words = (text or "").encode().lower().split()
    if words and len(words) < length:
        return {tuple(words)}
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def expected(rows, length, percent=80):
    sets = {key: shingles(text, length) for key, text in rows}
    keys = sorted(sets)
    links = []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = roots(keys, links)
    return sorted((key, len(sets[key]), root[key], root[key] == key) for key in keys)


def corpus(seed, groups=8, copies=25, words=60):
    """Groups of copies whose edits put pairs on both sides of the threshold, so that buckets hold several components."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            edited = list(base)
            for _ in range(rng.randrange(9)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append(" ".join(edited))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("length", [2, 5])
def test_groups_around_the_threshold(spark, length):
    rows = corpus(length)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("mine")).repartition(4)
    found = sorted(tuple(row) for row in minhash_dedup.near_duplicates(df, shingle_words=length).collect())
    want = expected(rows, length)
    assert found == want
    assert 1 < len({row[2] for row in want}) < len(rows)


def test_blocks_smaller_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 3)
    rows = corpus(11, groups=3, copies=40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(tuple(row) for row in minhash_dedup.near_duplicates(df, shingle_words=2).collect())
    assert found == expected(rows, 2)


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (9, None), (8, ""), (7, " \n"), (6, "One"), (5, "one"), (4, "one two"), (3, "ONE\ttwo\n"), (2, "one two three"),
        (11, long), (12, long + " end"), (13, "É é"), (14, "é é"), (15, "a a a a"), (16, "a a"),
    ]
    df = spark.createDataFrame([*rows, (None, "one"), (None, None), (6, "One")], "id bigint, body string")
    found = sorted(tuple(row) for row in minhash_dedup.near_duplicates(df, "id", "body", shingle_words=2).collect())
    assert found == expected(rows, 2)
    assert minhash_dedup.near_duplicates(df.limit(0), "id", "body").collect() == []


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    estimates = []
    for similarity in (0.95, 0.9, 0.8):
        shared = int(2000 * similarity)
        rest = (2000 - shared) // 2
        sets = [pool[: shared + rest], np.concatenate([pool[:shared], pool[2000 : 2000 + rest]])]
        sketches = minhash_dedup.odd_sketches(np.array([minhash_dedup.minhash(x) for x in sets])).view(np.uint64)
        bits = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        size, samples = minhash_dedup.SKETCH_BITS, minhash_dedup.SAMPLES
        estimates.append(1 + size / (4 * samples) * np.log(1 - 2 * bits / size))
        assert abs(estimates[-1] - similarity) < 0.12
        assert bits <= minhash_dedup._most_bits(0.8 - minhash_dedup.SLACK)
    assert estimates == sorted(estimates, reverse=True)


def test_equal_samples_give_equal_bands():
    samples = np.arange(2 * minhash_dedup.SAMPLES, dtype=np.uint32).reshape(2, -1)
    samples[1, :4] = samples[0, :4]
    keys = minhash_dedup.band_keys(samples)
    assert (keys[0] == keys[1]).tolist() == [True] + [False] * (minhash_dedup.BANDS - 1)
    assert len(set(keys.ravel().tolist())) == 2 * minhash_dedup.BANDS - 1


def test_lists_have_one_width():
    assert minhash_dedup._lists(np.arange(6).reshape(3, 2)).to_pylist() == [[0, 1], [2, 3], [4, 5]]
    assert isinstance(minhash_dedup._lists(np.empty((0, 4), dtype=np.int64)), pa.ListArray)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(400, 450)]
    links += [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    links += [(7, 7), (100, 101), (101, 100)]
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "a bigint, b bigint").withColumn("u", F.lit(1))
    nodes = {x for pair in links for x in pair}
    root = roots(nodes, links)
    found = {row["node"]: row["root"] for row in components(df).collect()}
    assert found == {x: r for x, r in root.items() if x != r}
    assert components(df.limit(0)).collect() == []
