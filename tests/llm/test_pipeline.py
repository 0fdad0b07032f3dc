"""Every stage of the pipeline against brute force on its own input."""

import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name.replace(" ", "-"))
        found.append(docs.toPandas())
    return found


def ascii_words(text):
    return text.encode().split()


def test_stage_names_and_columns(outputs):
    assert len(corpus_pipeline.STAGES) == 5
    for frame in outputs[:-1]:
        assert list(frame.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(len(frame) for frame in outputs)


def test_quality(spark, outputs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id")
    kept = set(outputs[1].doc_id)
    good = labels[(labels.quality == 1) & (labels.toxic == 0)].index
    bad = labels[labels.toxic == 1].index
    assert np.mean([key in kept for key in good]) > 0.9
    assert np.mean([key in kept for key in bad]) < 0.2


def test_near_duplicates(outputs):
    sets = {}
    for row in outputs[1].itertuples():
        words = [w.lower() for w in ascii_words(row.text)]
        sets[row.doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for place, a in enumerate(keys):
        for b in keys[place + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(outputs[2].doc_id) == [key for key in keys if find(key) == key]


def test_repeated_passages(outputs):
    places: dict = {}
    texts = {row.doc_id: row.text for row in outputs[2].itertuples()}
    for key, text in texts.items():
        words = ascii_words(text)
        for i in range(len(words) - 34):
            places.setdefault(tuple(words[i : i + 35]), []).append((key, i))
    gone = {(key, j) for found in places.values() if len(found) > 1 for key, i in found for j in range(i, i + 35)}
    want = {}
    for key, text in texts.items():
        words = ascii_words(text)
        kept = [w for j, w in enumerate(words) if (key, j) not in gone]
        if kept:
            want[key] = text.encode() if len(kept) == len(words) else b" ".join(kept)
    got = {row.doc_id: row for row in outputs[3].itertuples()}
    assert set(got) == set(want)
    for key, row in got.items():
        assert row.n_chars == len(row.text)
        assert b" ".join(ascii_words(row.text)) == b" ".join(want[key].split())


def test_benchmarks(spark, outputs):
    def split(text):
        lowered = text.encode().lower().decode()
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]

    windows = set()
    for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = split(row["text"])
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    sizes = {len(w) for w in windows}
    clean = []
    for row in outputs[3].itertuples():
        words = split(row.text)
        if not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1)):
            clean.append(row.doc_id)
    assert sorted(outputs[4].doc_id) == sorted(clean)


def test_pieces(outputs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert list(outputs[5].columns) == [*outputs[4].columns, "piece_ids", "decoded"]
    for row in outputs[5].itertuples():
        assert list(row.piece_ids) == model.encode(row.text)
        assert row.decoded == row.text


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{letter}{i}" for i in range(60)) for letter in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, c), (None, c), (4, None), (4, ""), (None, "short"), (5, c + " tail")]
    docs = spark.createDataFrame([(i, text, None, None, None) for i, text in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (2, b), (5, c + " tail"), (4, None), (4, ""), (None, "short")], key=repr)


def test_clean_rows_that_share_an_id_with_a_contaminated_one_stay(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("text is not null").first()["text"]
    rows = [(1, "clean words"), (1, f"so {item} it is"), (None, item), (None, "also clean"), (2, None)]
    docs = spark.createDataFrame([(i, text, None, None, None) for i, text in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.benchmarks(spark, docs, FOLDER).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, "clean words"), (None, "also clean"), (2, None)], key=repr)


def test_run_and_awkward_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    extra = spark.createDataFrame(
        [(None, "lost", None, None, None), (900001, None, "en", "x", 0), (900002, "", "en", "x", 0), (900003, "  \n", None, None, 3)],
        docs.schema,
    )
    one = docs.limit(1)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    clashing = {name: F.lit("mine") for name in ("kept", "score", "marks", "bands", "item_id", "words", "key")}
    docs.union(extra).union(one).withColumns(clashing).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert all(found.filter(F.col(name) != "mine").isEmpty() for name in clashing)
    rows = found.select("doc_id", F.size("piece_ids").alias("n")).collect()
    keys = [row["doc_id"] for row in rows]
    assert len(keys) == len(set(keys)) and not {900001, 900002, 900003} & set(keys)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
