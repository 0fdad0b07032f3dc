"""Token files against the tokenizer itself, and random access to their sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import token_files
from parlance.llm.queries import op4_token_files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


def expected(rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    found, start = [], 0
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        found.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return found


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    found = op4_token_files(spark, FOLDER).orderBy("doc_id").collect()
    assert [tuple(row) for row in found] == expected(rows)


def test_awkward_texts(spark):
    texts = [
        None, "", " \n\t ", "Don't I'll", "a\x85b c\xa0d\x1ce", "<|startoftext|>x <|endoftext|>", "ΟΔΟΣ Σ İ", "é ́x",
        "日本語 text 12 3.4", "A.,b. C, ...D. e.\n f.' <|ENDOFTEXT|>, x.", "It's, ok.. Fine, é, E\u0301. İ. z,\x85q 1, a.", "\U0001f600\U0001f600 ok", '" ! "', "x" * 3000, "word " * 5000, "same", "same",
    ]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit("extra")).repartition(3)
    folder, manifest = token_files.write_token_files(df, VOCABULARY, files=4, length=64)
    found = token_files.read_token_files(spark, folder, manifest).orderBy("id").collect()
    assert [tuple(row) for row in found] == expected(rows)


def test_capitals_before_combining_marks(spark):
    marked = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]
    texts = [*marked, " ".join(marked), "Plain WORDS and J\u030cAK, xT\u0308.", "last", "İJ\u030c É E\u0301\u0331 ok."]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    folder, manifest = token_files.write_token_files(df, VOCABULARY, files=4, length=64)
    found = token_files.read_token_files(spark, folder, manifest).orderBy("id").collect()
    assert [tuple(row) for row in found] == expected(rows)


def test_sequences_have_equal_length_and_a_mask(spark):
    df = spark.createDataFrame([(1, "one two three " * 200), (2, "four")], "doc_id bigint, text string")
    folder, manifest = token_files.write_token_files(df, VOCABULARY, files=1, length=32)
    name, n_ids = manifest.select("file", "n_ids").first()
    tokens = token_files.TokenFile(folder, name)
    ids, masks = zip(*[tokens.sequence(i) for i in range(-(-n_ids // 32))], strict=True)
    assert {len(x) for x in ids} == {32}
    assert np.concatenate(masks).sum() == n_ids
    flat = np.concatenate(ids)[np.concatenate(masks)]
    straight = Tokenizer.from_file(VOCABULARY).encode("one two three " * 200, add_special_tokens=False).ids + [1]
    assert flat[: len(straight)].tolist() == straight
    assert np.concatenate(list(tokens.slices(5, 40))).tolist() == flat[5:45].tolist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    folder, manifest = token_files.write_token_files(df, VOCABULARY)
    assert token_files.read_token_files(spark, folder, manifest).collect() == []


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_a_full_cache_starts_anew(limit):
    cache = token_files.WordCache(VOCABULARY, limit)
    texts = ["a b c d", "d e f", "a a a", "g"]
    want = [Tokenizer.from_file(VOCABULARY).encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(3):
        assert [np.frombuffer(x, "<u2").tolist() for x in cache.encode([text.encode() for text in texts])] == want
