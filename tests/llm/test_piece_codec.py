"""Encoding and decoding against the library that the model belongs to."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from parlance.llm import piece_codec
from parlance.llm.queries import op6_piece_transducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
AWKWARD = [
    None, "", " ", "  a  b", "\n\n a\tb", "日本語 ﬁ 𝔘 é", "<0x0A> <s> </s> <unk>", "▁x ▁", "a" * 300, "é́", "x" * 50 + " " * 37 + "y",
    "\x00\x01", "ab\r\ncd", "https://foo.bar/baz?x=1&y=22222", "word " * 4000, "\U0001f600" * 20, "same", "same", "¡¿ñ!?",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return piece_codec.PieceCodec(MODEL)


def ids(coder, text):
    return np.frombuffer(coder.encode(text), dtype="<i4").tolist()


def test_awkward_texts(coder, library):
    for text in AWKWARD:
        assert ids(coder, text) == library.encode(text or "")
        assert coder.decode(ids(coder, text)) == library.decode(library.encode(text or ""))


def test_random_texts(coder, library):
    rng = random.Random(2)
    letters = "aabcdeeettiioonn  .,'-\n\tÉéñßüæ▁日09<>"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert ids(coder, text) == library.encode(text)


def test_bytes_that_are_no_text(coder, library):
    for broken in ([200], [3, 200, 201, 300], [0], [1, 2, 300]):
        assert coder.decode(broken) == library.decode(broken)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_PAIRS", 5)
    coder = piece_codec.PieceCodec(MODEL, limit=2)
    text = "some words and some more words, and some again"
    assert ids(coder, text) == library.encode(text)


@pytest.mark.parametrize("window", [1, 2, 4, 7])
def test_kept_arcs_change_nothing(library, monkeypatch, window):
    """Arcs are kept for a few characters if those decide; at the end of a text and in long pieces too."""
    monkeypatch.setattr(piece_codec, "WINDOW", window)
    monkeypatch.setattr(piece_codec, "CACHE_WINDOWS", 40)
    coder = piece_codec.PieceCodec(MODEL)
    for text in [*AWKWARD, "edin edinging international internationalisation", "interna", "nationals"]:
        assert ids(coder, text) == library.encode(text or "")
    assert 0 < len(coder.machine.windows) <= 40
    coder.forget()
    assert not coder.machine.windows and not coder


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    found = op6_piece_transducer(spark, FOLDER)
    assert found.count() == docs and found.filter("not round_trip").count() == 0


def test_columns(spark, library):
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id bigint, text string")
    df = df.withColumn("decoded", F.lit(7)).withColumn("state", F.map_from_arrays(F.array(F.lit("k")), F.array("doc_id")))
    coded = piece_codec.encode(df.repartition(2), MODEL)
    found = piece_codec.decode(coded, MODEL).orderBy("doc_id").collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "decoded", "state", "piece_ids"}
    for row, text in zip(found, AWKWARD, strict=True):
        assert row["piece_ids"] == library.encode(text or "")
        assert row["decoded"] == (text or "").replace("▁", " ") and row["state"] == {"k": row["doc_id"]}
    assert piece_codec.encode(df.limit(0), MODEL).collect() == []


def test_both_at_once(spark):
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id bigint, text string").withColumn("decoded", F.lit(1))
    apart = piece_codec.decode(piece_codec.encode(df, MODEL), MODEL).orderBy("doc_id").collect()
    assert piece_codec.encode_and_decode(df, MODEL).orderBy("doc_id").collect() == apart
