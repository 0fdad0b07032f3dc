"""Numpy kernels against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import kernels

TEXTS = [None, "", " ", "one", "a b\ta\n a b", "é ü\x0bé\x0cx\ry", "word " * 300, "\n\n", "z" * 5000, "a b a b a b"]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_words_and_hashes(size):
    seen: dict = {}
    for block in kernels.blocks(pa.array(TEXTS), size):
        words = kernels.find_words(block.data, block.offsets)
        hashes = kernels.word_hashes(block.data, words, lower=True)
        raw = block.data.tobytes()
        got = [raw[a:b] for a, b in zip(words.starts, words.ends, strict=True)]
        want = [w for text in TEXTS[block.first : block.first + block.rows] for w in (text or "").encode().split()]
        assert got == want
        for word, value in zip(got, hashes.tolist(), strict=True):
            assert seen.setdefault(word.lower(), value) == value
    assert len(set(seen.values())) == len(seen)


def test_span_hashes_depend_on_content_and_length_only():
    values = np.array([1, 2, 3, 1, 2, 3, 1, 2, 0], dtype=np.uint64)
    spans = kernels.Spans(values, kernels.WORD_BASE)
    hashes: dict = {}
    for a in range(len(values)):
        for b in range(a, len(values) + 1):
            value = int(spans.of(np.array([a]), np.array([b]))[0])
            key = tuple(values[a:b].tolist())
            assert hashes.setdefault(key, value) == value
    assert len(set(hashes.values())) == len(hashes)


def test_sliding_minimum():
    random.seed(1)
    values = np.array([random.randrange(50) for _ in range(200)], dtype=np.uint64)
    for width in (1, 2, 3, 7, 8, 28, 199, 200, 201):
        want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
        assert kernels.sliding_minimum(values, width).tolist() == want


def test_window_starts():
    offsets = np.array([0, 3, 3, 4, 9])
    assert kernels.window_starts(offsets, 1).tolist() == list(range(9))
    assert kernels.window_starts(offsets, 3).tolist() == [0, 4, 5, 6]
    assert kernels.window_starts(offsets, 6).tolist() == []


def test_sliced_columns():
    column = pa.array(["left out", "a b", None, "c"]).slice(1)
    block = next(kernels.blocks(column))
    assert block.rows == 3 and block.data.tobytes() == b"a bc"
    assert kernels.find_words(block.data, block.offsets).counts.tolist() == [2, 0, 1]
