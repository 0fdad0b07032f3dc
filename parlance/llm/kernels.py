"""Numpy over the byte buffers of Arrow text columns: words, lines, and hashes of their sequences.

Every function works on a block: some whole texts laid end to end in one byte array, with offsets that bound each
text. Nothing here loops over words in Python. Hashes are polynomials modulo 2**64 with odd bases, so the hash of any
span comes from two prefix sums; a final mixing step spreads them over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Block(NamedTuple):
    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive whole texts of about `size` bytes; a longer text is a block of its own. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, side="right")) - 1)
        yield Block(row, stop - row, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


SPACES = byte_table(b" \t\n\x0b\x0c\r")
PLAIN_WORD = ~SPACES
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = PLAIN_WORD) -> Words:
    """Maximal runs of word bytes inside each text."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def powers(base: np.uint64, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, kept between calls."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < size:
        size = max(size, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        known = tuple(
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)]))
            for x in (base, inverse)
        )
        _powers[int(base)] = known
    return known


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Spans:
    """Hashes of any span of a sequence, from its prefix sums."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        up, self._down = powers(base, len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + np.uint64(0x632BE59BD9B4E019) * (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, words: Words, lower: bool = False) -> np.ndarray:
    values = (LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    return Spans(values, BYTE_BASE).of(words.starts, words.ends)


def window_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Positions at which a run of `length` words begins and ends in the same text."""
    total = int(offsets[-1])
    fits = np.ones(total, dtype=bool)
    for step in range(1, length):
        last = offsets[1:] - step
        fits[last[last >= offsets[:-1]]] = False
    return np.flatnonzero(fits)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every item, where offsets bound the items of each row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between offsets."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling; len(values) - width + 1 results."""
    if len(values) < width:
        return values[:0]
    reach, best = 1, values
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    return best
