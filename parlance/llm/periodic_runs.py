"""Stretches of a text that repeat with a period, found by dyadic square catching, and the text with repeats collapsed.

The words of some texts are laid end to end, with a mark of its own after each text. For every power of two, `size`, the
words fall into completed blocks of that size, and each block has a catcher: it holds the block's hash and compares it with
the suffix of `size` words that ends at each word appended while the distance to the block is `size` to `2 * size - 1`. So
every appended word meets one catcher of each size, which numpy does for all words of a size at once. A suffix that equals
its block at distance d is a square if the rest of the block's d words agrees as well. Squares of one distance that overlap
by d words merge into a stretch, which is extended word by word on both sides until the period breaks.

Every run of exponent 3 or more is found: with size <= period < 2 * size it holds a block of that size that starts fewer than
`size` words after it, and the square from there on lies inside. Suffixes inside a known stretch of a shorter period
are passed over; by the theorem of Fine and Wilf no run with that distance as its smallest period can hold them. Hashes
propose, and every run is confirmed word by word before it is reported.

Cases: a null or empty text has no words and no runs; rows are judged one by one, so repeated rows and ids give repeated
results, and null ids stay; an empty table gives an empty result; columns other than the id and the text play no part. Work
grows with words times the logarithm of the longest text; memory follows about 200,000 words, or one text if it is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.kernels import mix
from parlance.llm.tables import arrow_map

BLOCK_WORDS = 200_000
MIN_EXPONENT = 4
MIN_LENGTH = 6
_COMPARED = 1 << 20
_LEFT = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _agreeing(ids: np.ndarray, first: np.ndarray, second: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from each pair of places on, forwards or backwards; first is the smaller place."""
    counts = np.zeros(len(first), dtype=np.int64)
    open_, width = np.arange(len(first)), 8
    while len(open_):
        width = max(1, min(width, _COMPARED // len(open_)))
        moves = step * (counts[open_][:, None] + np.arange(width))
        left, right = first[open_][:, None] + moves, second[open_][:, None] + moves
        inside = (left >= 0) & (right < len(ids))
        same = inside & (ids[np.where(inside, left, 0)] == ids[np.where(inside, right, 0)])
        agreed = np.where(same.all(axis=1), width, same.argmin(axis=1))
        counts[open_] += agreed
        open_ = open_[agreed == width]
        width *= 4
    return counts


def _squares(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and distances at which a suffix equals the block its catcher holds."""
    size = 1 << level
    suffixes = np.arange(size, len(hashes))
    blocks = ((suffixes >> level) - 1) << level
    met = np.flatnonzero(hashes[size:] == hashes[blocks])
    return blocks[met], suffixes[met] - blocks[met]


def _merged(starts: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches made of squares of one distance, each overlapping the one before by that distance."""
    order = np.lexsort((starts, distances))
    starts, distances = starts[order], distances[order]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (distances[1:] != distances[:-1]) | (starts[1:] > starts[:-1] + distances[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)[: fresh.sum()]
    return starts[fresh], starts[last] + 2 * distances[last], distances[fresh]


def find_runs(
    ids: np.ndarray, sizes: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, ordered by start, then period.

    `ids` holds the words of some texts, each text followed by an id that occurs once; `sizes` counts words and that mark.
    Only exponents of 3 or more are sure to be found, so a smaller `min_exponent` is refused.
    """
    if min_exponent < 3:
        raise ValueError("runs of an exponent below 3 may hold no completed block")
    texts, places, hashes = sizes, np.arange(len(ids)), mix(ids.astype(np.uint64) + np.uint64(1))
    whole = ids
    found = np.empty((0, 3), dtype=np.int64)
    level = 0
    while len(texts) and min_exponent << level < texts.max():
        alive = texts > min_exponent << level
        kept = np.repeat(alive, texts)
        if 2 * kept.sum() < len(kept):
            # A window's hash stays right: it holds the mark of its text if it reaches past the end.
            ids, places, hashes, texts = ids[kept], places[kept], hashes[kept[: len(hashes)]], texts[alive]
        size = 1 << level
        starts, distances = _squares(hashes, level)
        if len(starts) and len(found):
            by_start = found[np.argsort(found[:, 0], kind="stable")]
            furthest = np.maximum.accumulate(by_start[:, 1])
            before = np.searchsorted(by_start[:, 0], places[starts], side="right") - 1
            known = (before >= 0) & (furthest[before] >= places[starts] + distances + size)
            starts, distances = starts[~known], distances[~known]
        # The first block of the square agrees; the last `size` of its d words must as well.
        lasts = starts + 2 * distances - size
        fits = lasts < len(hashes)
        starts, distances, lasts = starts[fits], distances[fits], lasts[fits]
        agree = hashes[lasts - distances] == hashes[lasts]
        starts, distances = starts[agree], distances[agree]
        if len(starts):
            first, end, period = _merged(starts, distances)
            first = first - _agreeing(ids, first - 1, first - 1 + period, -1)
            end = end + _agreeing(ids, end - period, end, 1)
            begin = places[first]
            found = np.unique(np.concatenate([found, np.stack([begin, begin + end - first, period], axis=1)]), axis=0)
        hashes = mix(hashes[:-size] * _LEFT + hashes[size:])
        level += 1
    lengths = found[:, 1] - found[:, 0]
    found = found[lengths >= np.maximum(min_length, min_exponent * found[:, 2])]
    # Rows are in order of start, end, period: of equal stretches the first has the smallest period.
    smallest = np.ones(len(found), dtype=bool)
    smallest[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[smallest]
    true = [np.array_equal(whole[s : e - p], whole[s + p : e]) for s, e, p in found]
    found = found[np.array(true, dtype=bool)] if len(found) else found
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def _results(rows: list, texts: list[list[bytes]], min_exponent: int, min_length: int, schema: pa.Schema) -> pa.RecordBatch:
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(words) + 1 for words in texts], dtype=np.int64)
    ids = np.empty(int(sizes.sum()), dtype=np.int64)
    ends = np.cumsum(sizes)
    for words, end in zip(texts, ends, strict=True):
        ids[end - len(words) - 1 : end - 1] = [numbers.setdefault(word, len(numbers)) for word in words]
    ids[ends - 1] = -1 - np.arange(len(texts))
    starts, stops, periods = find_runs(ids, sizes, min_exponent, min_length)
    owners = np.searchsorted(ends, starts, side="right")
    first_run = np.searchsorted(owners, np.arange(len(texts) + 1))
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, starts + periods, 1)
    np.subtract.at(edges, stops, 1)
    kept = np.cumsum(edges[:-1]) == 0
    collapsed, runs = [], []
    for row, (words, end) in enumerate(zip(texts, ends, strict=True)):
        offset = int(end) - len(words) - 1
        mine = slice(first_run[row], first_run[row + 1])
        runs.append([
            {"start": int(s) - offset, "length": int(e - s), "period": int(p)}
            for s, e, p in zip(starts[mine], stops[mine], periods[mine], strict=True)
        ])
        if runs[-1]:
            words = [words[i] for i in np.flatnonzero(kept[offset : offset + len(words)])]
        collapsed.append(b" ".join(words).decode())
    columns = [pa.array(rows, schema.field(0).type), pa.array(sizes - 1), pa.array(runs, _RUNS), pa.array(collapsed, pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _scan(batches, min_exponent: int, min_length: int):
    for batch in batches:
        schema = pa.schema([("id", batch.schema.field(0).type), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])
        rows, texts, held = [], [], 0
        for row in range(batch.num_rows):
            # bytes.split without arguments cuts at the six ASCII spaces and nothing else.
            words = (batch.column(1)[row].as_py() or b"").split()
            if texts and held + len(words) > BLOCK_WORDS:
                yield _results(rows, texts, min_exponent, min_length, schema)
                rows, texts, held = [], [], 0
            rows.append(batch.column(0)[row].as_py())
            texts.append(words)
            held += len(words)
        if texts:
            yield _results(rows, texts, min_exponent, min_length, schema)


def periodic_runs(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_exponent: int = MIN_EXPONENT,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """One row per text: its id, n_words, runs (start, length, period) and the text without their repetitions.

    A run is a stretch of words whose smallest period it holds at least `min_exponent` times, of at least `min_length` words,
    that no neighbouring word extends. `collapsed` keeps the first period of every run and all words outside, joined by spaces.
    """
    if min_exponent < 3:
        raise ValueError("runs of an exponent below 3 may hold no completed block")
    kind = df.schema[id_column].dataType.simpleString()
    found = arrow_map(
        df.select(df[id_column].alias("_id"), df[text_column].cast("string").cast("binary").alias("_text")), _scan,
        f"id {kind}, n_words bigint, runs {RUNS}, collapsed string", min_exponent=min_exponent, min_length=min_length,
    )
    return found.withColumnRenamed("id", id_column)
