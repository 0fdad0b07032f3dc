"""Repetition coverage: how much of a text lies in duplicated n-grams and lines.

`repetition_coverage` adds nothing to a shuffle: each task hashes the words and lines of its texts with numpy and marks
what occurs again in the same text. Cases: a null or empty text has zero everywhere and fails the base rule; a text
shorter than an n-gram has none; repeated rows are judged one by one; an empty table gives an empty result; columns other
than the id and the text play no part. Time and memory follow a block of about a megabyte, or one text if it is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm import kernels
from parlance.llm.tables import arrow_map

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
BASE_WINDOW = 3
BASE_PERCENT = 50
# Share of a text's characters that may lie in second and later copies of its n-grams, by n-gram length.
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE = 0.30
LINE_CHAR_SHARE = 0.20

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _copies(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it is not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    later, repeated = np.empty(len(keys), bool), np.empty(len(keys), bool)
    later[order] = same[:-1]
    repeated[order] = same[:-1] | same[1:]
    return repeated, later


def _covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Words inside any of the windows."""
    edges = np.zeros(total + 1, dtype=np.int32)
    edges[starts] += 1
    np.subtract.at(edges, starts + length, 1)
    return np.cumsum(edges[:-1]) > 0


def _block_counts(block: kernels.Block, ngram_lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    data, offsets = block.data, block.offsets
    words = kernels.find_words(data, offsets)
    rows = kernels.rows_of(words.offsets)
    total = len(words.starts)
    points = ((data & 0xC0) != 0x80).astype(np.int64)
    point_sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(points, out=point_sums[1:])
    word_points = point_sums[words.ends] - point_sums[words.starts]
    counts = {
        "n_words": words.counts,
        "word_chars": kernels.sums_by_row(word_points, words.offsets),
        "n_symbols": kernels.sums_by_row(kernels.byte_table(SYMBOLS)[data], offsets),
    }

    breaks = np.flatnonzero(data == 10)
    # A line is given by its end; a text of n breaks has n + 1 lines, the last one ending where the text ends.
    line_ends = np.concatenate([breaks, offsets[1:]])
    line_rows = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(block.rows)])
    order = np.lexsort((np.concatenate([np.zeros(len(breaks)), np.ones(block.rows)]), line_ends, line_rows))
    line_ends, line_rows = line_ends[order], line_rows[order]
    line_starts = np.empty_like(line_ends)
    line_starts[1:] = line_ends[:-1] + 1
    first = np.ones(len(line_ends), dtype=bool)
    first[1:] = line_rows[1:] != line_rows[:-1]
    line_starts[first] = offsets[line_rows[first]]
    held = np.searchsorted(words.starts, line_ends) - np.searchsorted(words.starts, line_starts) > 0
    line_starts, line_ends, line_rows = line_starts[held], line_ends[held], line_rows[held]
    salts = kernels.mix(np.arange(block.rows, dtype=np.uint64) + np.uint64(1))
    line_hash = kernels.Spans(data.astype(np.uint64) + np.uint64(1), kernels.BYTE_BASE).of(line_starts, line_ends)
    _, again = _copies(kernels.mix(line_hash ^ salts[line_rows]))
    word_sums = np.zeros(total + 1, dtype=np.int64)
    np.cumsum(word_points, out=word_sums[1:])
    line_points = (
        word_sums[np.searchsorted(words.starts, line_ends)] - word_sums[np.searchsorted(words.starts, line_starts)]
    )
    counts["n_lines"] = np.bincount(line_rows, minlength=block.rows)
    counts["n_dup_lines"] = np.bincount(line_rows[again], minlength=block.rows)
    counts["dup_line_chars"] = np.bincount(
        line_rows[again], weights=line_points[again], minlength=block.rows
    ).astype(np.int64)

    spans = kernels.Spans(kernels.word_hashes(data, words), kernels.WORD_BASE)
    for length in (BASE_WINDOW, *ngram_lengths):
        starts = kernels.window_starts(words.offsets, length)
        repeated, again = _copies(kernels.mix(spans.of(starts, starts + length) ^ salts[rows[starts]]))
        if length == BASE_WINDOW:
            counts["n_repeat_words"] = kernels.sums_by_row(_covered(starts[repeated], length, total), words.offsets)
        if length in ngram_lengths:
            inside = _covered(starts[again], length, total)
            counts[f"dup_{length}gram_chars"] = kernels.sums_by_row(word_points * inside, words.offsets)
    return counts


def _measure(batches, ngram_shares: dict[int, float], line_share: float, line_char_share: float, min_words: int,
             base_percent: int):
    lengths = tuple(sorted(ngram_shares))
    for batch in batches:
        for block in kernels.blocks(batch.column(1)):
            found = _block_counts(block, lengths)
            base = (found["n_words"] < min_words) | (
                100 * found["n_repeat_words"] > base_percent * found["n_words"]
            )
            chars = found["word_chars"]
            bad = (found["n_dup_lines"] > line_share * found["n_lines"]) | (
                found["dup_line_chars"] > line_char_share * chars
            )
            for length, share in ngram_shares.items():
                bad |= found[f"dup_{length}gram_chars"] > share * chars
            columns = [batch.column(0).slice(block.first, block.rows)]
            columns += [pa.array(found[name].astype(np.int64)) for name in _COUNTS]
            columns += [pa.array(base), pa.array(~base & ~bad)]
            columns += [pa.array(found[name].astype(np.int64)) for name in ("n_lines", "dup_line_chars")]
            columns += [pa.array(found[f"dup_{length}gram_chars"].astype(np.int64)) for length in lengths]
            names = ["id", *_COUNTS, "base_failed", "kept", "n_lines", "dup_line_chars"]
            yield pa.RecordBatch.from_arrays(columns, names + [f"dup_{length}gram_chars" for length in lengths])


def repetition_coverage(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", ngram_shares: dict[int, float] | None = None,
    line_share: float = LINE_SHARE, line_char_share: float = LINE_CHAR_SHARE, min_words: int = MIN_WORDS,
    base_percent: int = BASE_PERCENT,
) -> DataFrame:
    """One row per text: counts, characters inside second and later copies by n-gram length and line, and the verdict."""
    shares = NGRAM_SHARES if ngram_shares is None else ngram_shares
    kind = df.schema[id_column].dataType.simpleString()
    schema = ", ".join(
        [f"id {kind}", *(f"{name} bigint" for name in _COUNTS), "base_failed boolean", "kept boolean", "n_lines bigint",
         "dup_line_chars bigint", *(f"dup_{length}gram_chars bigint" for length in sorted(shares))]
    )
    found = arrow_map(
        df.select(df[id_column], df[text_column].cast("string")), _measure, schema, ngram_shares=shares,
        line_share=line_share, line_char_share=line_char_share, min_words=min_words, base_percent=base_percent,
    )
    return found.withColumnRenamed("id", id_column)
