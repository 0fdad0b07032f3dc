"""Ordinal cumulative-link regression on graded ratings.

Grades 0..g-1 share one weight vector over hashed words; ordered thresholds t_1 < ... < t_{g-1} cut the score s of a
text into grades: P(grade >= k) = 1 / (1 + exp(t_k - s)). The sum of these tail probabilities is the expected grade, and the
tail at a chosen grade decides selection.

* Ratings are sampled by a hash of their id, up to about `sample_per_grade` for each grade (a documented bound, 6,000 by
  default), so that grades keep their shares unless one exceeds it.
* Spark counts in how many sampled texts of each grade a hash bucket occurs; the `buckets_kept` buckets whose counts differ most
  between grades (chi-squared) enter the model. The driver then holds at most sample size times kept buckets numbers.
* Scoring is one pass without a shuffle: the weights (a fixed number of buckets) travel with the tasks.

Besides words there are buckets for ranges of a text's shape: shares of symbols, exclamations, digits, capitals and repeated neighbours.

Cases: null or empty texts have only shape buckets and are scored like others; unrated rows are only scored; null ratings are
ignored; an id rated repeatedly counts by its lowest grade; repeated rows score equally; grades without any rating shrink the
scale; with fewer than two grades in the ratings nothing is learned and every text is kept with null figures; an empty
table gives an empty result; output columns that exist are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import kernels
from parlance.llm.tables import arrow_map, stored

HASH_BUCKETS = 1 << 18
SAMPLE_PER_GRADE = 6000
BUCKETS_KEPT = 512
LEAST_TEXTS = 3
PENALTY = 0.01
STEPS = 400
RATE = 0.05
LEAST_TAIL = 0.4
WORD_BYTES = kernels.byte_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_SYMBOLS = kernels.byte_table(b"#*$%&|<>{}[]=_~^\\@+/")
_SHOUTS = kernels.byte_table(b"!?")
_DIGITS = kernels.byte_table(b"0123456789")
_CAPITALS = kernels.byte_table(bytes(range(65, 91)))
_LETTERS = kernels.byte_table(bytes(range(65, 91)) + bytes(range(97, 123)))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of hash buckets, and thresholds between grades in rising order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def _shape(values: np.ndarray, kind: int) -> np.ndarray:
    return kernels.mix(values.astype(np.uint64) + np.uint64(kind << 32))


def text_buckets(block: kernels.Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hash buckets of a block, each pair once, in order of rows."""
    words = kernels.find_words(block.data, block.offsets, WORD_BYTES)
    hashes = kernels.word_hashes(block.data, words, lower=True)
    rows = kernels.rows_of(words.offsets)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    letters = np.maximum(kernels.sums_by_row(_LETTERS[block.data], block.offsets), 1)
    sizes = np.maximum(np.diff(block.offsets), 1)
    shares = [kernels.sums_by_row(table[block.data], block.offsets) / sizes for table in (_SYMBOLS, _SHOUTS, _DIGITS)]
    shares.append(kernels.sums_by_row(_CAPITALS[block.data], block.offsets) / letters)
    shares.append(kernels.sums_by_row(same, words.offsets) / np.maximum(words.counts, 1))
    every = np.arange(block.rows)
    hashes = np.concatenate([hashes, *(_shape(np.log2(1 + 1000 * share), i + 1) for i, share in enumerate(shares))])
    rows = np.concatenate([rows, *[every] * len(shares)])
    keys = np.unique(rows.astype(np.uint64) * np.uint64(HASH_BUCKETS) + hashes % np.uint64(HASH_BUCKETS))
    return (keys // np.uint64(HASH_BUCKETS)).astype(np.int64), (keys % np.uint64(HASH_BUCKETS)).astype(np.int64)


def _rated_buckets(batches: Iterator[pa.RecordBatch], kept: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in kernels.blocks(batch.column(1)):
            rows, buckets = text_buckets(block)
            if kept is not None:
                inside = kept[buckets] >= 0
                rows, buckets = rows[inside], kept[buckets[inside]]
            bounds = np.searchsorted(rows, np.arange(block.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, block.rows),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(buckets.astype(np.int32)))],
                ["grade", "buckets"])


def sample_ratings(ratings: DataFrame, id_column: str, grade: Column, per_grade: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows id and grade: ids whose hash falls below a share that leaves about `per_grade` of each grade."""
    rated = (
        ratings.select(ratings[id_column].alias("id"), grade.cast("int").alias("grade"))
        .filter("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    )
    counts = {row["grade"]: row["n"] for row in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("grade") == value) & (place < min(1_000_000, 1_000_000 * per_grade // n)))
    return rated.filter(keep), counts


def fit_thresholds_and_weights(
    grades: np.ndarray, bounds: np.ndarray, buckets: np.ndarray, n_buckets: int, n_grades: int,
    penalty: float = PENALTY, steps: int = STEPS, rate: float = RATE,
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum penalised likelihood by Adam; texts weigh equally. Thresholds are a first one and positive gaps."""
    rows = np.repeat(np.arange(len(grades)), np.diff(bounds))
    importance = np.full(len(grades), 1 / max(len(grades), 1))
    weights = np.zeros(n_buckets)
    ends = np.zeros(n_grades - 1)  # the first threshold, then logarithms of gaps
    ends[0] = -0.5 * (n_grades - 2)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, ends)]
    for step in range(1, steps + 1):
        gaps = np.exp(ends[1:])
        thresholds = ends[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        scores = np.bincount(rows, weights=weights[buckets], minlength=len(grades))
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - thresholds[None, :], -50, 50)))  # P(grade <= k - 1)
        cumulative = np.column_stack([np.zeros(len(grades)), below, np.ones(len(grades))])
        slopes = cumulative * (1 - cumulative)
        each = np.arange(len(grades))
        chance = np.maximum(cumulative[each, grades + 1] - cumulative[each, grades], 1e-12)
        # Derivative of the log-likelihood by the score, and by the thresholds above and below the grade.
        by_score = -(slopes[each, grades + 1] - slopes[each, grades]) / chance * importance
        by_threshold = np.zeros(n_grades + 1)
        np.add.at(by_threshold, grades + 1, slopes[each, grades + 1] / chance * importance)
        np.subtract.at(by_threshold, grades, slopes[each, grades] / chance * importance)
        by_threshold = by_threshold[1:-1]
        downhill = (
            np.bincount(buckets, weights=by_score[rows], minlength=n_buckets) - penalty * weights / 100,
            np.concatenate([[by_threshold.sum()], gaps * np.cumsum(by_threshold[::-1])[::-1][1:]]),
        )
        for value, uphill, (mean, square) in zip((weights, ends), downhill, moments, strict=True):
            mean += 0.1 * (uphill - mean)
            square += 0.001 * (uphill**2 - square)
            value += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights, ends[0] + np.concatenate([[0.0], np.cumsum(np.exp(ends[1:]))])


def fit(
    documents: DataFrame, ratings: DataFrame, grade: Column, id_column: str = "doc_id", text_column: str = "text",
    sample_per_grade: int = SAMPLE_PER_GRADE, buckets_kept: int = BUCKETS_KEPT, penalty: float = PENALTY,
) -> OrdinalModel | None:
    """Learn from rated documents; None if the ratings hold fewer than two grades."""
    sample, counts = sample_ratings(ratings, id_column, grade, sample_per_grade)
    scale = {value: place for place, value in enumerate(sorted(counts))}
    if len(scale) < 2:
        return None
    # The sample holds about sample_per_grade rows of each grade, counted above.
    texts = documents.select(documents[id_column].alias("id"), documents[text_column].cast("string").alias("text"))
    rated = stored(texts.join(F.broadcast(sample), "id").select("grade", "text"), "rated-texts")
    schema = "grade int, buckets array<int>"
    spread = stored(
        arrow_map(rated, _rated_buckets, schema, kept=None)
        .select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket", "grade").agg(F.count("*").alias("n")),
        "bucket-counts",
    )
    sizes = {row["grade"]: row["n"] for row in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    total = sum(sizes.values())
    sums = spread.groupBy("bucket").agg(F.sum("n").alias("all"), F.collect_list(F.struct("grade", "n")).alias("by_grade"))
    gain = F.lit(0.0)
    for value, n in sizes.items():
        share = n / total
        seen = F.coalesce(F.element_at(F.map_from_entries("by_grade"), F.lit(value)), F.lit(0))
        gain = gain + (seen - F.col("all") * share) ** 2 / (F.col("all") * share)
    chosen = sums.filter(F.col("all") >= LEAST_TEXTS).select("bucket", gain.alias("gain")).orderBy(
        F.desc("gain"), "bucket").limit(buckets_kept)
    kept = np.full(HASH_BUCKETS, -1, dtype=np.int32)
    names = sorted(row["bucket"] for row in chosen.collect())
    kept[names] = np.arange(len(names))
    sampled = arrow_map(rated, _rated_buckets, schema, kept=kept).toArrow().combine_chunks()
    grades = np.array([scale[value] for value in sampled.column("grade").to_pylist()], dtype=np.int64)
    lists = sampled.column("buckets").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    bounds, buckets = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    weights, thresholds = fit_thresholds_and_weights(grades, bounds, buckets, len(names), len(scale), penalty)
    full = np.zeros(HASH_BUCKETS, dtype=np.float32)
    full[names] = weights
    return OrdinalModel(full, thresholds)


def score(
    df: DataFrame, model: OrdinalModel | None, least_grade: int, least_tail: float = LEAST_TAIL, text_column: str = "text",
    names: tuple[str, ...] = ("score", "expected_grade", "tail_probability", "kept"),
) -> DataFrame:
    """Add score, expected_grade, tail_probability (of `least_grade` or better) and kept (tail of `least_tail` or more)."""
    added = tuple(zip(names, (T.DoubleType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))
    if model is None:
        values = dict.fromkeys(names, F.lit(None).cast("double")) | {names[-1]: F.lit(True)}
        return df.withColumns(values)
    least_grade = min(least_grade, len(model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_column)
            scores = [np.empty(0)]
            for block in kernels.blocks(texts):
                rows, buckets = text_buckets(block)
                scores.append(np.bincount(rows, weights=model.weights[buckets], minlength=block.rows))
            values = np.concatenate(scores)
            tails = model.tails(values)
            tail = tails[:, least_grade - 1]
            extra = dict(zip(names, map(pa.array, (values, tails.sum(axis=1), tail, tail >= least_tail)), strict=True))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | extra
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    fields = {field.name: field for field in df.schema.fields} | {name: T.StructField(name, kind) for name, kind in added}
    return df.mapInArrow(run, T.StructType(list(fields.values())))
