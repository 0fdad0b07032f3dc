"""Known words, and counting the words that are not among them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.sources.storage import materialize

BROADCAST_WORDS = 1_000_000
EXPRESSION_WORDS = 2_000
SALTS = 64
TOKENS_PER_SALT = 1_000_000


def glossary_words(terms: DataFrame, column: str) -> DataFrame:
    """Distinct lower-case words of glossary terms, split at spaces and hyphens."""
    parts = F.split(F.lower(F.replace(F.col(column), F.lit("-"), F.lit(" "))), r"(?U)\s+")
    return terms.select(F.explode(parts).alias("word")).where(tx.present(F.col("word"))).distinct()


def frequent_words(df: DataFrame, text: str, minimum_count: int) -> DataFrame:
    """Words occurring at least ``minimum_count`` times, counted before the shuffle."""
    words = df.select(F.explode(tx.tokens(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum_count).select("word")


def unknown_word_counts(
    rows: DataFrame,
    keys: Sequence[str],
    tokens: str,
    vocabulary: DataFrame,
    vocabulary_size: int,
    broadcast_words: int = BROADCAST_WORDS,
    salts: int = SALTS,
) -> DataFrame:
    """Evaluated and unknown words per row.

    ``keys`` identify a row. Repeats within a row are counted before the join.
    A vocabulary of checked size is broadcast. A larger one is joined by word;
    since a common word occurs in most rows, words are salted by row there, and
    the vocabulary repeated once per salt.
    """
    words = rows.select(*keys, F.explode_outer(tokens).alias("word"))
    counted = words.groupBy(*keys, "word").agg(F.count("word").alias("n")) if vocabulary_size > broadcast_words else (
        words.withColumn("n", F.when(F.col("word").isNotNull(), 1).otherwise(0).cast("bigint"))
    )
    known = vocabulary.select("word", F.lit(True).alias("is_known"))
    if vocabulary_size <= broadcast_words:
        matched = counted.join(F.broadcast(known), "word", "left")
    else:
        salted = counted.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
        repeated = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        matched = salted.join(repeated, ["word", "salt"], "left")
    return matched.groupBy(*keys).agg(
        F.sum("n").alias("evaluated_words"),
        F.sum(F.when(F.col("is_known").isNull(), F.col("n")).otherwise(0)).alias("unknown_words"),
    )


def with_unknown_words(
    rows: DataFrame, tokens: str, vocabulary: DataFrame, vocabulary_size: int, broadcast_words: int = BROADCAST_WORDS,
    tokens_per_salt: int = TOKENS_PER_SALT,
) -> DataFrame:
    """Every row with its evaluated and unknown words; the tokens go, and are neither shuffled as rows nor stored in clear.

    Tokens are counted where they are, against a vocabulary of checked size. Where that is too large, rows are stored with hashes in
    place of tokens, and looked up by the words of these rows that are not in it; only where both are too large, by a salted join.
    """
    if vocabulary_size <= broadcast_words:
        return _counted_inside(rows, tokens, vocabulary)
    return _counted_by_hash(rows, tokens, vocabulary, broadcast_words, tokens_per_salt)


def _known_words(words: pa.Array) -> Callable[[Column], Column]:
    """How many tokens of a list are among the words, which go to every task."""

    def count(lists: pa.Array) -> pa.Array:
        known = pc.is_in(lists.flatten(), value_set=words).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")
        ends = np.cumsum(sizes)
        so_far = np.concatenate([[0], np.cumsum(known, dtype="int64")])
        return pa.array(so_far[ends] - so_far[ends - sizes], pa.int64())

    return F.arrow_udf(count, "bigint")


def _few_known_words(words: pa.Array, tokens: str) -> Column:
    """The same for words that travel inside the expression, as a hash set; no Python worker is needed."""
    listed = ", ".join(f"cast(X'{word.encode().hex()}' as string)" for word in words.to_pylist()) or "null"
    column = "`" + tokens.replace("`", "``") + "`"
    return F.coalesce(F.expr(f"size(filter({column}, token -> token in ({listed})))"), F.lit(0)).cast("bigint")


def _counted_inside(rows: DataFrame, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """Count a row's tokens in the row itself: nothing is exploded or shuffled, and columns nobody asks for are not computed."""
    words = vocabulary.where(F.col("word").isNotNull()).select("word").distinct().toArrow()["word"].combine_chunks().cast(pa.string())
    evaluated = F.coalesce(F.size(F.array_compact(tokens)), F.lit(0)).cast("bigint")
    known = _few_known_words(words, tokens) if len(words) <= EXPRESSION_WORDS else _known_words(words)(F.col(tokens))
    counted = rows.withColumns({"evaluated_words": evaluated, "unknown_words": known})
    return counted.withColumn("unknown_words", F.col("evaluated_words") - F.col("unknown_words")).drop(tokens)


def _hash_pair(word: Column) -> Column:
    """128 bits that stand for a word."""
    return F.struct(F.xxhash64(word).alias("a"), F.xxhash64(word, F.lit("second")).alias("b"))


def _counted_by_hash(rows: DataFrame, tokens: str, vocabulary: DataFrame, broadcast_words: int, tokens_per_salt: int) -> DataFrame:
    """Look words up by hash, in rows that are stored once with the hashes of their tokens: texts are not inspected again.

    Words not in the vocabulary are sent to every task if they are few enough. If not, a word is spread over salts by its measured
    frequency; words of more than a salt's tokens are fewer than all tokens divided by that number, which is raised until they can
    be sent to every task.
    """
    number = "_row_number"
    hashed = rows.withColumn(tokens, F.transform(F.array_compact(tokens), _hash_pair)).withColumn(number, F.monotonically_increasing_id())
    stored = materialize(hashed, "numbered-rows")
    each = stored.select(number, F.explode(tokens).alias("word"))
    words = materialize(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    known = vocabulary.where(F.col("word").isNotNull()).select(_hash_pair(F.col("word")).alias("word")).distinct()
    unknown = materialize(words.join(known, "word", "left_anti"), "unknown-words")
    if unknown.limit(broadcast_words + 1).count() <= broadcast_words:
        found = each.join(F.broadcast(unknown), "word", "left_semi").withColumn("n", F.lit(1).cast("bigint"))
    else:
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        per_salt = max(tokens_per_salt, total // max(1, broadcast_words) + 1)
        salts = F.ceil(F.col("n") / per_salt)
        heavy = words.where(F.col("n") > per_salt).select("word", salts.alias("salts"))
        counted = each.groupBy(number, "word").agg(F.count(F.lit(1)).alias("n"))
        salted = counted.join(F.broadcast(heavy), "word", "left").withColumn(
            "salt", F.pmod(F.xxhash64(number), F.coalesce("salts", F.lit(1))))
        repeated = unknown.select("word", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
        found = salted.join(repeated, ["word", "salt"], "left_semi")
    missed = found.groupBy(number).agg(F.sum("n").alias("unknown_words"))
    evaluated = F.when(F.col(tokens).isNull(), 0).otherwise(F.size(tokens)).cast("bigint")
    return stored.withColumn("evaluated_words", evaluated).drop(tokens).join(missed, number, "left").withColumn(
        "unknown_words", F.coalesce("unknown_words", F.lit(0))).drop(number)


def vocabulary_size(vocabulary: DataFrame) -> int:
    return vocabulary.count()
