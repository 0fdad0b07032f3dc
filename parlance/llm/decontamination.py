"""Benchmark decontamination by winnowing, in DataFrame functions only.

A document word is hit if it lies in an occurrence of a window: `window_words` consecutive words of a benchmark item, or all
words of a shorter item. Winnowing keeps, of every window of a document, the rightmost least hash of its k-grams; equal
windows keep the same k-gram at the same place, so a shared window always shares a fingerprint, while a document has
only about 2 / (window_words - k + 2) fingerprints a word. Fingerprints of documents are joined with those of the items'
windows; each match fixes where the whole window would start, and there it is compared word by word. Items shorter than a
window have fingerprints of their own length, which are sought at every word.

Documents are scanned once for fingerprints and once more, joined with their candidates, for the comparison; a Bloom
filter of the candidates' ids keeps most others out of that join's shuffle. The item side
is not hinted: Spark broadcasts it if it is small and sorts both sides if not, splitting hot keys.

Cases: a null or empty text has no words and no hits; an item without words has no windows; a document shorter than an item's
window cannot hold it; rows that repeat a document id are judged one by one, told apart by a checksum of their text, and equal
rows are equal; equal items are all named; null ids are ids of their own; with no items nothing is hit; an empty table gives
an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import filtered_scans, stored

WINDOW_WORDS = 10
GRAM_WORDS = 5
# What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACES = (1 << 31) - 1


def item_words(text: Column) -> Column:
    """Lower-case A-Z only, and split; `lower` does the same faster where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def _gram(hashes: str, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.col(hashes)[at + step] for step in range(length)])


def _ranked_grams(hashes: str, gram: int) -> Column:
    """Each k-gram's hash with its place in the low bits, so that the least is the rightmost of the least hashes."""
    last = F.size(hashes) - gram
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last),
        lambda i: _gram(hashes, i, gram).bitwiseAND(F.lit(~_PLACES)).bitwiseOR(F.lit(_PLACES) - i.cast("bigint")),
    ))


def _winnowed(ranked: str, width: int) -> Column:
    last = F.size(ranked) - width
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.least(*[F.col(ranked)[i + step] for step in range(width)])
        if width > 1 else F.col(ranked)[i],
    )))


def _hashed(words: str) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def item_windows(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """Rows item, length and words (joined by spaces), one for each distinct window of an item."""
    split = items.select(items[id_column].cast("string").alias("item"), item_words(items[text_column].cast("string")).alias("words"))
    length = F.least(F.lit(window), F.size("words"))
    starts = split.filter(F.size("words") > 0).select(
        "item", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"))
    return starts.select(
        "item", "length", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window")).distinct()


def _long_candidates(signed: DataFrame, windows: DataFrame, window: int, gram: int) -> DataFrame:
    prints = (
        windows.select("window", _hashed_words("window").alias("hashes"))
        .select("window", _ranked_grams("hashes", gram).alias("grams"))
        .select("window", F.array_min("grams").alias("least"))
        .select("window", F.col("least").bitwiseAND(F.lit(~_PLACES)).alias("print"),
                (F.lit(_PLACES) - F.col("least").bitwiseAND(F.lit(_PLACES))).alias("shift"))
    )
    held = signed.select("id", "version", "n_words", F.explode("prints").alias("least")).select(
        "id", "version", "n_words", F.col("least").bitwiseAND(F.lit(~_PLACES)).alias("print"),
        (F.lit(_PLACES) - F.col("least").bitwiseAND(F.lit(_PLACES))).alias("place"),
    )
    start = F.col("place") - F.col("shift")
    return held.join(prints, "print").filter((start >= 0) & (start + window <= F.col("n_words"))).select(
        "id", "version", start.cast("int").alias("start"), F.lit(window).alias("length"), "window")


def _hashed_words(window: str) -> Column:
    return F.transform(F.split(window, " "), lambda word: F.xxhash64(word))


def _short_candidates(texts: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    prints = windows.select("window", _hashed_words("window").alias("hashes")).select(
        "window", _gram("hashes", F.lit(0), length).alias("print"))
    hashed = texts.select("id", "version", item_words(F.col("text")).alias("words")).select(
        "id", "version", _hashed("words").alias("hashes")).filter(F.size("hashes") >= length)
    held = hashed.select("id", "version", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size("hashes") - length), lambda i: _gram("hashes", i, length))).alias("start", "print"))
    return held.join(prints, "print").select("id", "version", "start", F.lit(length).alias("length"), "window")


def contamination(
    documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text", window_words: int = WINDOW_WORDS,
    gram_words: int = GRAM_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted as strings) and contaminated."""
    if not 1 <= gram_words <= window_words:
        raise ValueError("a k-gram must fit a window")
    text = documents[text_column].cast("string")
    texts = documents.select(
        documents[id_column].alias("id"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("version"), text.alias("text"))
    windows = stored(item_windows(items, item_id_column, item_text_column, window_words), "windows")
    signed = stored(
        texts.select("id", "version", item_words(F.col("text")).alias("words"))
        .select("id", "version", F.size("words").alias("n_words"), _hashed("words").alias("hashes"))
        .select("id", "version", "n_words", _ranked_grams("hashes", gram_words).alias("grams"))
        .select("id", "version", "n_words", _winnowed("grams", window_words - gram_words + 1).alias("prints")),
        "fingerprints",
    )
    distinct = windows.select("length", "window").distinct()
    found = _long_candidates(signed, distinct.filter(F.col("length") == window_words), window_words, gram_words)
    # At most window_words - 1 lengths.
    for row in sorted(windows.filter(F.col("length") < window_words).select("length").distinct().collect()):
        short = distinct.filter(F.col("length") == row["length"])
        found = found.union(_short_candidates(texts, short, row["length"]))
    asked = stored(
        found.groupBy("id", "version").agg(F.collect_set(F.struct("start", "length", "window")).alias("asked")), "candidates")

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["id"].eqNullSafe(right["key"]) & (left["version"] == right["key_version"])

    named = asked.filter(F.size("asked") > 0).select(F.col("id").alias("key"), F.col("version").alias("key_version"), "asked")
    extended = texts.join(named, same(texts, named)).select("id", "version", item_words(F.col("text")).alias("words"), "asked").select(
        # Both conditions use the words: used once, they would be split anew for every candidate.
        "id", "version", F.filter("asked", lambda c: (c["start"] + c["length"] <= F.size("words")) & (F.array_join(
            F.slice("words", c["start"] + 1, c["length"]), " ") == c["window"])).alias("hits"),
    ).filter(F.size("hits") > 0)
    covered = F.array_distinct(F.flatten(F.transform(
        "hits", lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1))))
    with filtered_scans(documents.sparkSession):
        hits = stored(extended.select(
            "id", "version", F.size(covered).cast("bigint").alias("n_hit"),
            F.array_distinct(F.transform("hits", lambda c: c["window"])).alias("windows"),
        ).distinct(), "hits")
    items_of = (
        hits.select("id", "version", "n_hit", F.explode("windows").alias("window"))
        .join(windows.select("item", "window"), "window").groupBy("id", "version")
        .agg(F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.col("id").alias("key"), F.col("version").alias("key_version"), "n_hit", "items")
    )
    return signed.join(items_of, same(signed, items_of), "left").select(
        F.col("id").alias(id_column), F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
