"""From raw documents to training sequences: five stages, each written before the next one reads it.

1. Quality: an ordinal classifier fitted on the ratings drops documents that are probably toxic or of low quality.
2. Near-duplicates: of each group of documents that share 80 % of their five-word shingles, the one with the least id stays.
3. Repeated passages: runs of 35 words or more that start in two places or more are cut out; the rest of a text stays as it
   was, and a document of which nothing is left goes.
4. Benchmarks: documents that hold ten consecutive words of a benchmark item go.
5. Pieces: texts are encoded and decoded again; `piece_ids` and `decoded` are added.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. Stages 1 to 4 return the columns of documents. Rows are told apart by
a number of their own, stored with them, and not by doc_id: rows that share one, or have none, are judged by their own texts.
Null and empty texts hold nothing that could be a copy, so stage 2 keeps them, and stage 3 drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontamination, minhash_dedup, piece_codec, quality_classifier, substring_dedup
from parlance.llm.queries import GOOD, rated_grade
from parlance.llm.tables import stored, table

REPEATED_WORDS = 35


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), rated_grade())
    names = ("_quality_score", "_quality_grade", "_quality_tail", "_quality_kept")
    return quality_classifier.score(docs, model, GOOD, names=names).filter("_quality_kept").select(*docs.columns)


def numbered_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number of each row, written so that every reader sees the same numbers; and the number's name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-documents"), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, number = numbered_rows(docs)
    found = minhash_dedup.near_duplicates(rows, id_column=number).select(number, "component_id")
    # Of each group the row with the least doc_id stays, one without an id only where no other is left.
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number).alias("row")))
    leaders = found.join(rows.select(number, "doc_id"), number).groupBy("component_id").agg(least.alias("least"))
    return rows.join(leaders.select(F.col("least.row").alias(number)), number, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carried = [name for name in docs.columns if name not in ("doc_id", "text", "n_chars")]
    cut = substring_dedup.remove_repeated(
        docs.withColumnsRenamed({name: f"_{i}" for i, name in enumerate(carried)}), min_words=REPEATED_WORDS, rejoin=False,
        carried=tuple(f"_{i}" for i in range(len(carried))),
    ).filter("n_removed < n_words")
    named = {name: F.col(f"_{i}") for i, name in enumerate(carried)} | {
        "doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return cut.select(*(named[name].alias(name) for name in docs.columns))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, number = numbered_rows(docs)
    found = decontamination.contamination(rows, table(spark, sf_dir, "benchmark"), id_column=number)
    return rows.join(found.filter("contaminated").select(number), number, "left_anti").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmarks),
    ("sentencepiece encoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


# Fitting the classifier and encoding pieces cannot be expressed in SQL; tests/llm/test_pipeline.py checks every stage.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
