"""Folding new files into stored results.

Every batch is reduced to mergeable partial tables: states of the rules, topic counts by group and category, the smallest
fingerprints of failing rows, and counts of failures. They are committed as one segment of a log-structured store, which folds
its segments level by level (`sources.segments`), so the store stays small however many batches there are. Ratios, caps of
categories, group limits and the evidence limit are applied only when results are read, over the merged tables; they equal
the results of one run over all files. A batch that is replayed changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parlance import fixed_values as fixed
from parlance.operators import evidence as ev
from parlance.operators import grouping as grp
from parlance.operators.grouping import Grouping
from parlance.operators.rules import base, topics
from parlance.operators.rules.base import Rule
from parlance.sources.segments import Fold, SegmentLog
from parlance.sources.storage import materialize

STATES, TOPICS, FIRST, OBSERVED = "states", "topics", "first_failures", "observed_failures"
Prepare = Callable[[DataFrame], DataFrame]
MakeRules = Callable[[DataFrame], Sequence[Rule]]


@dataclass(frozen=True)
class TopicSource:
    """The column that holds topics, and how they are split and mapped."""

    column: str
    ontology: topics.Ontology = ()
    fallback: str = fixed.TOPIC_FALLBACK
    delimiters: str = fixed.TOPIC_DELIMITERS


@dataclass(frozen=True)
class EvidenceSource:
    """What names a failing row, and how many rows are kept of each group."""

    row_key: str
    source: str
    salt: bytes
    per_group: int = fixed.EVIDENCE_PER_RULE_GROUP


def partial_tables(
    ready: DataFrame, grouping: Grouping, rules: Sequence[Rule], topic: TopicSource | None = None,
    evidence: EvidenceSource | None = None,
) -> dict[str, DataFrame]:
    """The mergeable tables of some prepared rows."""
    keyed = grp.group_keys(ready, grouping)
    tables = {}
    if rules:
        tables[STATES] = grp.partial_states(keyed, grouping, base.rule_states(rules))
    if topic:
        tables[TOPICS] = topics.topic_partials(keyed, topic.column, grouping, topic.ontology, topic.fallback, topic.delimiters)
    if evidence:
        failing = materialize(
            ev.fingerprinted(ev.failures(keyed, rules, grouping, evidence.row_key), evidence.row_key, evidence.source, evidence.salt),
            "failures",
        )
        tables[FIRST] = ev.first_of_groups(failing, grouping, evidence.per_group)
        tables[OBSERVED] = ev.observed_failures(failing, grouping)
    return tables


def folds(grouping: Grouping, rules: Sequence[Rule], per_group: int = fixed.EVIDENCE_PER_RULE_GROUP) -> dict[str, Fold]:
    """How the rows of each table merge."""
    merges = {name: state.merge for name, state in base.rule_states(rules).items()}
    keys = ["rule_id", "is_overall", *grouping.keys]
    return {
        STATES: lambda df: grp.merge_states(df, grouping, merges),
        TOPICS: lambda df: topics.merge_topic_partials(df, grouping),
        FIRST: lambda df: ev.first_of_groups(df, grouping, per_group),
        OBSERVED: lambda df: df.groupBy(*keys).agg(F.sum("observed_count").alias("observed_count")),
    }


def start_incremental(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    form: str,
    partials: str,
    checkpoint: str,
    grouping: Grouping,
    make_rules: MakeRules,
    prepare: Prepare = lambda df: df,
    files_per_batch: int | None = None,
    topic: TopicSource | None = None,
    evidence: EvidenceSource | None = None,
    fanout: int = 8,
    spread: bool = False,
) -> StreamingQuery:
    """Process the files that arrived since the last run into the store at ``partials``, then stop.

    ``prepare`` adds the feature columns; ``make_rules`` builds the rules from
    the prepared frame. ``spread`` deals the rows of a batch over all cores
    before they are prepared: a row group, which may be a whole file, is otherwise
    one task's, which hurts where each row is costly to inspect.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        log = SegmentLog(spark, partials, fanout)
        if batch_id <= log.committed():
            return
        if spread:
            batch = batch.repartition(max(spark.sparkContext.defaultParallelism, batch.rdd.getNumPartitions()))
        # Rows are prepared once for all tables; what a rule needs of a text is a feature by then.
        ready = materialize(prepare(batch), "prepared-batch") if topic or evidence else prepare(batch)
        rules = make_rules(ready)
        log.commit(batch_id, partial_tables(ready, grouping, rules, topic, evidence))
        log.fold(folds(grouping, rules, evidence.per_group if evidence else fixed.EVIDENCE_PER_RULE_GROUP))

    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.load(source).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def compact(
    spark: SparkSession, partials: str, grouping: Grouping, rules: Sequence[Rule], per_group: int = fixed.EVIDENCE_PER_RULE_GROUP
) -> int:
    """Fold all segments into one; returns how many were replaced."""
    return SegmentLog(spark, partials).fold(folds(grouping, rules, per_group), everything=True)


def _merged(spark: SparkSession, partials: str, tables: Mapping[str, Fold]) -> dict[str, DataFrame]:
    """Merged tables as of one version of the store, written once: folding may remove the segments they came from."""
    log = SegmentLog(spark, partials)
    live = log.segments()
    found = {}
    for name, fold in tables.items():
        rows = log.read(name, live)
        if rows is None:
            raise ValueError(f"the store holds no table {name!r}")
        found[name] = materialize(fold(rows), f"merged-{name}")
    return found


def stored_states(spark: SparkSession, partials: str, grouping: Grouping, rules: Sequence[Rule]) -> DataFrame:
    """Stored states of all batches, merged and rolled up."""
    merges = {name: state.merge for name, state in base.rule_states(rules).items()}
    merged = _merged(spark, partials, {STATES: folds(grouping, rules)[STATES]})[STATES]
    return grp.roll_up(grp.limit_groups(merged, grouping), grouping, merges)


def stored_metrics(
    spark: SparkSession, partials: str, grouping: Grouping, rules: Sequence[Rule], decimals: int | None = fixed.RESULT_DECIMALS
) -> DataFrame:
    """Metrics as of the last batch; ratios are formed only here."""
    return base.metric_table(stored_states(spark, partials, grouping, rules), rules, grouping, decimals)


def stored_topics(
    spark: SparkSession, partials: str, grouping: Grouping, limit: int = fixed.CATEGORIES_PER_GROUP
) -> topics.TopicTables:
    """Topic tables as of the last batch; `topics.topic_metrics` makes distribution and drift metrics of them."""
    merged = _merged(spark, partials, {TOPICS: folds(grouping, ())[TOPICS]})[TOPICS]
    return topics.topic_tables(merged, grouping, limit)


def stored_evidence(
    spark: SparkSession, partials: str, grouping: Grouping, rules: Sequence[Rule],
    per_group: int = fixed.EVIDENCE_PER_RULE_GROUP, in_total: int = fixed.EVIDENCE_IN_TOTAL,
) -> tuple[DataFrame, DataFrame]:
    """Evidence records and totals as of the last batch; groups beyond the limit are folded before they are ranked."""
    folding = folds(grouping, rules, per_group)
    merged = _merged(spark, partials, {name: folding[name] for name in (STATES, FIRST, OBSERVED)})
    kept = grp.kept_groups(merged[STATES], grouping)
    first, observed = (
        folding[name](grp.fold_groups(merged[name], grouping, kept, ~F.col("is_overall"))) for name in (FIRST, OBSERVED))
    records = ev.evidence_table(first, grouping, in_total)
    return records, ev.evidence_totals(observed, records, grouping)


def merge_category_counts(parts: Sequence[DataFrame], keys: Sequence[str], category: str, count: str) -> DataFrame:
    """Category counts of several batches added up; nothing is capped before the sum."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(*keys, category).agg(F.sum(count).alias(count))
