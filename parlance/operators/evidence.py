"""Salted references to failing rows, and deterministic review samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance import fixed_values as fixed
from parlance.functions import dates, hashing
from parlance.functions import text as tx
from parlance.functions.text import quoted
from parlance.operators import grouping as grp
from parlance.operators.grouping import Grouping
from parlance.operators.rules.base import Rule
from parlance.sources.storage import materialize

# Rows expected below a stratum's bound, as a multiple of those wanted, and most strata whose bounds go to every task.
SAMPLE_SURPLUS = 8
MOST_STRATA = 100_000


def failures(keyed: DataFrame, rules: Sequence[Rule], grouping: Grouping, row_key: str) -> DataFrame:
    """One row per failing row, rule and key; a row counts overall and in its group."""
    candidates = F.array(
        *[
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                F.when(rule.failed(), rule.category()).alias("category"),
            )
            for rule in rules
        ]
    )
    failing = F.filter(candidates, lambda item: item["category"].isNotNull())
    each = keyed.select(quoted(row_key), grp.IN_GROUP, *grouping.keys, F.inline(failing))
    scopes = F.array_compact(
        F.array(F.lit(True) if grouping.include_overall else F.lit(None), F.when(F.col(grp.IN_GROUP), F.lit(False)))
    )
    scoped = each.withColumn("is_overall", F.explode(scopes))
    return scoped.withColumns(
        {key: F.when(~F.col("is_overall"), F.col(key)) for key in grouping.keys}
    ).drop(grp.IN_GROUP)


def fingerprinted(failing: DataFrame, row_key: str, source: str, salt: bytes) -> DataFrame:
    """Failures with the salted reference of their row in place of its key."""
    return failing.withColumn("row_fingerprint", hashing.row_fingerprint(source, quoted(row_key), salt)).drop(quoted(row_key))


def first_of_groups(marked: DataFrame, grouping: Grouping, per_group: int = fixed.EVIDENCE_PER_RULE_GROUP) -> DataFrame:
    """The smallest fingerprints of every (rule, key); applied to a union of earlier results it gives those of all rows."""
    keys = ["rule_id", "is_overall", *grouping.keys]
    order = Window.partitionBy(*keys).orderBy("row_fingerprint")
    ranked = marked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_group)
    return ranked.select(*keys, "row_fingerprint", "category", "position")


def observed_failures(failing: DataFrame, grouping: Grouping) -> DataFrame:
    """Failures of every (rule, key); never capped."""
    return failing.groupBy("rule_id", "is_overall", *grouping.keys).agg(F.count(F.lit(1)).alias("observed_count"))


def evidence_table(first: DataFrame, grouping: Grouping, in_total: int = fixed.EVIDENCE_IN_TOTAL) -> DataFrame:
    """Evidence records of ranked fingerprints, the first of every group before any second one."""
    keys = ["rule_id", "is_overall", *grouping.keys]
    kept = first.orderBy("position", *keys, "row_fingerprint").limit(in_total)
    identity = [F.col("rule_id"), F.col("is_overall"), *[F.col(key) for key in grouping.keys], F.col("row_fingerprint")]
    return kept.select(
        hashing.stable_id("ev-", 24, *identity, F.col("category")).alias("evidence_id"),
        *keys,
        "row_fingerprint",
        F.lit("rule_failure").alias("failure_type"),
        "category",
    )


def collect_evidence(
    failing: DataFrame,
    grouping: Grouping,
    row_key: str,
    source: str,
    salt: bytes,
    per_group: int = fixed.EVIDENCE_PER_RULE_GROUP,
    in_total: int = fixed.EVIDENCE_IN_TOTAL,
) -> DataFrame:
    """Retained evidence: the smallest fingerprints of every (rule, key), then overall.

    Both caps are part of the result, which is a bounded review list; the number
    of failures itself is never capped (``evidence_summary``).
    """
    return evidence_table(first_of_groups(fingerprinted(failing, row_key, source, salt), grouping, per_group), grouping, in_total)


def evidence_summary(failing: DataFrame, evidence: DataFrame, grouping: Grouping) -> DataFrame:
    """Observed and retained failures of every (rule, key)."""
    return evidence_totals(observed_failures(failing, grouping), evidence, grouping)


def evidence_totals(observed: DataFrame, evidence: DataFrame, grouping: Grouping) -> DataFrame:
    """Counted failures beside the number of records retained of them."""
    keys = ["rule_id", "is_overall", *grouping.keys]
    retained = evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("retained"))
    same = [observed[key].eqNullSafe(retained[key]) for key in keys]
    return observed.join(retained, same, "left").select(
        *[observed[key] for key in keys],
        "observed_count",
        F.coalesce("retained", F.lit(0)).alias("retained_count"),
        (F.col("observed_count") > F.coalesce("retained", F.lit(0))).alias("truncated"),
    )


def stratified_sample(
    df: DataFrame,
    transcript: str,
    row_key: str,
    source: str,
    direction: str | None = None,
    time_column: str | None = None,
    per_stratum: int = fixed.SAMPLES_PER_STRATUM,
    in_total: int = fixed.SAMPLES_IN_TOTAL,
    characters: int = fixed.SAMPLE_CHARACTERS,
) -> DataFrame:
    """Smallest hashes of each direction and month, redacted for review.

    Strata are counted first, without their texts. Hashes are spread evenly, so the wanted rows of a stratum lie below a
    bound that follows from its size: one scan of the texts redacts the rows below their bounds, a few for each stratum. A stratum that
    has too few of these, since its texts are mostly blank or its keys repeat, is ranked in full, by key before text.
    """
    spoken = F.lit(fixed.ALL_VALUES)
    if direction:
        named = F.lower(tx.strip(quoted(direction).cast("string")))
        spoken = F.when(F.coalesce(named, F.lit("")) == "", F.lit(fixed.UNKNOWN_VALUE)).otherwise(named)
    month = F.lit(fixed.ALL_TIMES)
    if time_column:
        moment = dates.wall_clock(quoted(time_column), df.schema[time_column].dataType, "UTC")
        month = F.coalesce(dates.bucket(moment, "month"), F.lit(fixed.UNKNOWN_TIME))
    stratum = F.concat_ws("|", spoken, month)
    marked = df.where(quoted(row_key).isNotNull()).select(
        stratum.alias("stratum"), hashing.sample_hash(source, quoted(row_key)).alias("hash"), quoted(transcript).alias("said"),
        quoted(row_key).alias("sample_key"))
    sizes = marked.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    bounded = sizes.withColumn("share", F.least(F.lit(1.0), SAMPLE_SURPLUS * per_stratum / F.col("n"))).withColumn(
        "bound", F.format_string("%08x", F.least(F.lit((1 << 32) - 1), (F.col("share") * (1 << 32)).cast("bigint"))))
    bounded = materialize(bounded.select("stratum", "share", "bound"), "strata")
    shortened = F.substring(tx.redact_sample(F.col("said")), 1, characters).alias("sample")
    if bounded.limit(MOST_STRATA + 1).count() > MOST_STRATA:
        drawn = _ranked_in_full(marked, per_stratum, in_total, shortened)
    else:
        below = marked.join(F.broadcast(bounded), "stratum").where((F.substring("hash", 1, 8) <= F.col("bound")) & tx.present(F.col("said")))
        near = materialize(below.select("stratum", "hash", shortened), "sample-rows")
        held = near.groupBy("stratum").agg(F.count(F.lit(1)).alias("held"))
        short = bounded.where("share < 1").join(held, "stratum", "left").where(F.coalesce("held", F.lit(0)) < per_stratum)
        lacking = [row["stratum"] for row in short.select("stratum").collect()]
        drawn = near.where(~F.col("stratum").isin(lacking)) if lacking else near
        if lacking:
            drawn = drawn.unionByName(_ranked_in_full(marked.where(F.col("stratum").isin(lacking)), per_stratum, in_total, shortened))
    order = Window.partitionBy("stratum").orderBy("hash")
    first = drawn.withColumn("position", F.row_number().over(order)).where(F.col("position") <= per_stratum)
    return first.orderBy("hash").limit(in_total).select(F.concat(F.lit("sha256:"), F.col("hash")).alias("sample_id"), "stratum", "sample")


def _ranked_in_full(marked: DataFrame, per_stratum: int, in_total: int, shortened: Column) -> DataFrame:
    """Ranking needs only the hash and the stratum; a join then fetches the few chosen texts, so text is neither sorted nor shuffled."""
    present = marked.where(tx.present(F.col("said")))
    order = Window.partitionBy("stratum").orderBy("hash")
    ranked = present.select("sample_key", "stratum", "hash").withColumn("position", F.row_number().over(order))
    chosen = ranked.where(F.col("position") <= per_stratum).orderBy("hash").limit(in_total).select(F.col("sample_key").alias("chosen_key")).distinct()
    # At most in_total rows, hence the broadcast.
    return present.join(F.broadcast(chosen), F.col("sample_key") == F.col("chosen_key")).select("stratum", "hash", shortened)


def within_budget(samples: DataFrame, budget: int = fixed.SAMPLE_CHARACTER_BUDGET) -> DataFrame:
    """The leading samples whose texts together fit the character budget; a first one that alone exceeds it is cut.

    Samples number at most a few dozen, which makes the single ordering safe.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("sample_id")
    first = F.row_number().over(order) == 1
    shortened = samples.withColumn("sample", F.when(first, F.substring("sample", 1, budget)).otherwise(F.col("sample")))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        shortened.withColumn("characters_so_far", F.sum(F.length("sample")).over(so_far))
        .where(F.col("characters_so_far") <= budget)
    )
