"""Queries give whole results; test_oracle compares all of them with their SQL."""

import __spark_entry__ as entry
from harness.profile_queries import ALL_QUANTILE_TABLES, NUMERIC, SCHEMAS
from harness.tables import TABLES
from parlance import fixed_values as fixed

FOLDER = "/root/testdata/sf0.001"


def run(spark, name):
    return entry.queries()[name](spark, FOLDER)


def test_all_groups_in_order(spark):
    whole, leading = run(spark, "ordered_groups").collect(), run(spark, "leading_groups").collect()
    assert len(whole) > 25 and whole == leading
    assert sum(row["row_count"] for row in whole if not row["is_overall"]) == whole[0]["row_count"]


def test_quantiles_of_every_numeric_column(spark):
    wanted = {(t, c) for t in TABLES for c, kind in SCHEMAS[t].items() if kind in NUMERIC}
    assert {t for t, _ in wanted} == set(ALL_QUANTILE_TABLES)
    found = run(spark, "all_column_quantiles_of_rows").select("table_name", "column_name").distinct().collect()
    assert {tuple(row) for row in found} == wanted


def test_default_caps(spark):
    kept, dropped = run(spark, "fact_table").count(), run(spark, "dropped_facts").first()[0]
    assert 50 < kept <= fixed.FACTS_KEPT and (dropped == 0 or kept == fixed.FACTS_KEPT)
    assert 60 < run(spark, "evidence_records").count() <= fixed.EVIDENCE_IN_TOTAL
