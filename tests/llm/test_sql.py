"""Training-data queries that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest

from parlance.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings", "pages"):
        engine.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    expected = engine.execute(ORACLES[name])
    columns = sorted(item[0] for item in expected.description)
    places = [[item[0] for item in expected.description].index(c) for c in columns]
    want = sorted(tuple(row[i] for i in places) for row in expected.fetchall())
    found = QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == columns
    assert sorted(tuple(row) for row in found.select(*columns).collect()) == want


def test_every_operator_has_a_query():
    assert sorted({int(name[2:].split("_")[0]) for name in QUERIES}) == list(range(1, 14))
