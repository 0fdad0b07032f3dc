"""Every registered query against its SQL, on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from harness.tables import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda position: columns[position])
    return sorted((tuple(plain(record[position]) for position in order) for record in records), key=repr)


def own(names):
    """Without the training-data operators, which have tests of their own."""
    return sorted(name for name in names if not re.match(r"op\d+_|pipeline$", name))


def test_every_query_has_sql():
    assert own(entry.queries()) == own(entry.oracle_sql())


@pytest.mark.parametrize("name", own(entry.queries()))
def test_query_matches_sql(spark, engine, name):
    found = entry.queries()[name](spark, FOLDER)
    expected = engine.execute(entry.oracle_sql()[name])
    columns = [item[0] for item in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
