"""Registered queries against their SQL on the smallest sample; check.py compares all of them."""

import os

import duckdb
import pytest

import check
from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="sample tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in check.TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMOKE_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, SMOKE_DIR)
    relation = db.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert check.rows(df.columns, df.collect()) == check.rows(relation.columns, relation.fetchall())


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
