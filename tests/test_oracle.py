"""Every registered query against its DuckDB SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 6)
        return value
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    got = comparable(frame.columns, frame.collect())
    assert got
    if name in SQL:
        expected = duck.sql(SQL[name])
        assert sorted(frame.columns) == sorted(expected.columns)
        assert got == comparable(expected.columns, expected.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
