"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from inkveil.catalog.core import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows),
        key=lambda row: tuple((v is not None, str(v)) for v in row),
    )


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert got == canonical(names, result.fetchall())


def test_library_queries_have_sql():
    """Only the training-data package may register queries that SQL can't express; it tests those by itself."""
    library = {name for catalog in entry_point._CATALOGS for name in catalog.queries}
    assert library <= set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
