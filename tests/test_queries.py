"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from termscan.queries import QUERIES

duckdb = pytest.importorskip("duckdb")

ORACLE = {name: sql for name, sql in entry_module.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection(small_dir):
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small_dir}/{name}.parquet')")
    return connection


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small_dir, connection, name):
    frame = QUERIES[name](spark, small_dir)
    got = rows_by_name(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(ORACLE[name])
    want = rows_by_name([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_flagship(spark, small_dir):
    assert entry_module.entry(spark).columns == ["term", "total", "score", "tier"]
