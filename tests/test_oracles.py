"""Every query with a statement, against DuckDB, at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from modalis import registry

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")

@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_statement(spark, tables, name):
    got = registry.QUERIES[name](spark, DATA)
    want = tables.sql(registry.ORACLE_SQL[name])
    assert {n: TYPES[t] for n, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    order = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
