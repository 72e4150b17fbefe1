"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from bibliora.plans import catalog

FOLDER = Path(os.environ.get("BENCH_TEST_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str([plain(v) for v in value]) if isinstance(value, list) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    rows = catalog.QUERIES[name](spark, str(FOLDER))
    found = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(rows.columns)
    expected = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows.select(columns).collect()) == expected


#: What SQL cannot express; tests of their own hold these against brute force.
WITHOUT_SQL = {"series_forecasts", "spelling_join"}


def test_every_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES) - WITHOUT_SQL
