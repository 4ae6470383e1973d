"""Every registered query that has SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

from tidewell.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[: -len('.parquet')]} as select * from '{DATA}/{f}'")
    return con


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = ordered(df.select(columns).collect())
    assert rows
    if name in catalogue.oracle_sql():
        rel = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(rel.columns) == columns
        assert rows == ordered(rel.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
