"""Every query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    cursor = db.execute(catalogue.ORACLE_SQL[name])
    names, rows = [c[0] for c in cursor.description], cursor.fetchall()
    got = catalogue.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert plain(rows) == plain(tuple(r[c] for c in names) for r in got.collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
