"""Every query with SQL agrees with DuckDB at the smallest scale."""

import glob
from pathlib import Path

import duckdb
import pytest

from spanalytics.plans import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not there")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


def normal(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.sql(oracle.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)


def test_every_table_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.SQL)
