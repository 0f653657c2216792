"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from meshwork.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
