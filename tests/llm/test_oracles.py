"""The queries of this package against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from meshwork.llm import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, D).toPandas(), duck.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values("doc_id").reset_index(drop=True).astype(object).where(lambda f: f.notna(), None) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
