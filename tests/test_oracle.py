"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
from praxilog.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    text = lambda x: "null" if x is None or x != x else repr(round(float(x), 7)) if isinstance(x, (int, float, bool, np.number, np.bool_)) else str(x)
    return sorted(tuple(text(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    assert rows_of(registry.QUERIES[name](spark, SF).toPandas()) == rows_of(con.sql(registry.SQL[name]).df())
