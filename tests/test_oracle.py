"""Every query with a SQL form gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from riskloom import oracle, queries

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(frame):
    def value(v):
        if pd.isna(v):
            return "None"
        return str(v) if isinstance(v, (bool, np.bool_, str)) else repr(round(float(v), 9))

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).toPandas() is not None
