"""Every query of the market operators against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tickloom.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        # Zero has no sign here.
        return f"{round(v, 5) + 0.0:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE_SQL:
        assert rows_of(got) == rows_of(con.sql(ORACLE_SQL[name]).df())
