"""Every registered telemetry query gives the rows of its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from voltwarden import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    c = sorted(df.columns)
    return df[c].sort_values(c, na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, rtol=0, atol=1e-9)
