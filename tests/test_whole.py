"""Queries over tables of more than one run and of more than 300 frames."""

import duckdb
import pandas as pd
import pytest

from voltwarden import catalog

SF = "/root/testdata/sf0.01"


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    c = sorted(df.columns)
    return df[c].sort_values(c, na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", ["anchor_lookup", "pad_locf", "attack_profile", "glitch_diagnosis", "layer_union", "json_bus", "verify_runs"])
def test_whole_tables(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(ordered(got), ordered(want), check_dtype=False, rtol=0, atol=1e-9)
    if "run_id" in got:
        assert got.run_id.nunique() == want.run_id.nunique() > 1
