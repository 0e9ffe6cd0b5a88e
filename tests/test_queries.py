"""Every query with SQL gives the rows that DuckDB gives, and the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from karst.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SLOW = {"em_emu", "em_pcangsd", "pca_iram", "hw_em"}  # tested by their invariants


def frame(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_integer_dtype(df[c]):
            df[c] = df[c].astype("float64")
        elif not pd.api.types.is_float_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(object)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return lambda sql: c.execute(sql).df()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in ORACLES:
        pd.testing.assert_frame_equal(frame(got), frame(oracle(ORACLES[name])), check_dtype=False, rtol=0, atol=1.1e-6)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(ORACLES) <= set(QUERIES)
