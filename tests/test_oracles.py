"""Every query with SQL gives the rows that DuckDB gives for it on the smallest tables; the others give rows."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from pulsemill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype != object and not str(df[c].dtype).startswith(("datetime", "str")):
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), key=lambda x: x.astype(str) if x.dtype == object else x).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, wanted = tidy(QUERIES[name](spark, SF).toPandas()), tidy(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(wanted.columns)
    assert len(got) == len(wanted)
    for c in got.columns:
        if got[c].dtype == float and wanted[c].dtype == float:
            assert np.allclose(got[c], wanted[c], rtol=0, atol=1e-8, equal_nan=True), c
        else:
            assert [None if pd.isna(x) else x for x in got[c]] == [None if pd.isna(x) else x for x in wanted[c]], c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
