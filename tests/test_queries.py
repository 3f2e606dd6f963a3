"""Every registered query of the library that has SQL gives the rows of its SQL."""

import glob
import math
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumirel.plans import analysis_queries, frame_queries, list_queries, pixel_queries, registry  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, numbers.Number) and math.isnan(v)):
        return "null"
    return repr(float(v) + 0.0) if isinstance(v, numbers.Number) else repr(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got = rows(registry.QUERIES[name](spark, sf_dir).toPandas())
    want = rows(duck.sql(registry.SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
