"""Every registered query of the graph engine against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from corpusgraph.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def show(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "-"
        return f"{float(v):.6f}" if isinstance(v, float) or (hasattr(v, "dtype") and v.dtype.kind in "if") or type(v) is int else str(v)

    return sorted(tuple(show(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
