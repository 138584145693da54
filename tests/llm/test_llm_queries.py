from __future__ import annotations

import glob
import os

import duckdb
import pytest

from gridloom.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_runs(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    rows = df.collect()
    if name in catalog.ORACLE:
        con = duckdb.connect()
        for f in glob.glob(f"{small}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        assert sorted(map(tuple, rows)) == sorted(con.execute(catalog.ORACLE[name]).fetchall())
    else:
        assert rows
