"""Every query runs on the smallest tables; those with SQL agree with DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from gridloom.plans import catalog


def canonical(rows, columns, order):
    at = [columns.index(c) for c in order]
    show = lambda v: round(v, 6) if isinstance(v, float) else None if v is None else str(v)
    return sorted((tuple(show(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    order = sorted(df.columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns, order)
    if name in catalog.ORACLE:
        result = duck.execute(catalog.ORACLE[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == order
        assert got == canonical(result.fetchall(), columns, order)


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage_and_with_a_broken_one(monkeypatch):
    import importlib
    import importlib.util
    import sys

    import __spark_entry__ as entry

    with monkeypatch.context() as m:
        m.setattr(importlib.util, "find_spec", lambda name: None)
        assert set(importlib.reload(entry).queries()) == set(catalog.QUERIES)
        m.setattr(importlib.util, "find_spec", lambda name: name)
        m.setitem(sys.modules, "gridloom.llm.catalog", None)
        if "gridloom.llm" in sys.modules:
            m.delattr(sys.modules["gridloom.llm"], "catalog", raising=False)
        with pytest.raises(ImportError):
            importlib.reload(entry)
    importlib.reload(entry)
