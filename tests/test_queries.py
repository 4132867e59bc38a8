"""Every query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from cubeline import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in os.listdir(DIR):
        con.execute(f"create view {n[:-8]} as select * from '{DIR}/{n}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else repr(v) if isinstance(v, float) else str(v))
    return sorted(map(tuple, df.values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    a, b = queries.QUERIES[name](spark, DIR).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry_without_optional_part(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        e = importlib.reload(e)
        assert set(e.queries()) == set(queries.QUERIES) == set(e.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(e)
