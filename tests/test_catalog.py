"""Every catalogued query against DuckDB on the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from girder.plans import catalog

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/{t}.parquet')")
    return con


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "tolist"):
        return shown(v.tolist())
    return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(shown(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else shown(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, ROOT).toPandas()
    if name not in catalog.SQL:
        assert len(got)
        return
    want = con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
