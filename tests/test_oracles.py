"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from foliant.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _rows(df, columns):
    return sorted((tuple(None if x is None or x != x else x for x in r) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, con, name):
    want, got = con.execute(Q.ORACLE[name]).df(), Q.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(want.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 50 and all(r.status == "ok" and r.markdown and "<script" not in r.markdown for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
