"""Every catalog query runs; those with SQL give DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from weftline.plans import catalog, more  # noqa: F401 - its queries are in the catalog's tables

DIR = "/root/testdata/sf0.001"


def rows(df):
    def cell(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>", "None"):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.SQL:
        want = con.sql(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
