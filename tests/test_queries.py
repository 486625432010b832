"""Every registered query against its SQL on the smallest tables; queries without SQL must run and give rows."""

import glob
import os

import duckdb
import pytest
from check import rows

from suite import REGISTRY


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, data, name):
    entry = REGISTRY[name]
    df = entry.run(spark, data)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if entry.sql is None:
        assert got
        return
    cur = con.execute(entry.sql)
    want_names, want = rows([d[0] for d in cur.description], cur.fetchall())
    assert names == want_names
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
