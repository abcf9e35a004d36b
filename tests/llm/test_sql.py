"""Registered queries of this subpackage give the rows of their SQL."""

import glob
import os

import duckdb
import pytest

from nearfield.llm import queries

SF = "/root/testdata/sf0.001"


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert a == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_lists_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
