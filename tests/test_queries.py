"""Every registered query that has SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pytest

from nearfield import queries, queries_more, queries_tables  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, (float, np.floating)):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([plain(y) for y in x])
    return str(x)


#: Long ones, whose parts tests/test_engine.py runs too.
LONG = {"saved_indexes", "saved_headers", "verify_sweep", "trained_books", "fleet_agreement", "rebuilt_life", "across_seeds", "kmeans_trained", "composite_life"}


@pytest.mark.parametrize("name", sorted((set(queries.SQL) | set(queries.FIXED)) - LONG))
def test_query_equals_sql(spark, duck, name):
    got = (queries.QUERIES | queries.FIXED)[name](spark, SF)
    want = duck.sql((queries.SQL | queries.FIXED_SQL)[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    b = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_keeps_its_invariants(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert rows
    if {"qid", "rank", "score"} <= set(rows[0].asDict()):
        by = {}
        for r in sorted(rows, key=lambda r: (r.qid, r["rank"])):
            by.setdefault(r.qid, []).append(r)
        for own in by.values():
            assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
            assert len({r.id for r in own}) == len(own)
            assert all(a.score <= b.score for a, b in zip(own, own[1:], strict=False))
