"""Every registered query of the graph engine beside its DuckDB statement."""

import os

import duckdb
import pytest

from graphloom.plans import extra, kept, live, more, queries as Q, store  # noqa: F401  they register their queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def plain(rows, columns):
    def value(v):
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, oracle, name):
    frame = Q.QUERIES[name](spark, SF_DIR)
    got = frame.collect()
    if name not in Q.ORACLE:
        assert frame.columns
        return
    result = oracle.execute(Q.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert plain(got, frame.columns) == plain(result.fetchall(), columns)


def test_every_statement_has_a_query():
    assert set(Q.ORACLE) <= set(Q.QUERIES) and len(Q.ORACLE) > 80
