"""Every catalogue query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from shelfmark.plans import assembly, catalogue, edits, imports, legacy, library, planner, retrieval  # noqa: F401  the others add their queries to catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    found = con.execute(catalogue.SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert plain(got) == plain(tuple(r[i] for i in order) for r in found.fetchall())
