"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest

from claimloom.plans import queries

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{PATH}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_equal_the_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, PATH)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want
