"""The base columns of op4, op6, op8 and op9 over whole tables, held against SQL."""

from __future__ import annotations

import duckdb
import pytest

from claimloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["secret_scans_base", "quality_rules_base", "license_scans_base", "media_columns_base"])
def test_base_columns_equal_the_sql(spark, path, name):
    rows = QUERIES[name](spark, path)
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(rows.columns)
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r)) for r in rows.select(names).collect()) == want
    assert want
