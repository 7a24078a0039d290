"""Registered queries against their DuckDB SQL over whole test tables."""

from __future__ import annotations

import duckdb
import pytest

from unitlens.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "boolean": "BOOLEAN", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    df = QUERIES[name](spark, FOLDER)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    wanted = con.execute(ORACLE[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == {c[0]: str(c[1]) for c in wanted.description}
    names = [c[0] for c in wanted.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(wanted.fetchall())
