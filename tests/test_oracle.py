"""Every registered query against its DuckDB SQL over the whole test tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import rows

import __spark_entry__ as contract
from unitlens.catalog import QUERIES as OWN

FOLDER = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem"]
DUCKDB_TYPE = {
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def in_order(records):
    return sorted(records, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql():
    assert OWN.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(OWN))
def test_matches_duckdb(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    expected = duck.execute(contract.oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in expected.description}
    assert {c: DUCKDB_TYPE[t] for c, t in df.dtypes} == types
    position = [list(types).index(c) for c in df.columns]
    wanted = [tuple(r[i] for i in position) for r in expected.fetchall()]
    assert in_order(rows(df)) == in_order(wanted)
    assert wanted


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 3


def test_session_zone_and_ansi_do_not_matter(spark, conf):
    names = ["ltv_by_channel", "ads_overview", "monthly_cac_by_channel", "date_coverage"]
    usual = {n: rows(contract.queries()[n](spark, FOLDER)) for n in names}
    with conf(
        spark__sql__session__timeZone="America/New_York",
        spark__sql__ansi__enabled="false",
        spark__sql__adaptive__enabled="false",
        spark__sql__autoBroadcastJoinThreshold="-1",
    ):
        for name in names:
            assert rows(contract.queries()[name](spark, FOLDER)) == usual[name]
