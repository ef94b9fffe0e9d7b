"""Every registered query against its SQL, on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, canonical
from workload import all_oracles, all_queries
from workload.streams import live_rows
from workload.views import WITH_EFFECTIVE

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())
    assert set(all_queries()) <= set(queries()) and set(all_oracles()) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_live_rows_of_every_source_equal_sql(spark, db):
    want = db.sql(f"""{WITH_EFFECTIVE} SELECT data_source, request_id FROM eff WHERE data_source IN
        ('session_log', 'codex_session', 'gemini_session', 'opencode_session', 'zcode_session')""").fetchall()
    got = [tuple(r) for r in live_rows(spark, SF).select("data_source", "request_id").collect()]
    assert sorted(got) == sorted(want) and len({s for s, _ in want}) == 5


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, db, name):
    df = all_queries()[name](spark, SF)
    want = db.sql(all_oracles()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got == canonical(want.fetchall(), want.columns)
