"""The llm queries that SQL can express, against their SQL on the smallest driver tables."""

import duckdb
import pytest

from check import TABLES, canonical
from tokentide.llm.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)
