from __future__ import annotations

import duckdb
import pytest

from meterwise.llm import queries as registered
from meterwise.llm.oracle import oracle_sql

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registered.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
