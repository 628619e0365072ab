"""The DuckDB SQL of the queries that have one, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from logarbor.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, str(DATA))
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in df.columns)} FROM ({ORACLE[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)
