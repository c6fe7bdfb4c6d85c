"""The queries that SQL can express, on the smallest tables; and that all are registered."""

import os

import duckdb
import pytest
from cytosift.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = set(entry.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert set(want.columns) == set(got.columns)
    cols = sorted(want.columns)
    rows = con.sql(f"SELECT {', '.join(cols)} FROM want").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, rows))
