from __future__ import annotations

import duckdb
import pytest

from stayrate.llm.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as connection:
        for table in ("documents", "benchmark", "embeddings"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        result = connection.execute(ORACLE[name])
        names = [d[0] for d in result.description]
        expected = sorted(result.fetchall())
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == expected


def test_each_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
