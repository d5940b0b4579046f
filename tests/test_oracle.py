"""Every registered query against its SQL in DuckDB, value for value."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from given_tables.catalog import QUERIES
from given_tables.oracle import ORACLE

FOLDER = "/root/testdata/sf0.01"
TABLES = ["nation", "customer", "orders", "lineitem", "documents", "labels"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def ordered(rows, names):
    places = [names.index(n) for n in sorted(names)]
    return sorted((tuple(row[i] for i in places) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert ordered(df.collect(), df.columns) == ordered(result.fetchall(), names)


#: Fits, whose values SQL cannot give; the second of each pair holds what SQL can say of the first.
FITS = {
    "rf_predictions": "rf_rows",
    "cv_auc": "cv_folds",
    "importance_top20": "importance_total",
    "price_share": "corr_price_share",
    "report_metrics": "corr_report_metrics",
    "grid_search": "grid_candidates",
    "model_compare": "model_classes",
    "permutation_importance": "permutation_base",
}


def test_every_query_or_what_holds_of_it_is_checked_by_sql():
    assert {FITS.get(name, name) for name in QUERIES} <= set(ORACLE)
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 6
