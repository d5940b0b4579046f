"""Small helpers for comparing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_key(df: DataFrame, *keys: str) -> dict:
    """Rows as {key: row}; a single key is not wrapped in a tuple."""
    found = {}
    for row in df.collect():
        key = row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys)
        assert key not in found, f"duplicate key {key}"
        found[key] = row
    return found


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
