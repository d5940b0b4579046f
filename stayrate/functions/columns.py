"""Choosing columns, and arithmetic that does not depend on task order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [name for name in df.columns if name.startswith(prefix)]


def numeric(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    wanted = set(df.columns if names is None else names)
    return [
        f.name for f in df.schema.fields if f.name in wanted and isinstance(f.dataType, NumericType)
    ]


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    existing = set(df.columns)
    return [name for name in names if name in existing]


def name_matches(column: str | Column, pattern: str) -> Column:
    """Case-insensitive regular-expression test on a name column."""
    column = F.col(column) if isinstance(column, str) else column
    return column.rlike(f"(?i){pattern}")


def quoted(name: str) -> str:
    """A column name that stays one name even with dots or spaces in it."""
    return "`" + name.replace("`", "``") + "`"


def ratio(total: Column, count: Column) -> Column:
    """``total / count`` as a double; null where the count is 0."""
    return F.try_divide(total.cast("double"), count)


def mean(column: str | Column) -> Column:
    """Aggregate: mean of the non-null values.

    The sum of an integer or decimal column is exact, so the mean does not
    depend on the order in which tasks finish.
    """
    return ratio(F.sum(column), F.count(column))


def half_even(column: Column, digits: int) -> Column:
    """Round half to even; adding 0.0 turns a negative zero into zero."""
    return F.bround(column, digits) + F.lit(0.0)


def relative_difference_pct(new: Column, base: Column, digits: int = 2) -> Column:
    """``(new - base) / base`` in per cent; null for a base of 0."""
    return half_even(F.try_divide(new - base, base) * 100, digits)
