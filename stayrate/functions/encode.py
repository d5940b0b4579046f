"""Row-wise feature transforms."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenure_years(start: str | Column, end: str | Column) -> Column:
    """Whole years of 365 days from start to end, rounded down (also below 0)."""
    return F.floor(F.datediff(end, start) / 365).cast("int")


def whole_months_until(reference: date, column: str | Column) -> Column:
    """Completed calendar months from ``column`` to the reference date.

    Counted on year, month and day, because ``months_between`` treats two
    month ends as a whole month apart.
    """
    years = F.lit(reference.year) - F.year(column)
    months = F.lit(reference.month) - F.month(column)
    unfinished = (F.lit(reference.day) < F.dayofmonth(column)).cast("int")
    return (years * 12 + months - unfinished).cast("int")


def flag(column: str) -> Column:
    """'t' and 'f' to 1 and 0. Null stays null, a number passes, else an error."""
    value = F.col(column).cast("string")
    return F.when(value == "t", 1).when(value == "f", 0).otherwise(value.cast("int"))


def log10p1(column: str | Column) -> Column:
    """``log10(x + 1)``; null where it is undefined (x <= -1)."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(x > -1, F.log10(x + 1))
