"""Overview queries: shape, gaps, label rates and group comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.columns import mean, numeric, quoted, ratio, relative_difference_pct, with_prefix


def column_gaps(df: DataFrame) -> DataFrame:
    """One row per column with its null count and the row count; one scan."""
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"))
            for i, c in enumerate(names)
        ]
    )
    return counted.select("rows", F.inline(pairs))


def overview(df: DataFrame, name: str, label: str | None = None) -> DataFrame:
    """One row: table name, rows, columns, null cells and the label rate."""
    nulls = sum((F.count_if(F.col(quoted(c)).isNull()) for c in df.columns), F.lit(0))
    rate = mean(label) if label else F.lit(None).cast("double")
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        nulls.cast("bigint").alias("null_cells"),
        rate.alias("label_rate"),
    )


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Rows and per cent of each class, in class order."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # The window runs over one row per class, not over the input rows.
    whole = F.sum("n").over(Window.partitionBy())
    return counts.select(label, "n", (ratio(F.col("n"), whole) * 100).alias("pct")).orderBy(label)


def _as_rows(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(label, variable, value) rows from one row per label value."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("value")) for i, c in enumerate(columns)]
    )
    return df.select(label, F.inline(pairs))


def _side_by_side(long: DataFrame, label: str) -> DataFrame:
    """Rows are variables, columns the means of the two classes."""

    def side(value: int) -> Column:
        return F.max(F.when(F.col(label) == value, F.col("value")))

    return long.groupBy("variable").agg(side(0).alias("retained"), side(1).alias("churned"))


def group_means(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each column for retained and churned entities."""
    rows = df.where(F.col(label).isNotNull())
    means = rows.groupBy(label).agg(*[mean(F.col(quoted(c))).alias(f"m{i}") for i, c in enumerate(columns)])
    return _side_by_side(_as_rows(means, label, columns), label).orderBy("variable")


def price_by_label(
    entities: DataFrame, series: DataFrame, id: str, label: str, prefix: str
) -> DataFrame:
    """Mean price of retained and churned entities over all their price rows.

    The series is reduced to sums and counts per entity before the join, so the
    join is one row to one row and an entity with very many price rows does not
    slow it down. Totals divided by counts weight every price row alike. Whole
    numbers are added up as decimals in the end, for a class total can exceed
    64 bits where no entity's total does.
    """
    columns = numeric(series, with_prefix(series, prefix))
    partial = series.groupBy(id).agg(
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    joined = entities.select(id, label).where(F.col(label).isNotNull()).join(partial, id)
    totals = [
        F.col(f"s{i}").cast("decimal(28,0)")
        if isinstance(partial.schema[f"s{i}"].dataType, LongType)
        else F.col(f"s{i}")
        for i in range(len(columns))
    ]
    means = joined.groupBy(label).agg(
        *[ratio(F.sum(s), F.sum(f"n{i}")).alias(f"m{i}") for i, s in enumerate(totals)]
    )
    wide = _side_by_side(_as_rows(means, label, columns), label)
    return wide.withColumn(
        "diff_pct", relative_difference_pct(F.col("churned"), F.col("retained"))
    ).orderBy("variable")


def rate_by(df: DataFrame, column: str, label: str) -> DataFrame:
    """Label rate and size of each value of a column; null values are left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"), mean(label).alias("label_rate"))
    )


def rate_by_descending(df: DataFrame, column: str, label: str, top: int | None = None) -> DataFrame:
    """``rate_by`` with the highest rates first, optionally the top few only."""
    ordered = rate_by(df, column, label).orderBy(F.desc("label_rate"), F.asc(column))
    return ordered.limit(top) if top else ordered
