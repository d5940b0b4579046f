"""Segment questions: size classes, bills, discounts and at-risk lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.columns import mean, ratio
from .ordered import as_rows, column_quantiles

THIRDS = ("low", "middle", "high")


def segment_rates(
    df: DataFrame,
    dimensions: Mapping[str, str],
    label: str,
    names: tuple[str, str, str] = THIRDS,
    means: Sequence[str] = (),
) -> DataFrame:
    """Label rate of the low, middle and high third of each dimension's column.

    The columns are cut at their exact terciles; all dimensions are handled in
    one pass. ``means`` names columns whose mean per segment is wanted as well.
    ``df`` is read three times, so pass a stored table.
    """
    columns = list(dimensions.values())
    cuts = column_quantiles(df, columns, {"low": 1 / 3, "high": 2 / 3})
    titles = F.create_map(*[F.lit(x) for title, c in dimensions.items() for x in (c, title)])
    segment = (
        F.when(F.col("value") <= F.col("low"), names[0])
        .when(F.col("value") <= F.col("high"), names[1])
        .otherwise(names[2])
    )
    # cuts has one row per named column, a list the caller wrote.
    return (
        as_rows(df, columns, [label, *means])
        .join(F.broadcast(cuts), "variable")
        .groupBy(F.element_at(titles, F.col("variable")).alias("dimension"), segment.alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            mean(label).alias("label_rate"),
            *[mean(c).alias(f"mean_{c}") for c in means],
        )
    )


def with_segments(
    df: DataFrame, dimensions: Mapping[str, str], names: tuple[str, str, str] = THIRDS
) -> DataFrame:
    """Add a column per dimension that names the third in which the row's value lies.

    A null value is in no third. ``df`` is read three times, so pass a stored table.
    """
    columns = list(dict.fromkeys(dimensions.values()))
    found = column_quantiles(df, columns, {"low": 1 / 3, "high": 2 / 3})
    # One row with the cuts of the named columns.
    cuts = found.agg(
        F.struct(
            *[
                F.max(F.when(F.col("variable") == c, F.col(cut))).alias(f"{cut}{i}")
                for i, c in enumerate(columns)
                for cut in ("low", "high")
            ]
        )
    ).scalar()
    added = {}
    for title, c in dimensions.items():
        value, at = F.col(c).cast("double"), columns.index(c)
        added[title] = (
            F.when(value <= cuts.getField(f"low{at}"), names[0])
            .when(value <= cuts.getField(f"high{at}"), names[1])
            .when(value.isNotNull(), names[2])
        )
    return df.withColumns(added)


def bill_burden(
    entities: DataFrame, bills: DataFrame, id: str, label: str, amount: str
) -> DataFrame:
    """Mean monthly bill of retained and churned entities.

    ``bills`` has one row per entity and month.
    """
    per_entity = bills.groupBy(id).agg(F.sum(amount).alias("total"), F.count(amount).alias("months"))
    # A class total of whole units may not fit 64 bits.
    whole = isinstance(per_entity.schema["total"].dataType, LongType)
    total = F.col("total").cast("decimal(28,0)") if whole else F.col("total")
    return (
        entities.select(id, label)
        .join(per_entity, id)
        .groupBy(label)
        .agg(
            F.count(F.lit(1)).alias("n"),
            ratio(F.sum(total), F.sum("months")).alias("mean_monthly_bill"),
        )
    )


def rate_by_condition(df: DataFrame, condition: Column, label: str, name: str) -> DataFrame:
    """Label rate of the rows that fulfil a condition and of those that do not."""
    return (
        df.groupBy(condition.cast("int").alias(name))
        .agg(F.count(F.lit(1)).alias("n"), mean(label).alias("label_rate"))
        .where(F.col(name).isNotNull())
    )


def declining(last_month: str, last_year: str, share: float) -> Column:
    """True if last month's use is below ``share`` of the monthly mean of the year."""
    monthly = F.col(last_year).cast("double") / 12
    return F.coalesce(F.col(last_month).cast("double"), F.lit(0.0)) < monthly * share


def at_risk(
    df: DataFrame,
    id: str,
    margin: str,
    tenure: str,
    last_month: str,
    last_year: str,
    share: float = 0.5,
) -> DataFrame:
    """Entities with a margin in the top quarter and a tenure up to the median.

    ``declining`` flags those whose use has fallen. The cut points are exact.
    ``df`` is read three times, so pass a stored table.
    """
    found = column_quantiles(df, [margin, tenure], {"median": 0.5, "upper": 0.75})
    cuts = found.agg(
        F.struct(
            F.max(F.when(F.col("variable") == margin, F.col("upper"))).alias("margin"),
            F.max(F.when(F.col("variable") == tenure, F.col("median"))).alias("tenure"),
        )
    ).scalar()
    high, short = cuts.getField("margin"), cuts.getField("tenure")
    flag = F.coalesce(declining(last_month, last_year, share), F.lit(False)).cast("int")
    return df.where((F.col(margin).cast("double") >= high) & (F.col(tenure) <= short)).select(
        id, F.col(margin).cast("double").alias(margin), tenure, flag.alias("declining")
    )
