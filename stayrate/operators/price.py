"""Price-series features.

All of them start from one monthly aggregate that carries the sum and count of
each price. The first aggregation combines inside the scan tasks, so an entity
with a very large share of the rows reaches the shuffle as one row per date and
task. Everything per entity is then a second, much smaller aggregation; there
are no self-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Layout
from ..functions.columns import mean, ratio
from ..session import durable
from .ordered import quantiles


def _total(name: str) -> str:
    return f"{name}__total"


def _count(name: str) -> str:
    return f"{name}__count"


def _monthly_mean(name: str) -> Column:
    return ratio(F.col(_total(name)), F.col(_count(name)))


def monthly_totals(
    prices: DataFrame, layout: Layout = Layout(), columns: Sequence[str] | None = None
) -> DataFrame:
    """Sum and count of the non-null prices per entity and date."""
    columns = layout.price_columns if columns is None else columns
    keyed = prices.where(F.col(layout.id).isNotNull() & F.col(layout.price_date).isNotNull())
    return keyed.groupBy(layout.id, layout.price_date).agg(
        *[F.sum(c).alias(_total(c)) for c in columns],
        *[F.count(c).alias(_count(c)) for c in columns],
    )


def monthly_prices(
    prices: DataFrame, layout: Layout = Layout(), columns: Sequence[str] | None = None
) -> DataFrame:
    """Mean price per entity and date."""
    columns = layout.price_columns if columns is None else columns
    return monthly_totals(prices, layout, columns).select(
        layout.id, layout.price_date, *[_monthly_mean(c).alias(c) for c in columns]
    )


def _first(name: str, date: str) -> Column:
    """Value at the earliest date at which the value is known."""
    value = _monthly_mean(name)
    return F.min_by(value, F.when(value.isNotNull(), F.col(date)))


def _last(name: str, date: str) -> Column:
    value = _monthly_mean(name)
    return F.max_by(value, F.when(value.isNotNull(), F.col(date)))


def _overall_mean(name: str) -> Column:
    """Mean over all price rows (not over months)."""
    return ratio(F.sum(_total(name)), F.sum(_count(name)))


def _change(layout: Layout) -> list[Column]:
    return [
        (_last(c, layout.price_date) - _first(c, layout.price_date)).alias(feature)
        for c, feature in layout.first_last_features.items()
    ]


def _mean_spread(layout: Layout) -> list[Column]:
    return [
        (_overall_mean(a) - _overall_mean(b)).alias(f"{name}_mean_diff")
        for name, (a, b) in layout.spreads.items()
    ]


def _max_spread(layout: Layout) -> list[Column]:
    return [
        F.max(_monthly_mean(a) - _monthly_mean(b)).alias(f"{name}_max_monthly_diff")
        for name, (a, b) in layout.spreads.items()
    ]


def price_change(prices: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Last minus first known monthly mean of the off-peak prices, per entity."""
    columns = list(layout.first_last_features)
    return monthly_totals(prices, layout, columns).groupBy(layout.id).agg(*_change(layout))


def price_mean_spread(prices: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Difference of the mean prices of each pair of periods, per entity.

    Dates play no part here, so one aggregation is enough.
    """
    return (
        prices.where(F.col(layout.id).isNotNull())
        .groupBy(layout.id)
        .agg(
            *[
                (mean(a) - mean(b)).alias(f"{name}_mean_diff")
                for name, (a, b) in layout.spreads.items()
            ]
        )
    )


def price_max_spread(prices: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Largest signed monthly difference of each pair of periods, per entity."""
    return monthly_totals(prices, layout).groupBy(layout.id).agg(*_max_spread(layout))


def price_features(prices: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """All price features (change, mean spread, largest spread) in one pass."""
    return (
        monthly_totals(prices, layout)
        .groupBy(layout.id)
        .agg(*_change(layout), *_mean_spread(layout), *_max_spread(layout))
    )


def price_level(prices: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Mean price over all rows and deviation of the monthly means, per entity."""
    columns = layout.price_columns
    return (
        monthly_totals(prices, layout)
        .groupBy(layout.id)
        .agg(
            *[_overall_mean(c).alias(f"{c}_level") for c in columns],
            *[F.stddev_samp(_monthly_mean(c)).alias(f"{c}_volatility") for c in columns],
        )
    )


def month_on_month(
    monthly: DataFrame, columns: Sequence[str], layout: Layout = Layout()
) -> DataFrame:
    """Change of each monthly value against the entity's previous month with a value.

    The window holds one row per date, so its size does not grow with the
    number of raw rows of an entity.
    """
    earlier = (
        Window.partitionBy(layout.id)
        .orderBy(layout.price_date)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    previous = {c: F.last(c, ignorenulls=True).over(earlier) for c in columns}
    return monthly.select(
        layout.id,
        layout.price_date,
        *columns,
        *[(F.col(c) - p).alias(f"{c}_change") for c, p in previous.items()],
        *[F.try_divide(F.col(c) - p, p).alias(f"{c}_change_rel") for c, p in previous.items()],
    )


def rises(
    prices: DataFrame, columns: Sequence[str], months: int, layout: Layout = Layout()
) -> DataFrame:
    """Price rises per entity and price column: in its last months, and ever.

    "Last months" are the ``months`` calendar months up to the entity's last
    price date. All columns come from one pass.
    """
    changes = month_on_month(monthly_prices(prices, layout, columns), columns, layout)
    final = F.max(layout.price_date).over(Window.partitionBy(layout.id))
    recent = F.col(layout.price_date) > F.add_months("_final", -months)
    up = {c: F.col(f"{c}_change") > 0 for c in columns}
    found = (
        changes.withColumn("_final", final)
        .groupBy(layout.id)
        .agg(
            *[F.count_if(recent & up[c]).alias(f"{c}_recent") for c in columns],
            *[F.count_if(up[c]).alias(f"{c}_ever") for c in columns],
        )
    )
    rows = [
        F.struct(
            F.lit(c).alias("variable"), F.col(f"{c}_recent").alias("rises"), F.col(f"{c}_ever").alias("rises_ever")
        )
        for c in columns
    ]
    return found.select(layout.id, F.inline(F.array(*rows)))


def rise_before(
    entities: DataFrame,
    prices: DataFrame,
    columns: Sequence[str],
    months: int,
    layout: Layout = Layout(),
) -> DataFrame:
    """Share of retained and churned entities with a rise of each price in their last months."""
    return (
        entities.select(layout.id, layout.label)
        .join(rises(prices, columns, months, layout), layout.id)
        .groupBy("variable", layout.label)
        .agg(
            F.count(F.lit(1)).alias("n"),
            ratio(F.count_if(F.col("rises") > 0), F.count(F.lit(1))).alias("share_recent_rise"),
            ratio(F.sum("rises_ever"), F.count(F.lit(1))).alias("mean_rises"),
        )
    )


def rate_after_rises(
    entities: DataFrame,
    prices: DataFrame,
    columns: Sequence[str],
    months: int,
    layout: Layout = Layout(),
) -> DataFrame:
    """Label rate by the number of rises of each price in the entity's last months."""
    return (
        entities.select(layout.id, layout.label)
        .join(rises(prices, columns, months, layout), layout.id)
        .groupBy("variable", "rises")
        .agg(F.count(F.lit(1)).alias("n"), mean(layout.label).alias("label_rate"))
    )


def elasticity(
    monthly: DataFrame, price: str, quantity: str, layout: Layout = Layout()
) -> DataFrame:
    """Relative quantity change divided by relative price change, per entity and month.

    ``monthly`` holds one row per entity and date. Months without a previous
    value or without a price change have no elasticity.
    """
    changes = month_on_month(monthly, [price, quantity], layout)
    value = F.try_divide(F.col(f"{quantity}_change_rel"), F.col(f"{price}_change_rel"))
    return changes.select(layout.id, layout.price_date, value.alias("elasticity")).where(
        F.col("elasticity").isNotNull()
    )


def elasticity_by_segment(
    entities: DataFrame, elasticities: DataFrame, segment: str, layout: Layout = Layout()
) -> DataFrame:
    """Median elasticity and share of elastic months (|e| > 1) per segment.

    The joined rows are stored, because shares, cut points and quantiles all
    read them.
    """
    rows = durable(
        entities.select(layout.id, segment).join(elasticities, layout.id).select(segment, "elasticity")
    )
    medians = quantiles(rows, "elasticity", {"median_elasticity": 0.5}, [segment])
    shares = rows.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.count_if(F.abs("elasticity") > 1), F.count(F.lit(1))).alias("share_elastic"),
    )
    return shares.join(medians, segment)
