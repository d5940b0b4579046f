"""Price-sensitivity job: what prices did, and who left after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Layout, Settings
from ..functions.columns import numeric
from ..operators import price, segments
from ..session import durable


def explore(
    clients: DataFrame,
    prices: DataFrame,
    layout: Layout = Layout(),
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """Name -> result table.

    Elasticities need a quantity per month, which the customer and price files
    do not have; ``operators.price.elasticity`` works on any table that does.
    """
    columns, label = layout.price_columns, layout.label
    volatility = {c: f"{c}_volatility" for c in columns}
    levels = price.price_level(prices, layout)
    known = numeric(clients, [layout.seniority])
    moved = durable(
        clients.select(layout.id, label, *known).join(levels.select(layout.id, *volatility.values()), layout.id)
    )
    monthly = price.monthly_prices(prices, layout)
    tables = {
        "price_level": levels,
        "price_month_on_month": price.month_on_month(monthly, columns, layout),
        "rise_before_churn": price.rise_before(clients, prices, columns, settings.recent_months, layout),
        "churn_after_rise": price.rate_after_rises(clients, prices, columns, settings.recent_months, layout),
        "churn_by_volatility": segments.segment_rates(moved, volatility, label, means=known),
    }
    present = {d: c for d, c in layout.segment_columns.items() if c in clients.columns}
    if present:
        sized = durable(clients.select(layout.id, label, *dict.fromkeys(present.values())))
        tables["segment_rates"] = segments.segment_rates(sized, present, label)
        for dimension in present:
            thirds = segments.with_segments(sized, {dimension: present[dimension]})
            tables[f"price_change_by_{dimension}"] = _change_by(thirds, prices, dimension, layout)
    return tables


def _change_by(thirds: DataFrame, prices: DataFrame, dimension: str, layout: Layout) -> DataFrame:
    """Mean price change and label rate of the customers in each third, by whether the price rose."""
    changes = price.price_change(prices, layout)
    name = next(iter(layout.first_last_features.values()))
    rose = (F.col(name) > 0).cast("int").alias("rose")
    return (
        thirds.where(F.col(dimension).isNotNull())
        .join(changes.where(F.col(name).isNotNull()), layout.id)
        .groupBy(dimension, rose)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(name).alias("mean_change"),
            F.avg(layout.label).alias("label_rate"),
        )
    )
