"""Exploration job: the tables behind the overview and the plots."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Layout, Settings
from ..functions.columns import present
from ..operators import distribution, profile


def explore(
    clients: DataFrame,
    prices: DataFrame,
    layout: Layout = Layout(),
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """Name -> result table. Nothing runs until a table is written or shown."""
    label = layout.label
    tables = {
        "overview": profile.overview(clients, "client", label).unionByName(
            profile.overview(prices, "price")
        ),
        "column_gaps": profile.column_gaps(clients),
        "class_share": profile.class_share(clients, label),
        "price_by_label": profile.price_by_label(
            clients, prices, layout.id, label, layout.price_prefix
        ),
        "histograms": distribution.histogram(
            clients, present(clients, layout.histogram_columns), label, settings.histogram_bins
        ),
        "group_means": profile.group_means(clients, label, present(clients, layout.mean_columns)),
    }
    for column in present(clients, layout.category_columns):
        tables[f"rate_by_{column}"] = profile.rate_by_descending(clients, column, label)
    for column in present(clients, layout.flag_columns):
        tables[f"rate_by_{column}"] = profile.rate_by(clients, column, label)
    return tables
