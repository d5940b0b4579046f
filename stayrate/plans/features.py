"""Feature job: customer table and price series to one numeric table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..config import Layout, Settings
from ..functions.columns import present, quoted, with_prefix
from ..functions.encode import flag, log10p1, tenure_years, whole_months_until
from ..operators.distribution import auto_bins, density, histogram
from ..operators.encode import category_lists, frequent_categories, one_hot_wide
from ..operators.price import price_features
from ..operators.profile import rate_by, rate_by_descending
from ..session import durable


def date_features(
    df: DataFrame, layout: Layout = Layout(), settings: Settings = Settings()
) -> DataFrame:
    """Tenure in years and months to the reference date; the dates are dropped."""
    features = {layout.tenure: tenure_years("date_activ", "date_end")}
    for name, (column, sign) in layout.month_features.items():
        features[name] = whole_months_until(settings.reference_date, column) * sign
    return df.withColumns(features).drop(*layout.date_columns)


def flag_features(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    return df.withColumns({c: flag(c) for c in present(df, layout.flag_columns)})


def log_features(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    return df.withColumns({c: log10p1(c) for c in present(df, layout.log_columns)})


def _doubles(df: DataFrame) -> DataFrame:
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)]
    return df.withColumns({c: F.col(quoted(c)).cast("double") for c in decimals})


def build_features(
    clients: DataFrame,
    prices: DataFrame,
    layout: Layout = Layout(),
    settings: Settings = Settings(),
    stage: Callable[[DataFrame], DataFrame] = durable,
) -> DataFrame:
    """The feature table, one row per customer with at least one price row.

    ``stage`` writes the joined table once: the list of frequent categories and
    the final projection both read it, and categories are counted after the
    join has dropped customers without prices. With more frequent categories than
    ``max_categories`` (or where the settings say so) their columns stay text, one
    value a row; the model job makes sparse vectors of them.
    """
    joined = stage(clients.join(price_features(prices, layout), layout.id))
    encoded = flag_features(date_features(joined, layout, settings), layout)
    columns = present(joined, layout.category_columns)
    categories = _wide(joined, columns, settings)
    if categories is not None:
        encoded = one_hot_wide(encoded, categories)
    return _doubles(log_features(encoded, layout).drop(*layout.redundant_columns))


def _wide(joined: DataFrame, columns: list[str], settings: Settings) -> dict[str, list[str]] | None:
    """The categories that become columns; none where the settings, or their number, forbid that."""
    if settings.wide_categories is False:
        return None
    try:
        return category_lists(joined, columns, settings.min_category_count, settings.max_categories)
    except ValueError:
        if settings.wide_categories:
            raise
        return None


def descriptions(
    features: DataFrame,
    layout: Layout = Layout(),
    settings: Settings = Settings(),
    rows: int | None = None,
) -> dict[str, DataFrame]:
    """Name -> table that describes a stored feature table of ``rows`` rows (counted if not known)."""
    logs = present(features, layout.density_columns)
    flags = present(features, layout.flag_columns)
    tables = {
        "feature_summary": feature_summary(features, layout, settings, rows),
        "rate_by_tenure": rate_by_descending(
            features, layout.tenure, layout.label, top=settings.top_tenures
        ),
        **{f"rate_by_{c}": rate_by(features, c, layout.label) for c in flags},
    }
    if logs:
        tables["histogram_log"] = histogram(features, logs, bins=settings.log_bins)
        tables["bins_log"] = auto_bins(features, logs)
        tables["density_log"] = density(features, logs)
    return tables


def feature_summary(
    features: DataFrame,
    layout: Layout = Layout(),
    settings: Settings = Settings(),
    rows: int | None = None,
) -> DataFrame:
    """One row: rows, columns and how many features each step has added.

    Frequent categories of columns that are still text count as the dummies they become.
    With ``rows`` known from the write, nothing is scanned for the rest.
    """
    price_names = [
        *layout.first_last_features.values(),
        *[f"{s}_mean_diff" for s in layout.spreads],
        *[f"{s}_max_monthly_diff" for s in layout.spreads],
    ]
    dummies = [c for p in layout.category_columns for c in with_prefix(features, f"{p}_")]
    texts = present(features, layout.category_columns)
    more = frequent_categories(features, texts, settings.min_category_count).count() if texts else 0
    counts = {
        "n_columns": len(features.columns),
        "n_price_features": len(present(features, price_names)),
        "n_month_features": len(present(features, layout.month_features)),
        "n_log_features": len(present(features, layout.log_columns)),
        "n_dummies": len(dummies) + more,
    }
    numbers = [F.lit(n).cast("bigint").alias(name) for name, n in counts.items()]
    if rows is not None:
        one = features.sparkSession.range(1)
        return one.select(F.lit(rows).cast("bigint").alias("n_rows"), *numbers)
    return features.agg(F.count(F.lit(1)).alias("n_rows"), *numbers)
