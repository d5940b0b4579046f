"""Report: one table of figures, and a page of text made from it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Layout, Settings
from ..functions.columns import name_matches, quoted
from ..operators.evaluate import binary_metrics, roc_auc
from ..operators.model import SCORE, fold_summary, top_importances


def price_share(importance: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: price features among the top features, and their weight.

    ``price_importance`` is the share of all importance that price features
    hold; ``price_first`` says whether the strongest feature is one of them.
    """
    is_price = name_matches("feature", settings.price_feature_pattern)
    top = top_importances(importance, settings.top_features)
    in_top = top.agg(
        F.struct(
            F.count_if(is_price).alias("n"),
            F.sum(F.when(is_price, F.col("importance"))).alias("weight"),
            F.sum("importance").alias("all"),
            # Of equally strong features the first by name, as in the list of the strongest.
            F.min_by(is_price.cast("int"), F.struct(-F.col("importance"), F.col("feature"))).alias("first"),
        )
    ).scalar()
    return importance.agg(
        F.coalesce(F.sum(F.when(is_price, F.col("importance"))), F.lit(0.0)).alias("price_importance")
    ).select(
        "price_importance",
        in_top.getField("n").alias("price_in_top"),
        F.coalesce(F.try_divide(in_top.getField("weight"), in_top.getField("all")), F.lit(0.0)).alias(
            "price_share_of_top"
        ),
        in_top.getField("first").alias("price_first"),
    )


def _as_metrics(row: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """A one-row table to (metric, value) rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value"))
            for c, metric in names.items()
        ]
    )
    return row.select(F.inline(pairs))


def report_metrics(
    scored: DataFrame,
    per_fold: DataFrame,
    importance: DataFrame,
    layout: Layout = Layout(),
    settings: Settings = Settings(),
) -> DataFrame:
    """All figures of the report as (metric, value) rows."""
    measured = binary_metrics(scored, layout.label, "prediction")
    names = ["accuracy", "precision", "recall", "f1"]
    parts = [
        _as_metrics(measured, {n: n for n in names}),
        _as_metrics(roc_auc(scored, layout.label, SCORE), {"auc": "roc_auc"}),
        _as_metrics(
            fold_summary(per_fold), {"auc_mean": "cv_roc_auc_mean", "auc_std": "cv_roc_auc_std"}
        ),
        _as_metrics(
            price_share(importance, settings),
            {
                "price_importance": "price_importance",
                "price_in_top": "price_features_in_top",
                "price_share_of_top": "price_share_of_top",
                "price_first": "price_feature_is_first",
            },
        ),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def rate_lines(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, category, n, line): every row of the rate tables, as the report prints it."""
    parts = []
    for name, table in tables.items():
        category = F.coalesce(F.col(quoted(table.columns[0])).cast("string"), F.lit("None"))
        line = F.format_string("  %s: %.1f%% of %,d", category, F.round(F.col("label_rate") * 100, 1), F.col("n"))
        parts.append(table.select(F.lit(name).alias("table"), category.alias("category"), "n", "label_rate", line.alias("line")))
    return reduce(DataFrame.unionByName, parts).select("table", "category", "n", "line")


def render(
    metrics: DataFrame,
    importance: DataFrame,
    eda: Mapping[str, DataFrame] | None = None,
    settings: Settings = Settings(),
) -> str:
    """The report page. Every statement follows from the tables, which come row by row and whole."""
    value = {r["metric"]: r["value"] for r in metrics.collect()}
    top = top_importances(importance, settings.report_features).collect()
    price_led = value["price_feature_is_first"] == 1 or value["price_importance"] > 0.5
    answer = (
        "Yes: price features carry most of the model's weight."
        if price_led
        else "No: price features contribute, but other features weigh more."
    )
    lines = [
        "CHURN REPORT",
        "",
        "Is churn primarily driven by price sensitivity?",
        f"  {answer}",
        f"  Share of importance held by price features: {value['price_importance']:.1%}",
        f"  Price features among the top {settings.top_features}: "
        f"{value['price_features_in_top']:.0f}",
        "",
        f"Model: random forest, {settings.trees} trees, balanced class weights",
        f"  Accuracy    {value['accuracy']:.2%}",
        f"  Precision   {value['precision']:.2%}",
        f"  Recall      {value['recall']:.2%}",
        f"  F1          {value['f1']:.2%}",
        f"  ROC-AUC     {_number(value['roc_auc'])}",
        f"  CV ROC-AUC  {_number(value['cv_roc_auc_mean'])} +/- {_number(value['cv_roc_auc_std'])}",
        "",
        "Strongest features",
        *[f"  {i}. {r['feature']} ({r['importance']:.4f})" for i, r in enumerate(top, 1)],
    ]
    for name, table in (eda or {}).items():
        lines += ["", f"Churn rate: {name}"]
        lines += [row["line"] for row in rate_lines({name: table}).toLocalIterator()]
    return "\n".join(lines) + "\n"


def _number(value: float | None) -> str:
    return "n/a" if value is None else f"{value:.4f}"
