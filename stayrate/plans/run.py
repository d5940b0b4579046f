"""The whole analysis from input files to report, or one stage of it.

    spark-submit -m stayrate.plans.run --data DIR --out DIR [--stage STAGE]

DIR holds client_data, price_data and clean_data_after_eda, each as .csv or
.parquet. Stages hand over through files, so each can be repeated alone.
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..config import Layout, Settings
from ..operators.evaluate import retention_list
from ..operators.model import SCORE, fold_summary, top_importances
from ..session import build_session, durable, tables_removed
from ..sinks.files import (
    prediction_table,
    write_counted,
    write_features,
    write_predictions,
    write_report,
)
from ..sources import files
from . import eda, features, modelling, report, sensitivity

# The names of the input and output files.
CLIENTS = "client_data"
PRICES = "price_data"
CLEAN = "clean_data_after_eda"
FEATURES = "data_for_predictions"
PREDICTIONS = "out_of_sample_predictions"
SUMMARY = "churn_report"


def _read(spark: SparkSession, folder: str, name: str, schema: StructType, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return files.read_parquet(spark, f"{folder}/{name}.parquet")
    return files.read_csv(spark, f"{folder}/{name}.csv", schema)


def read_clients(
    spark: SparkSession, folder: str, name: str, layout: Layout, fmt: str = "csv"
) -> DataFrame:
    found = _read(spark, folder, name, files.client_schema(layout), fmt)
    found = files.parse_dates(files.drop_artefact(found, layout), list(layout.date_columns))
    return files.require_ids(found, layout)


def read_prices(spark: SparkSession, folder: str, layout: Layout, fmt: str = "csv") -> DataFrame:
    found = _read(spark, folder, PRICES, files.price_schema(layout), fmt)
    dated = files.parse_dates(files.drop_artefact(found, layout), [layout.price_date], strict=True)
    return files.require_ids(dated, layout)


def run_eda(
    spark: SparkSession, data: str, out: str, layout: Layout, settings: Settings, fmt: str = "csv"
) -> dict[str, DataFrame]:
    clients = read_clients(spark, data, CLIENTS, layout, fmt)
    tables = eda.explore(clients, read_prices(spark, data, layout, fmt), layout, settings)
    return {
        name: write_features(table, f"{out}/eda/{name}") for name, table in tables.items()
    }


def run_sensitivity(
    spark: SparkSession, data: str, out: str, layout: Layout, settings: Settings, fmt: str = "csv"
) -> dict[str, DataFrame]:
    clients = read_clients(spark, data, CLIENTS, layout, fmt)
    tables = sensitivity.explore(clients, read_prices(spark, data, layout, fmt), layout, settings)
    return {
        name: write_features(table, f"{out}/sensitivity/{name}") for name, table in tables.items()
    }


def run_features(
    spark: SparkSession, data: str, out: str, layout: Layout, settings: Settings, fmt: str = "csv"
) -> DataFrame:
    """Write the feature table, and beside it what describes it."""
    clients = read_clients(spark, data, CLEAN, layout, fmt)
    built = features.build_features(clients, read_prices(spark, data, layout, fmt), layout, settings)
    written = write_counted(built, f"{out}/{FEATURES}")
    tables = features.descriptions(written.table, layout, settings, written.rows)
    for name, table in {**tables, "column_gaps": written.gaps()}.items():
        write_features(table, f"{out}/features/{name}")
    return written.table


def run_model(
    spark: SparkSession, out: str, layout: Layout, settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Fit, write predictions and evaluation tables; returns (metrics, importance)."""
    table = files.read_parquet(spark, f"{out}/{FEATURES}")
    parts = modelling.prepare(table, layout, settings)
    fitted = modelling.fit_and_score(parts, layout, settings)
    per_fold = durable(modelling.cross_validation(parts, layout, settings))
    predictions = prediction_table(fitted.scored, layout.label, parts.columns, layout.id)
    write_predictions(predictions, f"{out}/{PREDICTIONS}")
    tables = modelling.evaluation_tables(fitted.scored, layout, settings)
    tables |= {
        "cross_validation": per_fold,
        "cross_validation_summary": fold_summary(per_fold),
        "feature_importance": fitted.importance,
        "top_features": top_importances(fitted.importance, settings.top_features),
        "retention_list": retention_list(fitted.scored, layout.id, SCORE, settings.retention_rows),
    }
    for name, result in tables.items():
        write_features(result, f"{out}/model/{name}")
    metrics = report.report_metrics(fitted.scored, per_fold, fitted.importance, layout, settings)
    return write_features(metrics, f"{out}/model/report_metrics"), fitted.importance


def run_all(
    spark: SparkSession,
    data: str,
    out: str,
    layout: Layout = Layout(),
    settings: Settings = Settings(),
    fmt: str = "csv",
) -> str:
    """All stages; returns the text of the report. What was stored on the way is removed at the end."""
    with tables_removed(spark):
        explored = run_eda(spark, data, out, layout, settings, fmt)
        run_sensitivity(spark, data, out, layout, settings, fmt)
        run_features(spark, data, out, layout, settings, fmt)
        metrics, importance = run_model(spark, out, layout, settings)
        rates = {name: table for name, table in explored.items() if name.startswith("rate_by_")}
        text = report.render(metrics, importance, rates, settings)
        write_report(spark, text, f"{out}/{SUMMARY}")
    return text


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--data", required=True, help="folder with the input files")
    parser.add_argument("--out", required=True, help="folder for results; shared on a cluster")
    parser.add_argument("--stage", choices=["all", "eda", "sensitivity", "features", "model"], default="all")
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--trees", type=int, default=Settings.trees)
    parser.add_argument("--max-depth", type=int, default=Settings.max_depth)
    parser.add_argument("--min-category-count", type=int, default=Settings.min_category_count)
    parser.add_argument("--reference-date", type=date.fromisoformat, default=Settings.reference_date)
    parser.add_argument("--test-share", type=float, default=Settings.test_share)
    parser.add_argument("--folds", type=int, default=Settings.folds)
    parser.add_argument("--thresholds", type=float, nargs="+", default=Settings.thresholds)
    parser.add_argument("--retention-rows", type=int, default=Settings.retention_rows)
    parser.add_argument("--recent-months", type=int, default=Settings.recent_months)
    parser.add_argument("--least-node-weight", type=float, default=Settings.least_node_weight)
    given = parser.parse_args(arguments)

    layout = Layout()
    settings = replace(
        Settings(),
        trees=given.trees,
        max_depth=given.max_depth,
        min_category_count=given.min_category_count,
        reference_date=given.reference_date,
        test_share=given.test_share,
        folds=given.folds,
        thresholds=tuple(given.thresholds),
        retention_rows=given.retention_rows,
        recent_months=given.recent_months,
        least_node_weight=given.least_node_weight,
    )
    spark = build_session("stayrate")
    if given.stage == "all":
        print(run_all(spark, given.data, given.out, layout, settings, given.format))
    elif given.stage == "sensitivity":
        for name in run_sensitivity(spark, given.data, given.out, layout, settings, given.format):
            print(f"{given.out}/sensitivity/{name}")
    elif given.stage == "eda":
        for name, table in run_eda(
            spark, given.data, given.out, layout, settings, given.format
        ).items():
            print(name)
            for row in table.toLocalIterator():
                print("  " + "  ".join(map(str, row)))
    elif given.stage == "features":
        run_features(spark, given.data, given.out, layout, settings, given.format)
    else:
        run_model(spark, given.out, layout, settings)


if __name__ == "__main__":
    main()
