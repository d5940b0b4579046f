"""Fits on the given tables, checked by properties."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from given_tables import catalog
from given_tables.views import LAYOUT
from stayrate.operators import model
from stayrate.plans import modelling, report
from stayrate.sinks.files import prediction_table
from tests.helpers import by_key

SETTINGS = replace(catalog.SETTINGS, trees=8, max_depth=4, folds=3, min_category_count=20)


@pytest.fixture(scope="module")
def planted(spark):
    """Customers whose label follows one feature, so that a fit has something to find."""
    rows = spark.range(600).select(
        F.col("id"),
        F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("signal"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("double").alias("price_noise"),
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)).cast("double")).alias("gaps"),
    )
    return rows.withColumn("churn", (F.col("signal") > 80).cast("int"))


@pytest.fixture(scope="module")
def parts(planted):
    return modelling.prepare(planted, LAYOUT, SETTINGS)


@pytest.fixture(scope="module")
def fitted(parts):
    return modelling.fit_and_score(parts, LAYOUT, SETTINGS)


def test_prepare_splits_and_names_the_features(parts):
    assert parts.features == ["signal", "price_noise", "gaps"]
    train, test = (set(r["id"] for r in df.select("id").collect()) for df in (parts.train, parts.test))
    assert not train & test and len(train | test) == 600


def test_scores_are_probabilities_and_find_the_signal(fitted):
    row = fitted.scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= row[0] <= row[1] <= 1
    assert set(fitted.scored.columns) >= {"id", "churn", "prediction", "score"}
    assert modelling.evaluation_tables(fitted.scored, LAYOUT, SETTINGS)["roc_auc"].first()["auc"] > 0.95


def test_importances_sum_to_one_and_rank_the_signal_first(fitted):
    assert fitted.importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert model.top_importances(fitted.importance, 1).first()["feature"] == "signal"


def test_a_repeated_fit_gives_the_same_scores(parts, fitted):
    again = modelling.fit_and_score(parts, LAYOUT, SETTINGS)
    first = {r["id"]: r["score"] for r in fitted.scored.collect()}
    assert {r["id"]: r["score"] for r in again.scored.collect()} == first


def test_a_null_feature_is_an_error_without_imputation(parts):
    with pytest.raises(Exception):
        model.fit(
            parts.train,
            parts.features,
            modelling.classifier(LAYOUT, SETTINGS),
            LAYOUT.label,
            impute=False,
        )


def test_feature_names_may_hold_dots_and_spaces(spark, planted):
    odd = planted.withColumnsRenamed({"signal": "seg_S.A. (x, y)", "price_noise": "a=b;c"})
    parts = modelling.prepare(odd, LAYOUT, SETTINGS)
    fitted = modelling.fit_and_score(parts, LAYOUT, SETTINGS)
    assert model.top_importances(fitted.importance, 1).first()["feature"] == "seg_S.A. (x, y)"
    assert "seg_S.A. (x, y)" in prediction_table(fitted.scored, "churn", parts.features, "id").columns


def test_cross_validation_scores_each_row_once(parts):
    scores = model.cross_validated_scores(
        parts.train, parts.features, modelling.classifier(LAYOUT, SETTINGS), "id", "churn", 3
    )
    assert scores.count() == parts.train.count() == scores.select("id").distinct().count()
    per_fold = modelling.cross_validation(parts, LAYOUT, SETTINGS)
    values = [r["auc"] for r in per_fold.collect()]
    summary = model.fold_summary(per_fold).first()
    mean = sum(values) / 3
    assert summary["auc_mean"] == pytest.approx(mean)
    assert summary["auc_std"] == pytest.approx((sum((v - mean) ** 2 for v in values) / 3) ** 0.5)


def test_permutation_importance_drops_only_for_the_signal(parts, fitted):
    found = model.permutation_importance(fitted.model, parts.test, parts.features, "id", "churn")
    rows = by_key(found, "feature")
    assert rows["signal"]["auc_drop"] > 0.3
    assert abs(rows["price_noise"]["auc_drop"]) < 0.1


def test_grid_search_orders_the_candidates(parts):
    base = modelling.classifier(LAYOUT, SETTINGS)
    grid = [{base.maxDepth: 1}, {base.maxDepth: 4}]
    rows = model.grid_search(parts.train, parts.features, base, grid, "id", "churn", 3).collect()
    assert [r["folds"] for r in rows] == [3, 3]
    assert {r["params"] for r in rows} == {"maxDepth=1", "maxDepth=4"}
    assert rows[0]["auc_mean"] >= rows[1]["auc_mean"]


def test_compare_models(parts):
    found = model.compare_models(
        parts.train,
        parts.test,
        parts.features,
        {
            "forest": modelling.classifier(LAYOUT, SETTINGS),
            "boosted": model.boosted_trees("churn", 3, 2, 42),
        },
        "id",
        "churn",
    )
    rows = by_key(found, "model")
    assert set(rows) == {"forest", "boosted"}
    assert all(r["auc"] > 0.9 and r["tp"] + r["fn"] == rows["forest"]["tp"] + rows["forest"]["fn"] for r in rows.values())


def test_price_share_and_verdict(spark):
    rows = [("price_a", 0.2), ("off_PEAK_b", 0.1), ("margin", 0.7)]
    importance = spark.createDataFrame(rows, "feature string, importance double")
    row = report.price_share(importance, replace(SETTINGS, top_features=2)).first()
    assert row["price_importance"] == pytest.approx(0.3)
    assert (row["price_in_top"], row["price_first"]) == (1, 0)
    assert row["price_share_of_top"] == pytest.approx(0.2 / 0.9)


def test_report_text_follows_the_figures(parts, fitted):
    per_fold = modelling.cross_validation(parts, LAYOUT, SETTINGS)
    metrics = report.report_metrics(fitted.scored, per_fold, fitted.importance, LAYOUT, SETTINGS)
    values = {r["metric"]: r["value"] for r in metrics.collect()}
    assert {"accuracy", "precision", "recall", "f1", "roc_auc", "cv_roc_auc_mean"} <= set(values)
    text = report.render(metrics, fitted.importance, None, SETTINGS)
    assert "No: price features contribute" in text and "1. signal" in text


def test_model_queries_run_on_the_given_tables(spark, tables):
    predictions = catalog.rf_predictions(spark, tables)
    assert {"id", "actual_churn", "predicted_churn", "churn_probability"} <= set(predictions.columns)
    assert predictions.count() > 30
    assert catalog.importance_top20(spark, tables).count() == 20


def test_a_grid_prepares_each_fold_once(parts, monkeypatch):
    calls, prepare = [], model._prepare
    monkeypatch.setattr(model, "_prepare", lambda *a, **b: calls.append(1) or prepare(*a, **b))
    base = modelling.classifier(LAYOUT, SETTINGS)
    grid = [{base.maxDepth: 1}, {base.maxDepth: 2}, {base.maxDepth: 3}]
    assert model.grid_search(parts.train, parts.features, base, grid, "id", "churn", 3).count() == 3
    assert len(calls) == 3


def test_least_node_weight_bounds_the_leaves(parts):
    def leaves(share: float) -> int:
        classifier = model.forest("churn", 3, 10, 42, share)
        return model.fit(parts.train, parts.features, classifier, "churn").stages[-1].totalNumNodes

    assert leaves(0.2) < leaves(0.0)
