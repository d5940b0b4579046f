"""Model job: split, fit, score, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import Layout, Settings
from ..functions.columns import present
from ..operators import evaluate
from ..operators.encode import Categories, category_vectors
from ..operators.model import (
    FOLD,
    NO_CATEGORIES,
    SCORE,
    cross_validate,
    feature_names,
    fit,
    forest,
    importances,
    score,
    training_table,
)
from ..operators.split import stratified_split
from ..session import durable


@dataclass(frozen=True)
class Prepared:
    """Split feature rows, the names of the features, and category columns that become vectors."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    categories: Categories = NO_CATEGORIES

    @property
    def columns(self) -> list[str]:
        """The columns that the vectors are made of."""
        return [*self.features, *self.categories.columns]


@dataclass(frozen=True)
class Fitted:
    model: PipelineModel
    scored: DataFrame
    importance: DataFrame


def prepare(
    features: DataFrame,
    layout: Layout = Layout(),
    settings: Settings = Settings(),
    hash: Column | None = None,
) -> Prepared:
    """Split and place the rows. Category columns that are still text become sparse vectors."""
    features = features.drop(layout.index_artefact)
    names = feature_names(features, [layout.id, layout.label])
    texts = [c for c in present(features, layout.category_columns) if features.schema[c].dataType == StringType()]
    categories = category_vectors(features, texts, settings.min_category_count) if texts else NO_CATEGORIES
    parts = stratified_split(
        features, layout.id, layout.label, settings.test_share, settings.folds, hash
    )
    keep = [layout.label, "split", FOLD, *categories.columns]
    table = training_table(parts, layout.id, keep, names)
    return Prepared(
        table.where(F.col("split") == "train").drop("split"),
        table.where(F.col("split") == "test").drop("split", FOLD),
        names,
        categories,
    )


def classifier(layout: Layout, settings: Settings):
    return forest(
        layout.label, settings.trees, settings.max_depth, settings.seed, settings.least_node_weight
    )


def fit_and_score(
    parts: Prepared, layout: Layout = Layout(), settings: Settings = Settings()
) -> Fitted:
    """Fit the forest on the training part and score the test part.

    The scored rows are written once, because every curve and measure reads
    them.
    """
    chosen = classifier(layout, settings)
    model = fit(parts.train, parts.features, chosen, layout.label, categories=parts.categories)
    return Fitted(
        model,
        durable(score(model, parts.test, parts.features, parts.categories)),
        importances(model, parts.features, parts.train, parts.categories),
    )


def cross_validation(
    parts: Prepared, layout: Layout = Layout(), settings: Settings = Settings()
) -> DataFrame:
    return cross_validate(
        parts.train,
        parts.features,
        classifier(layout, settings),
        layout.id,
        layout.label,
        settings.folds,
        categories=parts.categories,
    )


def evaluation_tables(
    scored: DataFrame, layout: Layout = Layout(), settings: Settings = Settings()
) -> dict[str, DataFrame]:
    """Name -> table, all from the scored test rows."""
    label = layout.label
    return {
        "confusion": evaluate.confusion(scored, label, "prediction"),
        "binary_metrics": evaluate.binary_metrics(scored, label, "prediction"),
        "class_report": evaluate.class_report(scored, label, "prediction"),
        "roc_auc": evaluate.roc_auc(scored, label, SCORE),
        "roc_points": evaluate.roc_points(scored, label, SCORE),
        "pr_points": evaluate.precision_recall_points(scored, label, SCORE),
        "threshold_sweep": evaluate.threshold_sweep(scored, label, SCORE, settings.thresholds),
        "score_deciles": evaluate.score_deciles(scored, label, SCORE),
    }
