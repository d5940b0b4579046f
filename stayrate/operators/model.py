"""Fitting, cross-validating and explaining tree-ensemble classifiers.

Training tables are checkpointed once and read by every fit. Fits run
on Spark ML; scores stay rows of a DataFrame from start to end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric, quoted
from ..session import durable, pinned
from .encode import Categories
from .evaluate import binary_metrics, roc_auc
from .ordered import ranks
from .split import HASH_RANGE, with_class_weights

VECTOR = "features"
WEIGHT = "weight"
SCORE = "score"
FOLD = "fold"
NO_CATEGORIES = Categories([], [], [])


def feature_names(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """All numeric columns except keys, label and helper columns."""
    return [c for c in numeric(df) if c not in set(exclude)]


def training_table(
    df: DataFrame, id: str, keep: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """Cast the features to double, fix the row placement, checkpoint.

    Bootstrap samples depend on which rows share a partition; placing rows by
    id makes a fit repeatable. Adaptive execution sizes the partitions by the
    data, which matters because a forest runs a job per tree level.
    """
    rows = df.select(id, *keep, *[F.col(quoted(c)).cast("double").alias(c) for c in features])
    return pinned(rows.repartition(F.col(id)).sortWithinPartitions(id))


def forest(
    label: str, trees: int, max_depth: int, seed: int, least_weight: float = 0.0
) -> RandomForestClassifier:
    """Random forest with class weights; sqrt(features) candidates per split.

    Every node holds at least the share ``least_weight`` of the training weight.
    Above 0 this bounds the leaves of a tree, all of which pass through the
    driver, by 1 / ``least_weight`` whatever the number of rows.
    """
    return RandomForestClassifier(
        labelCol=label,
        featuresCol=VECTOR,
        weightCol=WEIGHT,
        numTrees=trees,
        maxDepth=max_depth,
        featureSubsetStrategy="sqrt",
        minWeightFractionPerNode=least_weight,
        seed=seed,
    )


def boosted_trees(label: str, rounds: int, max_depth: int, seed: int) -> GBTClassifier:
    return GBTClassifier(
        labelCol=label,
        featuresCol=VECTOR,
        weightCol=WEIGHT,
        maxIter=rounds,
        maxDepth=max_depth,
        seed=seed,
    )


def _with_inputs(
    df: DataFrame, features: Sequence[str], categories: Categories = NO_CATEGORIES
) -> DataFrame:
    """Add the features under plain names: category values can hold dots and spaces."""
    named = df.withColumns(
        {f"_in{i}": F.col(quoted(c)).cast("double") for i, c in enumerate(features)}
    )
    return categories.with_texts(named) if categories.columns else named


def fit(
    train: DataFrame,
    features: Sequence[str],
    classifier,
    label: str,
    impute: bool = True,
    categories: Categories = NO_CATEGORIES,
) -> PipelineModel:
    """Fit on balanced class weights; nulls become training medians.

    The places of ``categories`` follow the features in the vector, which stays sparse.
    With ``impute=False`` a null feature is an error. A tree fit passes over
    its input several times before it keeps its own copy, so the assembled
    vectors are kept for the length of the fit (spilling to disk, and rebuilt
    from the checkpointed rows if an executor is lost).
    """
    prepared, weighted = _prepare(train, features, label, impute, categories)
    vectors = prepared.transform(weighted).select(label, WEIGHT, VECTOR)
    vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # A copy is without the training summary, which would go to every task that scores.
        fitted = classifier.fit(vectors).copy()
    finally:
        vectors.unpersist()
    return PipelineModel(stages=[*prepared.stages, fitted])


def _prepare(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    impute: bool = True,
    categories: Categories = NO_CATEGORIES,
) -> tuple[PipelineModel, DataFrame]:
    """Stages from features to a vector, fitted on ``train``, and ``train`` with weights and inputs."""
    stages: list = []
    inputs = [f"_in{i}" for i in range(len(features))]
    if impute and inputs:
        filled = [f"_filled{i}" for i in range(len(features))]
        stages.append(
            Imputer(strategy="median", inputCols=inputs, outputCols=filled, relativeError=0.001)
        )
        inputs = filled
    stages += categories.stages
    inputs = [*inputs, *categories.vectors]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=VECTOR, handleInvalid="error"))
    weighted = with_class_weights(_with_inputs(train, features, categories), label, WEIGHT)
    return Pipeline(stages=stages).fit(weighted), weighted


def score(
    model: PipelineModel,
    df: DataFrame,
    features: Sequence[str],
    categories: Categories = NO_CATEGORIES,
) -> DataFrame:
    """``df`` with predicted class (``prediction``) and P(class 1) (``score``)."""
    scored = model.transform(_with_inputs(df, features, categories)).withColumn(SCORE, vector_to_array("probability").getItem(1))
    return scored.select(
        *[F.col(quoted(c)) for c in df.columns], F.col("prediction").cast("int"), SCORE
    )


@dataclass(frozen=True)
class Fold:
    """Vectors of the rows outside a fold, to fit on, and of those in it, to score."""

    fit_on: DataFrame
    held_out: DataFrame


def fold_vectors(
    train: DataFrame,
    features: Sequence[str],
    id: str,
    label: str,
    folds: int,
    parallelism: int = 5,
    categories: Categories = NO_CATEGORIES,
) -> list[Fold]:
    """Medians, weights and vectors of every fold, worked out once for all candidates.

    Medians and weights come from the rows outside the fold alone. Both parts are
    checkpointed, as every fit passes over them several times.
    """

    def one(k: int) -> Fold:
        outside = train.where(F.col(FOLD) != k)
        prepared, weighted = _prepare(outside, features, label, categories=categories)
        inside = _with_inputs(train.where(F.col(FOLD) == k), features, categories)
        held_out = prepared.transform(inside)
        return Fold(
            pinned(prepared.transform(weighted).select(label, WEIGHT, VECTOR)),
            pinned(held_out.select(id, label, FOLD, VECTOR)),
        )

    return _side_by_side(one, range(folds), train, parallelism)


def _side_by_side(work, inputs: Sequence, df: DataFrame, parallelism: int) -> list:
    with ThreadPool(max(1, min(parallelism, len(inputs)))) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), inputs)


def fold_scores(
    folds: Sequence[Fold], candidates: Mapping[str, object], id: str, label: str, parallelism: int = 5
) -> DataFrame:
    """Scores of every held-out row by every candidate, under the candidate's name in ``params``."""

    def one(task: tuple[str, Fold]) -> DataFrame:
        name, fold = task
        scored = candidates[name].fit(fold.fit_on).copy().transform(fold.held_out)
        return scored.select(
            F.lit(name).alias("params"),
            id,
            label,
            FOLD,
            F.col("prediction").cast("int").alias("prediction"),
            vector_to_array("probability").getItem(1).alias(SCORE),
        )

    tasks = [(name, fold) for name in candidates for fold in folds]
    parts = _side_by_side(one, tasks, folds[0].fit_on, parallelism)
    return durable(reduce(DataFrame.unionByName, parts))


def cross_validated_scores(
    train: DataFrame,
    features: Sequence[str],
    classifier,
    id: str,
    label: str,
    folds: int,
    parallelism: int = 5,
    categories: Categories = NO_CATEGORIES,
) -> DataFrame:
    """Score of every training row by the model that did not see its fold."""
    vectors = fold_vectors(train, features, id, label, folds, parallelism, categories)
    return fold_scores(vectors, {"": classifier}, id, label, parallelism).drop("params")


def cross_validate(
    train: DataFrame,
    features: Sequence[str],
    classifier,
    id: str,
    label: str,
    folds: int,
    parallelism: int = 5,
    categories: Categories = NO_CATEGORIES,
) -> DataFrame:
    """(fold, n_pos, n_neg, auc) rows."""
    scores = cross_validated_scores(
        train, features, classifier, id, label, folds, parallelism, categories
    )
    return roc_auc(scores, label, SCORE, [FOLD])


def fold_summary(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of the fold AUCs."""
    return per_fold.groupBy(*by).agg(
        F.count("auc").alias("folds"), F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std")
    )


def importances(
    model: PipelineModel,
    features: Sequence[str],
    df: DataFrame,
    categories: Categories = NO_CATEGORIES,
) -> DataFrame:
    """(feature, importance): mean decrease in impurity, one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip([*features, *categories.names], values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def top_importances(importance: DataFrame, top: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(top)


def compare_models(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    classifiers: Mapping[str, object],
    id: str,
    label: str,
    categories: Categories = NO_CATEGORIES,
) -> DataFrame:
    """Threshold measures and AUC of several classifiers on the same split."""
    parts = [
        score(
            fit(train, features, classifier, label, categories=categories), test, features, categories
        ).select(
            F.lit(name).alias("model"), id, label, "prediction", SCORE
        )
        for name, classifier in classifiers.items()
    ]
    scored = durable(reduce(DataFrame.unionByName, parts))
    measured = binary_metrics(scored, label, "prediction", ["model"])
    areas = roc_auc(scored, label, SCORE, ["model"]).select("model", "auc")
    return measured.join(areas, "model")


def grid_search(
    train: DataFrame,
    features: Sequence[str],
    classifier,
    param_maps: Sequence[dict],
    id: str,
    label: str,
    folds: int,
    parallelism: int = 5,
    categories: Categories = NO_CATEGORIES,
) -> DataFrame:
    """Cross-validated AUC per parameter map, best first.

    Works on the given fold column, so every candidate sees the same folds, each
    of them prepared once whatever the number of candidates.
    """
    candidates = {
        ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda i: i[0].name)): classifier.copy(params)
        for params in param_maps
    }
    vectors = fold_vectors(train, features, id, label, folds, parallelism, categories)
    scored = fold_scores(vectors, candidates, id, label, parallelism)
    per_fold = roc_auc(scored, label, SCORE, ["params", FOLD])
    return fold_summary(per_fold, ["params"]).orderBy(F.desc("auc_mean"), F.asc("params"))


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], id: str, label: str
) -> DataFrame:
    """AUC lost when one feature's values are dealt to other rows.

    Every row gets one donor row: ranks by two different hashes of the id pair
    the rows up one to one, which is a permutation. Only ids are ranked; the donor's
    values are fetched once. For each feature the row is scored with that feature
    taken from the donor, all features in one pass.
    """
    prepare, classifier = PipelineModel(model.stages[:-1]), model.stages[-1]
    # Written once: both sides of the pairing and the quantile sketch read it.
    prepared = prepare.transform(_with_inputs(df, features))
    vectors = durable(prepared.select(id, label, vector_to_array(VECTOR).alias("own")))
    hashed = vectors.select(id).withColumns(
        {
            "_a": F.pmod(F.xxhash64(id, F.lit(1)), F.lit(HASH_RANGE)),
            "_b": F.pmod(F.xxhash64(id, F.lit(2)), F.lit(HASH_RANGE)),
        }
    )
    takers = ranks(hashed, [], "_a", id, HASH_RANGE).select(id, "rank")
    donors = ranks(hashed, [], "_b", id, HASH_RANGE).select(F.col(id).alias("_giver"), "rank")
    givers = vectors.select(F.col(id).alias("_giver"), F.col("own").alias("donor"))
    paired = vectors.join(takers.join(donors, "rank").drop("rank"), id).join(givers, "_giver")
    # Feature number -1 is the unchanged row.
    copies = paired.select(
        label, "own", "donor", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("j")
    )
    mixed = F.transform(
        "own", lambda x, i: F.when(i == F.col("j"), F.get("donor", i)).otherwise(x)
    )
    scored = classifier.transform(copies.select(label, "j", array_to_vector(mixed).alias(VECTOR)))
    scores = durable(scored.select("j", label, vector_to_array("probability").getItem(1).alias(SCORE)))
    areas = durable(roc_auc(scores, label, SCORE, ["j"]))
    base = areas.where(F.col("j") == -1).select("auc").scalar()
    names = F.array(*[F.lit(c) for c in features])
    return areas.where(F.col("j") >= 0).select(
        F.get(names, F.col("j")).alias("feature"),
        "auc",
        (base - F.col("auc")).alias("auc_drop"),
    )
