"""Categories as sparse vectors: the features of the wide table for any number of values."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from given_tables.views import LAYOUT
from stayrate.config import Settings
from stayrate.operators import encode, model
from stayrate.plans import features, modelling
from stayrate.sinks.files import prediction_table
from tests.helpers import by_key

MANY = 5000
SETTINGS = replace(Settings(), trees=20, max_depth=4, folds=2, min_category_count=2, max_categories=10)


@pytest.fixture(scope="module")
def rows(spark):
    """Four rows of each of 5,000 channels; who comes from one of four origins leaves."""
    channel = F.pmod(F.col("id"), F.lit(MANY))
    found = spark.range(20_000).select(
        "id",
        channel.cast("string").alias("channel_sales"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("o"), (F.col("id") % 4).cast("string"))).alias("origin_up"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).cast("double").alias("noise"),
    )
    return found.withColumn("churn", (F.col("origin_up") == "o1").cast("int")).fillna({"churn": 0})


@pytest.fixture(scope="module")
def parts(rows):
    return modelling.prepare(rows, LAYOUT, SETTINGS)


@pytest.fixture(scope="module")
def fitted(parts):
    return modelling.fit_and_score(parts, LAYOUT, SETTINGS)


def test_vectors_hold_what_the_wide_table_holds(spark):
    df = spark.createDataFrame(
        [(1, "a b", 1), (2, "a b", None), (3, "rare", 1), (4, None, 2), (5, "", 2), (6, "", 1), (7, "x.y`z", 2), (8, "x.y`z", 2)],
        "id int, `c d` string, n int",
    )
    made = encode.category_vectors(df, ["c d", "n"], 2)
    assert made.names == ["c d_", "c d_a b", "c d_x.y`z", "n_1", "n_2"]
    wide = encode.one_hot_wide(df, encode.category_lists(df, ["c d", "n"], 2, 10))
    expected = {(r["id"], c) for r in wide.collect() for c in wide.columns[1:] if r[c]}
    assert {tuple(r) for r in encode.active_categories(df, "id", made).collect()} == expected
    assert expected == {tuple(r) for r in encode.one_hot_long(df, "id", ["c d", "n"], 2).collect()}
    new = spark.createDataFrame([(9, "unseen", 3), (10, "a b", 2)], df.schema)
    assert {tuple(r) for r in encode.active_categories(new, "id", made).collect()} == {(10, "c d_a b"), (10, "n_2")}


def test_no_frequent_category(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, c string")
    none = encode.category_vectors(df, ["c"], 2)
    assert none.names == [] and encode.active_categories(df, "id", none).collect() == []
    one = encode.category_vectors(df, ["c"], 1)
    assert [tuple(r) for r in encode.active_categories(df, "id", one).collect()] == [(1, "c_a")]


def test_a_fit_on_thousands_of_categories(parts, fitted):
    assert parts.features == ["noise"] and len(parts.categories.names) == MANY + 4
    importance = by_key(fitted.importance, "feature")
    assert len(importance) == 1 + MANY + 4
    assert sum(r["importance"] for r in importance.values()) == pytest.approx(1.0)
    # A node draws 71 of 5,005 features, so any of the four origins may come first.
    assert model.top_importances(fitted.importance, 1).first()["feature"].startswith("origin_up_")
    assert fitted.scored.where(~F.col("score").between(0, 1)).isEmpty()
    assert modelling.evaluation_tables(fitted.scored, LAYOUT, SETTINGS)["roc_auc"].first()["auc"] > 0.9


def test_rows_stay_sparse(parts, fitted):
    scored = fitted.model.transform(parts.categories.with_texts(parts.test.withColumn("_in0", F.col("noise"))))
    sizes = scored.limit(50).select(model.VECTOR).collect()
    assert {r[0].size for r in sizes} == {1 + MANY + 4} and max(len(r[0].indices) for r in sizes) <= 3
    assert scored.limit(1).select(F.size(vector_to_array(model.VECTOR)).alias("n")).first()["n"] == 1 + MANY + 4


def test_predictions_carry_the_category_as_text(parts, fitted):
    found = prediction_table(fitted.scored, LAYOUT.label, parts.columns, "id")
    assert found.columns == ["id", "noise", "channel_sales", "origin_up", "actual_churn", "predicted_churn", "churn_probability"]


def test_folds_and_candidates_use_the_vectors(rows):
    few = modelling.prepare(rows.where("id % 5000 < 60"), LAYOUT, SETTINGS)
    found = modelling.cross_validation(few, LAYOUT, SETTINGS).collect()
    assert sorted(r["fold"] for r in found) == [0, 1] and all(r["auc"] > 0.9 for r in found)
    grid = [{modelling.classifier(LAYOUT, SETTINGS).maxDepth: d} for d in (1, 3)]
    best = model.grid_search(
        few.train, few.features, modelling.classifier(LAYOUT, SETTINGS), grid, "id", "churn", 2, categories=few.categories
    )
    assert {r["folds"] for r in best.collect()} == {2}


def test_feature_table_with_more_categories_than_columns_allowed(spark):
    clients = spark.range(40).select(
        "id", F.concat(F.lit("c"), (F.col("id") % 20).cast("string")).alias("channel_sales"), F.lit("o").alias("origin_up"),
        *[F.to_date(F.lit("2010-01-01")).alias(c) for c in LAYOUT.date_columns], F.lit("t").alias("has_gas"), F.lit(0).alias("churn"),
    )
    prices = spark.range(40).select(
        "id", F.to_date(F.lit("2015-01-01")).alias("price_date"), *[F.lit(1.0).alias(c) for c in LAYOUT.price_columns]
    )
    text = features.build_features(clients, prices, LAYOUT, SETTINGS)
    assert {"channel_sales", "origin_up"} <= set(text.columns)
    assert features.feature_summary(text, LAYOUT, SETTINGS).first()["n_dummies"] == 21
    wide = features.build_features(clients, prices, LAYOUT, replace(SETTINGS, max_categories=21))
    assert "channel_sales_c7" in wide.columns and "channel_sales" not in wide.columns
    with pytest.raises(ValueError, match="max_categories"):
        features.build_features(clients, prices, LAYOUT, replace(SETTINGS, wide_categories=True))
    again = features.build_features(clients, prices, LAYOUT, replace(SETTINGS, max_categories=21, wide_categories=False))
    assert again.columns == text.columns
