"""Classifier measures against brute force and Spark's own evaluator."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from given_tables.views import scored
from stayrate.operators import evaluate
from tests.helpers import by_key

SCHEMA = "label int, score double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_roc(rows, drop):
    steps = sorted({s for _, s in rows}, reverse=True)
    total = (sum(y == 0 for y, _ in rows), sum(y == 1 for y, _ in rows))
    counts = [
        (t, sum(y == 0 and s >= t for y, s in rows), sum(y == 1 and s >= t for y, s in rows)) for t in steps
    ]
    if drop:
        kept = []
        for i, c in enumerate(counts):
            if 0 < i < len(counts) - 1:
                before, after = counts[i - 1], counts[i + 1]
                if (c[1] - before[1], c[2] - before[2]) == (after[1] - c[1], after[2] - c[2]):
                    continue
            kept.append(c)
        counts = kept
    points = [(t, fp / total[0], tp / total[1]) for t, fp, tp in counts]
    return [(float("inf"), 0.0, 0.0), *points]


@pytest.fixture(scope="module")
def tied():
    """A third of all rows share one score."""
    pick = random.Random(3)
    rows = [(int(pick.random() < 0.3), 0.1) for _ in range(100)]
    return rows + [(int(pick.random() < 0.3), round(pick.random(), 2)) for _ in range(200)]


def test_auc_with_ties(spark, tied):
    row = evaluate.roc_auc(frame(spark, tied), "label", "score").first()
    assert row["auc"] == pytest.approx(brute_auc(tied), abs=1e-15)
    assert row["n_pos"] + row["n_neg"] == len(tied)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.25, 1e-7, 2e-7, 0.5, 1.0])),
        min_size=2,
        max_size=30,
    )
)
def test_auc_property(spark, rows):
    found = evaluate.roc_auc(frame(spark, rows), "label", "score").first()["auc"]
    if len({y for y, _ in rows}) < 2:
        assert found is None
    else:
        assert found == pytest.approx(brute_auc(rows))


def test_auc_of_given_tables_equals_the_evaluator(spark, tables):
    df = scored(spark, tables)
    ours = evaluate.roc_auc(df, "label", "score").first()["auc"]
    theirs = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", numBins=0)
    assert ours == pytest.approx(theirs.evaluate(df), abs=1e-12)


def test_auc_does_not_change_with_a_monotone_score_change(spark, tied):
    df = frame(spark, tied)
    moved = df.withColumn("score", F.exp(F.col("score") * 3) - 7)
    first = evaluate.roc_auc(df, "label", "score").first()["auc"]
    assert evaluate.roc_auc(moved, "label", "score").first()["auc"] == first


def test_auc_by_group(spark, tied):
    rows = [(g, y, s) for i, (y, s) in enumerate(tied) for g in [i % 2]]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    found = by_key(evaluate.roc_auc(df, "label", "score", ["g"]), "g")
    for g in (0, 1):
        assert found[g]["auc"] == pytest.approx(brute_auc([r[1:] for r in rows if r[0] == g]))


@pytest.mark.parametrize("drop", [True, False])
def test_roc_points(spark, tied, drop):
    points = evaluate.roc_points(frame(spark, tied), "label", "score", drop_collinear=drop)
    found = sorted(map(tuple, points.collect()), reverse=True)
    assert found == brute_roc(tied, drop)
    assert found[-1][1:] == (1.0, 1.0)


def test_precision_recall_points(spark, tied):
    for row in evaluate.precision_recall_points(frame(spark, tied), "label", "score").collect():
        hits = [y for y, s in tied if s >= row["threshold"]]
        assert row["precision"] == sum(hits) / len(hits)
        assert row["recall"] == sum(hits) / sum(y for y, _ in tied)


def test_threshold_sweep(spark, tied):
    df = evaluate.threshold_sweep(frame(spark, tied), "label", "score", [0.2, 0.5, 2.0])
    rows = by_key(df, "threshold")
    recalls = [rows[t]["recall"] for t in (0.2, 0.5, 2.0)]
    assert recalls == sorted(recalls, reverse=True)
    assert tuple(rows[2.0])[1:] == (0.0, 0.0, 0.0)


def published(spark):
    """A confusion table in the ratio 6 : 1 : 65 : 658."""
    rows = [(1, 1)] * 6 + [(0, 1)] + [(1, 0)] * 65 + [(0, 0)] * 658
    return spark.createDataFrame(rows, "label int, prediction int")


def test_measures(spark):
    row = evaluate.binary_metrics(published(spark), "label", "prediction").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (6, 1, 65, 658)
    for name, expected in {"accuracy": 0.9096, "precision": 0.8571, "recall": 0.0845, "f1": 0.1538}.items():
        assert round(row[name], 4) == expected


def test_measures_without_positive_predictions_are_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    row = evaluate.binary_metrics(df, "label", "prediction").first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_confusion_has_all_four_cells(spark):
    df = spark.createDataFrame([(1, 0)], "label int, prediction int")
    rows = by_key(evaluate.confusion(df, "label", "prediction"), "actual", "predicted")
    assert {k: r["n"] for k, r in rows.items()} == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_class_report(spark):
    rows = by_key(evaluate.class_report(published(spark), "label", "prediction"), "class")
    assert rows["1"]["support"] == 71 and rows["0"]["support"] == 659
    assert rows["0"]["precision"] == pytest.approx(658 / 723)
    assert rows["macro avg"]["recall"] == pytest.approx((658 / 659 + 6 / 71) / 2)
    weighted = (rows["0"]["f1"] * 659 + rows["1"]["f1"] * 71) / 730
    assert rows["weighted avg"]["f1"] == pytest.approx(weighted)
    assert rows["accuracy"]["f1"] == pytest.approx(664 / 730)


def test_deciles_keep_every_row_and_ties_together(spark, tied):
    rows = by_key(evaluate.score_deciles(frame(spark, tied), "label", "score"), "decile")
    assert sum(r["n"] for r in rows.values()) == len(tied)
    assert sum(r["n_pos"] for r in rows.values()) == sum(y for y, _ in tied)
    lowest = [rows[d]["min_score"] for d in sorted(rows)]
    assert lowest == sorted(set(lowest), reverse=True)


def test_retention_list(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5)], "id int, score double")
    assert [r["id"] for r in evaluate.retention_list(df, "id", "score", 2).collect()] == [2, 1]
