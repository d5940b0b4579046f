"""Classifier evaluation: confusion, threshold curves and derived measures.

Inputs are rows with a 0/1 label and a score or a 0/1 prediction. Curves start
from one row per distinct score, so a score shared by very many rows is folded
before it is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import durable
from .ordered import BUCKET, cut_points, running_totals, with_value_bucket


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _or_zero(2 * tp, 2 * tp + fp + fn)


def confusion_counts(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp as columns; classes that never occur count 0."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, n): always four rows."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
            for a, p, c in cells
        ]
    )
    return confusion_counts(df, label, prediction).select(F.inline(rows))


def measures(counts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        *keep,
        "tn",
        "fp",
        "fn",
        "tp",
        _or_zero(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _or_zero(tp, tp + fp).alias("precision"),
        _or_zero(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return measures(confusion_counts(df, label, prediction, by), by)


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zeros, ones = tn + fp, tp + fn
    rows = zeros + ones
    accuracy = _or_zero(tp + tn, rows)
    zero = (_or_zero(tn, tn + fn), _or_zero(tn, tn + fp), _f1(tn, fn, fp))
    one = (_or_zero(tp, tp + fp), _or_zero(tp, tp + fn), _f1(tp, fp, fn))
    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [_or_zero(a * zeros + b * ones, rows) for a, b in zip(zero, one)]

    def line(name: str, values: Sequence[Column], support: Column) -> Column:
        p, r, f = values
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            support.alias("support"),
        )

    lines = F.array(
        line("0", zero, zeros),
        line("1", one, ones),
        line("accuracy", [accuracy] * 3, rows),
        line("macro avg", macro, rows),
        line("weighted avg", weighted, rows),
    )
    return confusion_counts(df, label, prediction).select(F.inline(lines))


def threshold_sweep(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float]
) -> DataFrame:
    """Precision, recall and F1 of ``score >= t`` for each threshold, in one scan."""
    y = F.col(label)
    sums: list[Column] = [F.count_if(y == 1).alias("ones")]
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        sums += [
            F.count_if(hit & (y == 1)).alias(f"tp{i}"),
            F.count_if(hit & (y == 0)).alias(f"fp{i}"),
        ]
    lines = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")
            )
            for i, t in enumerate(thresholds)
        ]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("ones") - F.col("tp")
    return (
        df.agg(*sums)
        .select("ones", F.inline(lines))
        .select(
            "threshold",
            _or_zero(tp, tp + fp).alias("precision"),
            _or_zero(tp, tp + fn).alias("recall"),
            _f1(tp, fp, fn).alias("f1"),
        )
    )


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, with the bucket of the score.

    Stored, as the cuts that split the distinct scores evenly are taken from them.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = durable(
        rows.groupBy(*by, score).agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
        )
    )
    return with_value_bucket(counts, score, cut_points(counts, score))


def _running(
    counts: DataFrame, score: str, by: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    totals = {"pos": F.col("pos"), "neg": F.col("neg")}
    return running_totals(counts, [score], totals, by, descending)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, exact with ties; null if a class is missing.

    Counts, for each positive, the negatives with a lower score and half of
    those with the same score. The sum is kept twice as large in a decimal, so
    it stays a whole number at any row count.
    """
    running = _running(score_counts(df, label, score, by), score, by, descending=False)
    wins = (2 * F.col("neg_before") + F.col("neg")).cast("decimal(19,0)")
    twice = F.sum(F.col("pos").cast("decimal(18,0)") * wins).cast("double")
    return (
        running.groupBy(*by)
        .agg(twice.alias("twice"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        .select(
            *by,
            "n_pos",
            "n_neg",
            F.try_divide(
                F.col("twice"), 2 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
            ).alias("auc"),
        )
    )


def roc_points(df: DataFrame, label: str, score: str, drop_collinear: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) for ``score >= threshold``, from (0, 0) to (1, 1).

    With ``drop_collinear`` a point is left out when the next step has the same
    positives and negatives, as it then lies on a straight line.
    """
    counts = score_counts(df, label, score)
    running = _running(counts, score)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    if drop_collinear:
        # The next lower score is in the same bucket or the first of the next one.
        down = Window.orderBy(F.col(BUCKET).desc())
        step = F.struct("pos", "neg")
        following = (
            counts.groupBy(BUCKET)
            .agg(F.max_by(step, F.col(score)).alias("first"))
            .select(BUCKET, F.lead("first").over(down).alias("next_bucket"))
        )
        inside = F.lead(step).over(Window.partitionBy(BUCKET).orderBy(F.col(score).desc()))
        after = F.coalesce(F.col("inside"), F.col("next_bucket"))
        first = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
        # At most one row per bucket.
        running = (
            running.withColumn("inside", inside)
            .join(F.broadcast(following), BUCKET)
            .where(first | after.isNull() | (after != step))
        )
    points = running.select(
        F.col(score).cast("double").alias("threshold"),
        ratio(fp, F.col("neg_total")).alias("fpr"),
        ratio(tp, F.col("pos_total")).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def precision_recall_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) for ``score >= threshold`` at every score."""
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    return _running(score_counts(df, label, score), score).select(
        F.col(score).cast("double").alias("threshold"),
        ratio(tp, tp + fp).alias("precision"),
        _or_zero(tp, F.col("pos_total")).alias("recall"),
    )


def score_deciles(df: DataFrame, label: str, score: str, parts: int = 10) -> DataFrame:
    """Size, label rate and lift per score decile; decile 1 has the highest scores.

    A row belongs to the decile of its score's first place from the top, so
    equal scores always share a decile.
    """
    running = _running(score_counts(df, label, score), score)
    size = F.col("pos") + F.col("neg")
    before = F.col("pos_before") + F.col("neg_before")
    total = F.col("pos_total") + F.col("neg_total")
    decile = (F.floor(before * parts / total) + 1).cast("int")
    rate = ratio(F.sum("pos"), F.sum(size))
    base = ratio(F.max("pos_total"), F.max(total))
    return running.groupBy(decile.alias("decile")).agg(
        F.sum(size).alias("n"),
        F.sum("pos").alias("n_pos"),
        F.min(score).alias("min_score"),
        rate.alias("label_rate"),
        F.try_divide(rate, base).alias("lift"),
    )


def retention_list(df: DataFrame, id: str, score: str, top: int) -> DataFrame:
    """The entities with the highest churn scores; ties in id order."""
    return df.select(id, score).orderBy(F.desc(score), F.asc(id)).limit(top)


