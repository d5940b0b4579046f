"""Histograms, densities and correlations: the numbers behind the plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..session import durable
from .ordered import as_rows, column_quantiles


def histogram(
    df: DataFrame, columns: Sequence[str], label: str | None = None, bins: int = 50
) -> DataFrame:
    """Counts per variable, class and bin, with bin edges common to all classes.

    Bins are numbered from 1, have equal width from minimum to maximum, and the
    last one includes its upper edge. Empty bins have no row. A variable with a
    single value gets a range of one around it.
    """
    keep = [label] if label else []
    values = as_rows(df, columns, keep)
    bounds = values.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    bounds = bounds.select(
        "variable",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    bucket = F.least(F.width_bucket("value", "lo", "hi", F.lit(bins)), F.lit(bins).cast("bigint"))
    width = (F.col("hi") - F.col("lo")) / bins
    # bounds has one row per named variable, a list the caller wrote.
    return (
        values.join(F.broadcast(bounds), "variable")
        .groupBy("variable", *keep, bucket.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first(width).alias("width"))
        .select(
            "variable",
            *keep,
            "bin",
            "n",
            (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("bin_start"),
        )
    )


def auto_bins(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n, bins): the finer of the Sturges and Freedman-Diaconis rules."""
    quartiles = column_quantiles(df, columns, {"q1": 0.25, "q3": 0.75})
    stats = (
        as_rows(df, columns)
        .groupBy("variable")
        .agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    span = F.col("hi") - F.col("lo")
    sturges = F.try_divide(span, F.log2("n") + 1)
    fd = 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("n"), F.lit(1 / 3))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return stats.join(quartiles, "variable").select(
        "variable",
        "n",
        F.when(span > 0, F.ceil(span / width)).otherwise(F.lit(1)).cast("bigint").alias("bins"),
    )


#: Kernels are summed up to REACH bandwidths from a point; exp(-REACH ** 2 / 2) < 1e-17.
REACH = 9.0
#: Width of a cell in bandwidths, and up to which power of the distance to its middle its values are known.
CELL, POWERS = 0.25, 8


def _hermite(n: int) -> list[float]:
    """Coefficients of u ** 0, u ** 1, ... in the n-th derivative of the kernel over the kernel, up to its sign."""
    before, now = [0.0], [1.0]
    for k in range(n):
        raised = [0.0, *now]
        before, now = now, [a - k * b for a, b in zip(raised, [*before, *[0.0] * len(raised)])]
    return now


def density(df: DataFrame, columns: Sequence[str], points: int = 200) -> DataFrame:
    """Gaussian kernel density of each column on an even grid from min to max.

    The bandwidth is the sample deviation times n^(-1/5). Values are gathered in even
    cells a quarter of a bandwidth wide, with the sums of the powers of their distances
    to the middle, inside the task before any shuffle: one row per value, whatever the
    number of points. Each cell then adds to the points within REACH bandwidths by the
    series of the kernel around its middle. By Cramer's bound on Hermite functions the
    terms left out are below 2e-11 of a kernel's height per value, those beyond REACH
    below 1e-17. A column with a single value has no bandwidth: its points all lie on
    the value and their density is null.
    """
    rows = as_rows(df, columns)
    stats = (
        rows.groupBy("variable")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.stddev_samp("value").alias("sd"),
        )
        .withColumn("bandwidth", F.when(F.col("sd") > 0, F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))))
        .withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1))
    )
    # One row per named variable, a list the caller wrote; read three times.
    stats = F.broadcast(durable(stats))
    width = F.col("bandwidth") * CELL
    cell = F.coalesce(F.floor((F.col("value") - F.col("lo")) / width), F.lit(0))
    middle = F.col("lo") + (F.col("cell") + 0.5) * width
    off = (F.col("value") - middle) / F.col("bandwidth")
    # A column without a bandwidth has one cell and no powers.
    cells = (
        rows.join(stats, "variable")
        .withColumn("cell", cell)
        .withColumn("off", off)
        .groupBy("variable", "cell")
        .agg(*[F.sum(F.pow("off", F.lit(float(k)))).alias(f"m{k}") for k in range(POWERS + 1)])
        .join(stats, "variable")
    )
    # The series in powers of u, the distance from the middle to the point: its coefficients are those of the cell.
    terms = [_hermite(k) for k in range(POWERS + 1)]
    series = [
        sum((F.col(f"m{k}") * (t[i] / math.factorial(k)) for k, t in enumerate(terms) if i < len(t) and t[i]), F.lit(0.0))
        for i in range(POWERS + 1)
    ]
    first = F.greatest(F.ceil((middle - REACH * F.col("bandwidth") - F.col("lo")) / F.col("step")), F.lit(0))
    last = F.least(F.floor((middle + REACH * F.col("bandwidth") - F.col("lo")) / F.col("step")), F.lit(points - 1))
    near = cells.withColumns({"middle": middle, **{f"a{i}": a for i, a in enumerate(series)}}).where(first <= last)
    at = near.select("*", F.explode(F.sequence(first, last)).alias("point"))
    u = (F.col("lo") + F.col("point") * F.col("step") - F.col("middle")) / F.col("bandwidth")
    value = F.col(f"a{POWERS}")
    for i in reversed(range(POWERS)):
        value = value * F.col("u") + F.col(f"a{i}")
    sums = (
        at.withColumn("u", u)
        .groupBy("variable", F.col("point").cast("int").alias("point"))
        .agg(F.sum(value * F.exp(-F.col("u") * F.col("u") / 2)).alias("k"))
    )
    # Every point, also those that no value reaches.
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    scale = F.col("n") * F.col("bandwidth") * F.sqrt(2 * F.pi())
    return grid.join(sums, ["variable", "point"], "left").select(
        "variable",
        "point",
        (F.col("lo") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce("k", F.lit(0.0)) / scale).alias("density"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns (each pair once), over the rows that have both.

    Every row becomes one vector: for each column its standardised value (0 for a gap),
    whether it is there, and the value's square. One distributed product of the vectors
    with themselves then holds every sum that any pair needs. The plan grows with the
    columns, not with the pairs; only the square matrix of the columns comes to the
    driver. Null where a pair has fewer than two rows or a column that does not vary on
    them. ``df`` is read several times, so pass a stored table.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    schema = "column_a string, column_b string, corr double"
    known = {
        r["variable"]: r
        for r in as_rows(df, columns)
        .groupBy("variable")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
        .collect()
    }
    n = df.count()
    if n < 2 or not pairs:
        return df.sparkSession.createDataFrame([(columns[i], columns[j], None) for i, j in pairs], schema)
    means = F.array(*[F.lit(known[c]["mean"] if c in known else 0.0) for c in columns])
    spread = F.array(*[F.lit((known[c]["sd"] if c in known else 0.0) or 1.0) for c in columns])
    held = F.transform(F.array(*[F.col(quoted(c)).cast("double") for c in columns]), lambda x, i: (x - F.get(means, i)) / F.get(spread, i))
    filled = F.transform("held", lambda x: F.coalesce(x, F.lit(0.0)))
    there = F.transform("held", lambda x: x.isNotNull().cast("double"))
    squares = F.transform("held", lambda x: F.coalesce(x * x, F.lit(0.0)))
    rows = df.select(held.alias("held")).select(array_to_vector(F.concat(filled, there, squares)).alias("row"))
    summary = rows.select(Summarizer.metrics("mean", "variance").summary(F.col("row")).alias("s")).first()["s"]
    mean, deviation = summary["mean"].toArray(), np.sqrt(summary["variance"].toArray())
    # Places that do not vary have no correlation, and no covariance either.
    matrix = np.nan_to_num(Correlation.corr(rows, "row").first()[0].toArray())
    sums = (n - 1) * matrix * np.outer(deviation, deviation)
    np.fill_diagonal(sums, (n - 1) * deviation**2)
    sums += n * np.outer(mean, mean)
    k = len(columns)
    x, m, q = (slice(at * k, (at + 1) * k) for at in range(3))
    both = np.rint(sums[m, m])
    own, square = sums[x, m], sums[q, m]  # sums of a column over the rows that have the other one
    spread_a = both * square - own**2
    result = []
    for i, j in pairs:
        size = spread_a[i, j] * spread_a[j, i]
        # What is left of a constant by rounding is no variance.
        least = 1e-9 * both[i, j] ** 2
        fine = both[i, j] > 1 and spread_a[i, j] > least and spread_a[j, i] > least
        value = (both[i, j] * sums[x, x][i, j] - own[i, j] * own[j, i]) / math.sqrt(size) if fine else None
        result.append((columns[i], columns[j], None if value is None else float(min(1.0, max(-1.0, value)))))
    return df.sparkSession.createDataFrame(result, schema)


def correlations_with(df: DataFrame, columns: Sequence[str], other: str) -> DataFrame:
    """(column, corr): Pearson correlation of each column with ``other``, in one scan."""
    wide = df.agg(
        *[
            F.corr(F.col(quoted(c)).cast("double"), F.col(quoted(other)).cast("double")).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("corr")) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows)))


def log_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values, and values that ``log10(x + 1)`` is not defined for."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(quoted(c)).cast("double").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("variable")
        .agg(F.count("value").alias("n"), F.count_if(F.col("value") <= -1).alias("n_invalid"))
    )
