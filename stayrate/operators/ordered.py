"""Ordered running totals, exact ranks and exact quantiles without a global sort.

A window without partitions would sort all rows in one task. Here the order is
cut into buckets first: running totals inside a bucket come from a window
partitioned by bucket, and the totals of all earlier buckets (one row per
bucket) are added to them. The result is exact for any choice of cuts; the cuts
only decide how evenly the work is spread.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..session import durable

BUCKETS = 256
RANK_BUCKETS = 4096
BUCKET = "_bucket"


def bucket_count(df: DataFrame, least: int = BUCKETS) -> int:
    """At least ``least`` buckets, and no fewer than the session's shuffle partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Fewer than ``buckets`` values that split the rows into similar parts.

    One scan with mergeable quantile sketches, no shuffle of rows. Pass the
    distinct values where a window then runs over these: a value that fills most
    rows would otherwise be nearly all cuts, and leave the others in one bucket.
    """
    buckets = buckets or bucket_count(df)
    steps = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(value, steps, 1 / (4 * buckets))))


def with_value_bucket(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Add the bucket number of ``value``; it never falls as the value rises."""
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=value, outputCol=BUCKET).transform(df)
    return bucketed.withColumn(BUCKET, F.col(BUCKET).cast("int"))


def with_even_bucket(
    df: DataFrame, value: str, hash_column: str, hash_range: int, buckets: int | None = None
) -> DataFrame:
    """Add a bucket number for rows in the order of ``value`` and, for equal values, of a hash.

    A value that is more than one of the cuts fills buckets of its own: as many as
    it is cuts, by the hash. So no bucket grows with the rows that share a value.
    """
    buckets = buckets or bucket_count(df)
    found = Counter(df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)))
    heavy = {v: n for v, n in found.items() if n > 1}
    cuts = sorted({*found, *(math.nextafter(v, math.inf) for v in heavy)})
    parts = F.lit(1)
    for v, n in heavy.items():
        parts = F.when(F.col(value) == v, n).otherwise(parts)
    part = F.floor(F.col(hash_column) * parts / F.lit(hash_range))
    return with_value_bucket(df, value, cuts).withColumn(BUCKET, F.col(BUCKET) * buckets + part)


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``{t}_before`` and ``{t}_total`` for each named total.

    ``df`` carries a bucket column whose order agrees with ``order``, and the
    order is total within each ``by`` group. ``{t}_before`` sums the rows that
    come earlier, ``{t}_total`` the whole group.
    """
    by = list(by)

    def sort(columns: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]

    buckets = df.groupBy(*by, BUCKET).agg(*[F.sum(c).alias(f"{t}_bucket") for t, c in totals.items()])
    across = Window.partitionBy(*by).orderBy(*sort([BUCKET]))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    offsets = buckets.select(
        *by,
        BUCKET,
        *[F.coalesce(F.sum(f"{t}_bucket").over(earlier), F.lit(0)).alias(f"{t}_offset") for t in totals],
        *[F.sum(f"{t}_bucket").over(everything).alias(f"{t}_total") for t in totals],
    )
    if not by:
        # One row per bucket, a number that the caller or the session sets.
        offsets = F.broadcast(offsets)

    inside = (
        Window.partitionBy(*by, BUCKET)
        .orderBy(*sort(order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.withColumns(
        {f"{t}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for t, c in totals.items()}
    )
    joined = local.join(offsets, [*by, BUCKET])
    return joined.withColumns(
        {f"{t}_before": F.col(f"{t}_before") + F.col(f"{t}_offset") for t in totals}
    ).drop(*[f"{t}_offset" for t in totals])


def ranks(
    df: DataFrame,
    by: Sequence[str],
    hash_column: str,
    tie_break: str,
    hash_range: int,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``rank`` (1, 2, ...) and ``group_size`` in hash order within each group.

    The hash spreads evenly over [0, hash_range), so buckets of equal width are
    even as well, also when one group holds nearly all rows.
    """
    buckets = buckets or bucket_count(df, RANK_BUCKETS)
    bucketed = df.withColumn(BUCKET, F.floor(F.col(hash_column) * F.lit(buckets) / F.lit(hash_range)))
    counted = running_totals(bucketed, [hash_column, tie_break], {"rows": F.lit(1)}, by)
    return counted.withColumns(
        {"rank": F.col("rows_before") + 1, "group_size": F.col("rows_total")}
    ).drop(BUCKET, "rows_before", "rows_total")


def value_counts_with_rank(
    df: DataFrame, value: str, by: Sequence[str] = (), cuts: Sequence[float] | None = None
) -> DataFrame:
    """Distinct values with ``n``, and ``n_before`` and ``n_total`` in value order.

    The counts are stored: the cuts split them evenly, and the window reads them.
    """
    rows = df.where(F.col(value).isNotNull())
    counts = durable(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")))
    cuts = cut_points(counts, value) if cuts is None else cuts
    return running_totals(with_value_bucket(counts, value, cuts), [value], {"n": F.col("n")}, by)


def quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name.

    One row per ``by`` group. Values are counted before they are ordered, so a
    frequent value costs one row, and no group is gathered in one task.
    """
    counted = value_counts_with_rank(df, value, by)
    last = F.col("n_before") + F.col("n")
    picks: list[Column] = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("n_total") - 1)
        x = F.col(value).cast("double")
        picks += [
            F.min(F.when(last > F.floor(position), x)).alias(f"{name}_low"),
            F.min(F.when(last > F.ceil(position), x)).alias(f"{name}_high"),
            F.max(position - F.floor(position)).alias(f"{name}_part"),
        ]
    picked = counted.groupBy(*by).agg(*picks)
    return picked.select(
        *by,
        *[
            (
                F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")
            ).alias(n)
            for n in probabilities
        ],
    )


def as_rows(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., variable, value) rows, one per column and row, without nulls."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(quoted(c)).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keep, F.inline(pairs)).where(F.col("value").isNotNull())


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles of several columns together: one row per column."""
    return quantiles(as_rows(df, columns), "value", probabilities, ["variable"])
