"""Running totals, ranks and quantiles against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.operators import ordered
from tests.helpers import by_key, plan_of


@pytest.fixture(scope="module")
def numbers():
    """Values with ties, one value holding a third of all rows, in two groups."""
    pick = random.Random(7)
    rows = [("a", 0.125)] * 200 + [("a", round(pick.gauss(0, 1), 2)) for _ in range(300)]
    return rows + [("b", round(pick.random(), 3)) for _ in range(101)]


@pytest.fixture(scope="module")
def df(spark, numbers):
    return spark.createDataFrame(numbers, "g string, x double").repartition(5)


@pytest.mark.parametrize("cuts", [[], [0.125], [-0.5, 0.0, 0.125, 0.5], None])
def test_running_counts_do_not_depend_on_the_cuts(df, numbers, cuts):
    rows = by_key(ordered.value_counts_with_rank(df, "x", ["g"], cuts), "g", "x")
    for (g, x), row in rows.items():
        group = [v for k, v in numbers if k == g]
        assert row["n"] == group.count(x)
        assert row["n_before"] == sum(v < x for v in group)
        assert row["n_total"] == len(group)


def test_running_totals_descending(df, numbers):
    counts = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    bucketed = ordered.with_value_bucket(counts, "x", [0.0, 0.3])
    found = ordered.running_totals(bucketed, ["x"], {"n": F.col("n")}, descending=True)
    for row in found.collect():
        assert row["n_before"] == sum(v > row["x"] for _, v in numbers)


def test_cut_points_spread_the_rows(df):
    cuts = ordered.cut_points(df, "x", 16)
    assert cuts == sorted(set(cuts)) and 8 <= len(cuts) < 16


@pytest.mark.parametrize("p", [0.0, 0.1, 1 / 3, 0.5, 0.75, 1.0])
def test_quantiles_equal_numpy(df, numbers, p):
    rows = by_key(ordered.quantiles(df, "x", {"q": p}, ["g"]), "g")
    for g in ("a", "b"):
        assert rows[g]["q"] == pytest.approx(np.quantile([v for k, v in numbers if k == g], p))


def test_quantiles_skip_nulls_and_several_columns_go_together(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, 20), (None, 60), (4.0, 70)], "x double, y int")
    rows = by_key(ordered.column_quantiles(df, ["x", "y"], {"m": 0.5}), "variable")
    assert rows["x"]["m"] == 2.0 and rows["y"]["m"] == 40.0


def test_ranks_are_one_to_n_in_each_group(spark):
    df = spark.range(1000).select(
        "id", (F.col("id") % 10 == 0).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(512)).alias("h")
    )
    found = ordered.ranks(df, ["g"], "h", "id", 512, buckets=16).collect()
    for g in (0, 1):
        rows = sorted((r for r in found if r["g"] == g), key=lambda r: (r["h"], r["id"]))
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert {r["group_size"] for r in rows} == {len(rows)}


def test_rows_are_never_ordered_in_a_single_partition(df):
    plan = plan_of(ordered.value_counts_with_rank(df, "x"))
    # The only window without partitions runs over one row per bucket.
    assert plan.count("Exchange SinglePartition") <= 1
    assert "Window [sum(n#" in plan and "_bucket" in plan


def test_buckets_stay_even_when_one_value_fills_nearly_all_rows(spark):
    """Each bucket is one task of the window, and should hold no more than twice the mean."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 200 > 0, 0.0).otherwise(F.sqrt(F.col("id").cast("double"))).alias("x")
    )
    found = ordered.value_counts_with_rank(rows, "x").groupBy(ordered.BUCKET).count()
    sizes = [r["count"] for r in found.collect()]
    assert len(sizes) > 100 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_rows_that_share_a_value_are_spread_by_their_hash(spark):
    rows = spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 10 > 0, 0.5).otherwise(F.col("id") / 20_000).alias("x"),
        F.pmod(F.xxhash64("id"), F.lit(2**32)).alias("h"),
    )
    bucketed = ordered.with_even_bucket(rows, "x", "h", 2**32, 64)
    sizes = [r["count"] for r in bucketed.groupBy(ordered.BUCKET).count().collect()]
    assert max(sizes) <= 2 * 20_000 / 64
    found = ordered.running_totals(bucketed, ["x", "h", "id"], {"n": F.lit(1)}).collect()
    in_order = sorted(found, key=lambda r: (r["x"], r["h"], r["id"]))
    assert [r["n_before"] for r in in_order] == list(range(20_000))
