"""Overview tables, histograms, densities, correlations and segments."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.operators import distribution, profile, segments
from tests.helpers import by_key

CLIENTS = "id string, churn int, seg string, gas string, x double, y double"
ROWS = [
    ("a", 0, "s", "t", 1.0, 2.0),
    ("b", 0, "s", "f", 3.0, None),
    ("c", 1, "r", "t", 5.0, 6.0),
    ("d", 0, None, None, None, 4.0),
]


@pytest.fixture(scope="module")
def clients(spark):
    return spark.createDataFrame(ROWS, CLIENTS)


@pytest.fixture(scope="module")
def sample():
    pick = random.Random(11)
    return [pick.gauss(3, 2) for _ in range(400)]


def test_overview(clients):
    row = profile.overview(clients, "client", "churn").first()
    assert tuple(row) == ("client", 4, 6, 4, 0.25)


def test_column_gaps(clients):
    rows = by_key(profile.column_gaps(clients), "column")
    assert {c: r["nulls"] for c, r in rows.items()} == {"id": 0, "churn": 0, "seg": 1, "gas": 1, "x": 1, "y": 1}


def test_class_share(clients):
    assert [tuple(r) for r in profile.class_share(clients, "churn").collect()] == [(0, 3, 75.0), (1, 1, 25.0)]


def test_group_means_skip_nulls(clients):
    rows = by_key(profile.group_means(clients, "churn", ["x", "y"]), "variable")
    assert (rows["x"]["retained"], rows["x"]["churned"]) == (2.0, 5.0)
    assert (rows["y"]["retained"], rows["y"]["churned"]) == (3.0, 6.0)


def test_rates_leave_null_values_out_and_sort(clients):
    found = profile.rate_by_descending(clients, "seg", "churn").collect()
    assert [(r["seg"], r["n"], r["label_rate"]) for r in found] == [("r", 1, 1.0), ("s", 2, 0.0)]
    assert len(profile.rate_by_descending(clients, "seg", "churn", top=1).collect()) == 1


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    rows = by_key(distribution.histogram(df, ["x"], bins=5), "bin")
    assert [rows[b]["n"] for b in range(1, 6)] == [2, 2, 2, 2, 3]
    assert [rows[b]["bin_start"] for b in range(1, 6)] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_histogram_equals_numpy_and_shares_edges(spark, sample):
    rows = [(i % 2, v) for i, v in enumerate(sample)] + [(0, None)]
    df = spark.createDataFrame(rows, "churn int, x double")
    found = by_key(distribution.histogram(df, ["x"], "churn", 50), "churn", "bin")
    edges = np.histogram_bin_edges(sample, 50)
    for label in (0, 1):
        counts, _ = np.histogram([v for k, v in rows if k == label and v is not None], edges)
        ours = [found[(label, b)]["n"] if (label, b) in found else 0 for b in range(1, 51)]
        assert ours == counts.tolist()


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    row = distribution.histogram(df, ["x"], bins=50).first()
    expected = int(np.nonzero(np.histogram([2.0, 2.0], 50)[0])[0][0]) + 1
    assert (row["bin"], row["n"]) == (expected, 2)


def test_auto_bins_equal_numpy(spark, sample):
    df = spark.createDataFrame([(v, 7.0) for v in sample], "x double, c double")
    rows = by_key(distribution.auto_bins(df, ["x", "c"]), "variable")
    assert rows["x"]["bins"] == len(np.histogram_bin_edges(sample, "auto")) - 1
    assert rows["c"]["bins"] == 1


def test_density_equals_direct_sum_and_integrates(spark, sample):
    df = spark.createDataFrame([(v,) for v in sample], "x double")
    rows = sorted(distribution.density(df, ["x"]).collect(), key=lambda r: r["point"])
    values = np.array(sample)
    width = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 200)
    direct = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(1)
    direct /= len(values) * width * np.sqrt(2 * np.pi)
    assert [r["x"] for r in rows] == pytest.approx(grid)
    assert [r["density"] for r in rows] == pytest.approx(direct)


def test_correlations(spark, sample):
    df = spark.createDataFrame([(v, -2 * v, v * v) for v in sample], "a double, b double, c double")
    rows = by_key(distribution.correlations(df, ["a", "b", "c"]), "column_a", "column_b")
    assert set(rows) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert rows[("a", "b")]["corr"] == pytest.approx(-1.0)
    assert rows[("a", "c")]["corr"] == pytest.approx(np.corrcoef(sample, np.square(sample))[0, 1])


def test_segment_rates_cut_at_terciles(spark):
    rows = [(float(i), 9 - i, int(i >= 6)) for i in range(9)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "x double, z int, churn int")
    found = by_key(segments.segment_rates(df, {"size": "x", "age": "z"}, "churn"), "dimension", "segment")
    assert {k: r["n"] for k, r in found.items()} == {(d, s): 3 for d in ("size", "age") for s in ("low", "middle", "high")}
    assert found[("size", "high")]["label_rate"] == 1.0
    assert found[("age", "low")]["label_rate"] == 1.0


def test_bill_burden(spark):
    clients = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "id string, churn int")
    bills = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 8.0)], "id string, bill double")
    rows = by_key(segments.bill_burden(clients, bills, "id", "churn", "bill"), "churn")
    assert (rows[0]["n"], rows[0]["mean_monthly_bill"]) == (1, 15.0)
    assert (rows[1]["n"], rows[1]["mean_monthly_bill"]) == (1, 8.0)


def test_rate_by_condition(clients):
    rows = by_key(segments.rate_by_condition(clients, F.col("x") > 2, "churn", "big"), "big")
    assert {k: (r["n"], r["label_rate"]) for k, r in rows.items()} == {0: (1, 0.0), 1: (2, 0.5)}


def test_at_risk(spark):
    rows = [("a", 1.0, 1, 0.0, 120.0), ("b", 2.0, 1, 9.0, 120.0), ("c", 9.0, 1, 4.0, 120.0), ("d", 8.0, 5, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id string, m double, t int, last double, year double")
    found = segments.at_risk(df, "id", "m", "t", "last", "year").collect()
    assert [tuple(r) for r in found] == [("c", 9.0, 1, 1)]


def test_a_constant_column_has_points_without_density(spark):
    rows = distribution.density(spark.createDataFrame([(2.0, 1.0), (2.0, 4.0)], "x double, y double"), ["x", "y"], 5)
    found = by_key(rows, "variable", "point")
    assert len(found) == 10 and found["x", 3]["x"] == 2.0 and found["x", 3]["density"] is None
    assert found["y", 3]["density"] > 0


def test_a_null_value_is_in_no_third(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    rows = segments.with_segments(df, {"size": "v"}).collect()
    assert [r["size"] for r in sorted(rows, key=lambda r: r["v"] or 9)] == ["low", "middle", "high", None]
