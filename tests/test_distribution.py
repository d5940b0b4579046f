"""Densities and correlations against the formulas worked out in full."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.operators import distribution
from tests.helpers import by_key, plan_of


def plain_density(values: list[float], points: int) -> list[tuple[float, float]]:
    n, lo, hi = len(values), min(values), max(values)
    h = float(np.std(values, ddof=1)) * n**-0.2
    grid = [lo + k * (hi - lo) / (points - 1) for k in range(points)]
    scale = n * h * math.sqrt(2 * math.pi)
    return [(x, sum(math.exp(-(((x - v) / h) ** 2) / 2) for v in values) / scale) for x in grid]


@pytest.mark.parametrize("points", [2, 50, 400])
def test_density_equals_the_full_sum(spark, points):
    pick = random.Random(5)
    columns = {
        "even": [pick.uniform(-3, 9) for _ in range(300)],
        "tied": [float(pick.randrange(4)) for _ in range(300)],
        # Far values leave most points without any value in reach.
        "far": [pick.gauss(0, 1) for _ in range(297)] + [1e4, 1e4 + 0.5, -3e3],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    found = by_key(distribution.density(df, list(columns), points), "variable", "point")
    assert len(found) == 3 * points
    for name, values in columns.items():
        top = max(d for _, d in plain_density(values, points))
        for k, (x, wanted) in enumerate(plain_density(values, points)):
            row = found[name, k]
            assert row["x"] == pytest.approx(x) and row["density"] == pytest.approx(wanted, rel=1e-6, abs=1e-9 * top)


def test_density_of_gaps_and_single_values(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (1.0, None, None), (1.0, 7.0, 3.0)], "a double, b double, c double")
    found = by_key(distribution.density(df, ["a", "b", "c"], 4), "variable", "point")
    assert {k[0] for k in found} == {"a", "b", "c"}
    assert {found["a", k]["x"] for k in range(4)} == {1.0} and found["a", 0]["density"] is None is found["b", 3]["density"]
    assert found["c", 0]["density"] == pytest.approx(plain_density([2.0, 3.0], 4)[0][1], rel=1e-6)


def test_values_are_summed_into_cells_before_points_are_made(spark):
    df = spark.range(1000).select(F.sqrt("id").alias("a"))
    plan = plan_of(distribution.density(df, ["a"], 5000)).lower()
    # The plan is printed from its end: kernel sums first, below them the points, below these the cells.
    kernels = plan[plan.index("exp(") :]
    assert kernels.index("generate explode(sequence(") < kernels.index("power(off")


def test_correlations_of_rows_that_have_both(spark):
    pick = random.Random(3)
    rows = []
    for _ in range(200):
        a = pick.gauss(1e6, 3)
        rows.append((a, -2 * a + pick.gauss(0, 2), pick.choice([None, pick.random()]), 5.0, pick.choice([None, 3.0]), None, pick.choice([0, 1])))
    names = ["a", "b", "gap", "same", "same_or_gap", "none", "flag"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'flag' else 'double'}" for c in names))
    found = by_key(distribution.correlations(df, names), "column_a", "column_b")
    assert len(found) == 21
    for i, x in enumerate(names):
        for j in range(i + 1, len(names)):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            varied = len(both) > 1 and all(len(set(side)) > 1 for side in zip(*both))
            wanted = np.corrcoef(np.array(both, float).T)[0, 1] if varied else None
            got = found[x, names[j]]["corr"]
            assert got is None if wanted is None else got == pytest.approx(wanted, abs=1e-7)


def test_correlations_of_few_rows_and_many_columns(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in distribution.correlations(one, ["a", "b"]).collect()] == [("a", "b", None)]
    assert distribution.correlations(one.limit(0), ["a", "b"]).first()["corr"] is None
    assert distribution.correlations(one, ["a"]).collect() == []
    wide = spark.range(50).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(97)).cast("double").alias(f"c{k}") for k in range(150)])
    values = np.array(wide.collect())
    found = by_key(distribution.correlations(wide, wide.columns), "column_a", "column_b")
    expected = np.corrcoef(values.T)
    assert len(found) == 150 * 149 // 2
    assert all(found[f"c{i}", f"c{j}"]["corr"] == pytest.approx(expected[i, j], abs=1e-9) for i in range(0, 150, 7) for j in range(i + 1, 150, 5))
