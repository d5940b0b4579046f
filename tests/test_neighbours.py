"""Nearest rows against brute force, and blocks that no group of equal rows outgrows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.operators import neighbours, split

NAMES = [f"x{i}" for i in range(8)]


def table(spark, n, equal=0, seed=3):
    """Rows about a few centres; the first ``equal`` ones are all alike."""
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 3) for _ in NAMES] for _ in range(12)]
    rows = []
    for i in range(n):
        centre = centres[0] if i < equal else pick.choice(centres)
        rows.append((f"c{i:05d}", *[c if i < equal else pick.gauss(c, 1) for c in centre]))
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"{x} double" for x in NAMES))


def found(df, **how):
    near = neighbours.nearest(df, "id", NAMES, split.text_hash("id"), split.HASH_RANGE, **how)
    lists = {}
    for r in near.collect():
        lists.setdefault(r["id"], {})[r["rank"]] = (r["distance"], r["neighbour"])
    assert all(sorted(of) == list(range(1, len(of) + 1)) for of in lists.values())
    return {i: [of[k] for k in sorted(of)] for i, of in lists.items()}


def brute(df, k=5):
    rows = df.select("id", split.text_hash("id").alias("h"), neighbours.standard_steps(df, NAMES).alias("v")).collect()
    v = np.array([r["v"] for r in rows], dtype=np.int64)
    lists = {}
    for i, r in enumerate(rows):
        far = ((v - v[i]) ** 2).sum(axis=1).tolist()
        others = sorted((far[j], o["h"], o["id"]) for j, o in enumerate(rows) if j != i)[:k]
        lists[r["id"]] = [(d, o) for d, _, o in others]
    return lists


def test_rows_of_one_block_have_their_true_neighbours(spark):
    df = table(spark, 200, equal=70)
    assert found(df) == brute(df)


def test_recall_over_many_blocks_with_a_third_of_all_rows_alike(spark):
    df = table(spark, 1500, equal=500)
    near, true = found(df, block=64), brute(df)
    assert set(near) == set(true) and all(len(of) == 5 for of in near.values())
    # Rows that are alike have many true neighbours at distance 0: distances tell, not ids.
    hits = sum(a[0] <= b[0] for i in true for a, b in zip(near[i], true[i]))
    assert hits >= 0.9 * 5 * len(true)


def test_no_block_is_larger_than_asked_for(spark, monkeypatch):
    df = table(spark, 1000, equal=900)
    sizes = spark.sparkContext.accumulator(0)
    whole = neighbours._compared

    def watched(k):
        compare = whole(k)

        def block(rows):
            if len(rows) > 50:
                sizes.add(1)
            return compare(rows)

        return block

    monkeypatch.setattr(neighbours, "_compared", watched)
    assert len(found(df, block=50, tables=4)) == 1000
    assert sizes.value == 0


@pytest.mark.parametrize("n, each", [(0, 0), (1, 0), (2, 1), (4, 3)])
def test_fewer_rows_than_neighbours(spark, n, each):
    near = found(table(spark, n))
    assert len(near) == (n if each else 0)
    assert all(len(of) == each for of in near.values())


def test_features_that_do_not_vary_and_odd_names(spark):
    df = table(spark, 30).withColumn("a.b c", F.lit(2.0)).withColumn("block", F.lit(1))
    near = neighbours.nearest(df, "id", [*NAMES, "a.b c", "block"], split.text_hash("id"), split.HASH_RANGE)
    assert sorted(tuple(r) for r in near.collect()) == sorted(
        (i, k + 1, o, d) for i, of in brute(df).items() for k, (d, o) in enumerate(of)
    )
