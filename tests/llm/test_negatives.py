from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.llm import negatives
from stayrate.llm.negatives import Residues, best, mined, primes_for, products

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, is_anchor, scale=256, positives=5, negatives_=3):
    """The same by comparing every pair of rows."""
    kept = []
    for place, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, [math.floor(scale * float(np.float32(x))) for x in vector], label, place))
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, own, label, place in kept:
        if i is None or not is_anchor(i):
            continue
        others = [(sum(a * b for a, b in zip(own, v)), j, k) for j, v, k, p in kept if p != place]
        same = sorted((x for x in others if x[2] == label), key=first)[:positives]
        for score, j, _ in same:
            inside = sorted((x for x in others if x[2] != label and 50 * score <= 100 * x[0] <= 95 * score), key=first)[:negatives_]
            out += [(i, j, r, k, score, s) for r, (s, k, _) in enumerate(inside, 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def result(spark, rows, schema=SCHEMA, every=5, **options):
    df = mined(spark.createDataFrame(rows, schema), F.col("vec_id") % every == 0, **options)
    return sorted((tuple(r)[:6] for r in df.collect()), key=key)


def some(n: int, width: int, seed: int, labels: int = 4, scale: float = 1.0):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(labels, width))
    found = []
    for i in range(n):
        label = int(pick.integers(labels))
        vector = (centres[label] * pick.uniform(0, 2) + pick.normal(size=width)) * scale
        found.append((i, [float(x) for x in vector.astype(np.float32)], label))
    return found


@pytest.mark.parametrize(("n", "width", "scale"), [(120, 5, 0.1), (90, 70, 1.0), (60, 64, 200.0)])
def test_equals_brute_force(spark, n, width, scale):
    rows = some(n, width, n, scale=scale)
    rows += [(n + i, rows[i][1], rows[i + 1][2]) for i in range(30)]  # equal vectors under other labels
    assert result(spark, rows) == sorted(expected(rows, lambda i: i % 5 == 0), key=key)


@pytest.mark.parametrize(("rows_a_cell", "anchors_a_cell", "held"), [(7, 3, 2), (1000, 2, 1)])
def test_cells_of_any_size(spark, monkeypatch, rows_a_cell, anchors_a_cell, held):
    rows = some(80, 6, 3)
    for name, value in (("ROWS", rows_a_cell), ("ANCHORS", anchors_a_cell), ("HELD", held)):
        monkeypatch.setattr(negatives, name, value)
    assert result(spark, rows) == sorted(expected(rows, lambda i: i % 5 == 0), key=key)


def test_unusable_rows_ties_and_copies(spark):
    inf, nan = float("inf"), float("nan")
    rows = some(40, 4, 7, labels=2)
    rows += [(40, None, 1), (45, [1.0, None, 0.0, 1.0], 1), (50, [nan, 0.0, 0.0, 0.0], 0), (55, [inf, 1.0, 1.0, 1.0], 1)]
    rows += [(60, [0.1, 0.2, 0.3, 0.4], None), (65, [-inf, 0.0, 0.0, 0.0], 0)]
    # A hot group of copies under two labels, so scores tie, and a shorter vector.
    rows += [(70 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(30)]
    rows += [(120 + i, [0.3, 0.3, 0.4, 0.4], i % 2) for i in range(30)] + [(200, [0.9], 1), (201, [], 0)]
    assert result(spark, rows) == sorted(expected(rows, lambda i: i % 5 == 0), key=key)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (None, [0.9, 0.0], 1), (None, [0.8, 0.1], 2), (3, [0.8, 0.2], 2), (4, [0.0, 1.0], 2)]
    schema = SCHEMA + ", row string, id int, score int, anchor int, rank int, of int, asks int, place int"
    found = mined(spark.createDataFrame([(*r, *[None] * 8) for r in rows], schema), F.col("vec_id") % 5 == 0).collect()
    # Two anchors of one id, each with the other and the row without an id as positives.
    assert len({r.anchor_row for r in found}) == 2 and {r.anchor_id for r in found} == {0}
    assert {r.positive_id for r in found} == {0, None}
    assert {(r.rank, r.negative_id) for r in found if r.positive_id == 0} == {(1, 3), (2, None)}
    assert all(r.anchor_row != r.positive_row for r in found)


def test_empty_tables_and_tables_without_anchors(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert result(spark, [(5, [1.0], 1)]) == []
    assert result(spark, [(5, [], 1), (6, [], 1), (7, [], 2)]) == [(5, 6, 1, 7, 0, 0)]


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        result(spark, [(5, [1e30], 1), (6, [1e30], 1)])


def test_products_are_exact():
    pick = np.random.default_rng(0)
    for width, most in ((1, 3), (64, 256), (200, 1 << 12), (64, 1 << 22)):
        a, b = (pick.integers(-most, most + 1, (9, width)) for _ in range(2))
        a[0], b[0], b[1] = most, most, -most
        primes = primes_for(width * most * most)
        found = products(Residues(a, primes), Residues(b, primes))
        assert found.tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]


def test_primes_are_odd_prime_and_enough():
    primes = primes_for(negatives.BOUND)
    assert primes[:3] == [1021, 1019, 1013] and math.prod(primes) > 2 * negatives.BOUND
    assert math.prod(primes) < 1 << 62 and primes_for(509) == [1021]
    assert all(negatives.COLUMNS * (p // 2) ** 2 < 1 << 24 for p in primes)


def test_best_takes_the_leftmost_of_equal_scores():
    scores = np.array([[3, 5, 5, 1, 5], [0, 0, 0, 0, 0]])
    assert best(scores, 2).tolist() == [[1, 2], [0, 1]]
    assert best(scores, 5).tolist() == [[1, 2, 4, 0, 3], [0, 1, 2, 3, 4]]
