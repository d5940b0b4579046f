from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from stayrate.llm import vector_codes
from stayrate.llm.vector_codes import assign, compressed, planted, sums

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The same with plain loops over all parts and entries."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts))
    given = []
    for i, vector, label in kept:
        q = [math.floor(scale * float(np.float32(x))) for x in vector]
        q += [0] * (parts * width - len(q))
        given.append((i, [tuple(q[p * width : (p + 1) * width]) for p in range(parts)], label))
    first = sorted(given, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, cut, _ in given:
                groups[nearest(cut[p], books[p])[1]].append(cut[p])
            books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if groups[k] else e for k, e in enumerate(books[p])]
    coded, by_label = [], defaultdict(int)
    for i, cut, label in given:
        found = [nearest(cut[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        coded.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], digest) for i, code, error, label in coded]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def check(spark, rows, schema=SCHEMA, **options):
    more = schema.count(",") - 2
    df = compressed(spark.createDataFrame([(*r, *[None] * more) for r in rows], schema), **options)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(lloyd(rows, **options), key=key)


def some(n: int, width: int, seed: int, spread: float):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(20, width)) * 0.3
    return [(int(i), [float(x) for x in (centres[i % 20] + spread * pick.normal(size=width)).astype(np.float32)], int(i % 3)) for i in pick.permutation(n)]


@pytest.mark.parametrize(("n", "width", "spread"), [(300, 16, 0.01), (200, 64, 0.3), (40, 8, 0.0)])
def test_equals_plain_loops(spark, n, width, spread):
    check(spark, some(n, width, n, spread))


def test_other_parts_entries_and_rounds(spark):
    check(spark, some(150, 12, 4, 0.1), parts=3, entries=5, rounds=2, scale=100)


def test_unusable_rows_copies_ties_and_short_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(60, 16, 1, 0.2)
    rows += [(60, None, 1), (61, [0.0] * 15 + [None], 0), (62, [nan] * 16, 0), (63, [inf] + [0.0] * 15, 1), (64, [-inf] + [0.0] * 15, 1)]
    rows += [(70 + i, [0.25] * 16, None) for i in range(90)] + [(200, [0.5, 0.5], 2), (201, [], 2), (202, [0.1] * 11, None)]
    check(spark, rows)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(i % 7, [float(i % 5)] * 8, i % 2) for i in range(40)] + [(None, [0.5] * 8, 1)] * 3
    check(spark, rows, SCHEMA + ", id int, code string, error int, ids int, points int, part int, entry int, of int, most int")


def test_few_rows_and_none(spark):
    check(spark, [(3, [0.1] * 8, 1), (1, [0.1] * 8, None)])
    check(spark, [(3, [], 1)])
    check(spark, [])


def test_components_beyond_a_long_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        compressed(spark.createDataFrame([(1, [1e30], 1)], SCHEMA))


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CELLS", 64)
    check(spark, some(200, 16, 9, 0.05))


@pytest.mark.parametrize("spread", [0, 1, 30, 3000])
@pytest.mark.parametrize("n_entries", [1, 2, 5, 16])
def test_trees_assign_as_loops_do(spread, n_entries):
    pick = np.random.default_rng(spread * 100 + n_entries)
    centres = pick.integers(-500, 500, (6, 3))
    points = centres[pick.integers(0, 6, 700)] + pick.integers(-spread, spread + 1, (700, 3))
    entries = points[pick.integers(0, 700, n_entries)]
    entries[-1] = entries[0]  # equal entries: the first wins
    tree, order = planted(points, 16)
    gathered, counts, codes = assign(tree, sums(tree), entries)
    wanted = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert codes.tolist() == wanted[order].tolist()
    assert counts.tolist() == np.bincount(wanted, minlength=n_entries).tolist()
    assert gathered.tolist() == [points[wanted == k].sum(0).tolist() for k in range(n_entries)]


def test_whole_nodes_are_assigned_without_looking_at_their_parts():
    pick = np.random.default_rng(1)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    # Groups of equal size, so no leaf has parts of two of them.
    points = np.repeat(centres, 1024, axis=0) + pick.integers(-50, 51, (4096, 2))
    tree, _ = planted(points, 16)
    cached = sums(tree)
    expected = assign(tree, cached, centres)[0]
    tree.points = np.zeros_like(tree.points)  # only boxes and sums are left
    assert assign(tree, cached, centres)[0].tolist() == expected.tolist()
