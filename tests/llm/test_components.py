from __future__ import annotations

import random

from stayrate.llm.components import components


def brute(links):
    least = {n: n for pair in links for n in pair}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            m = min(least[u], least[v])
            changed |= least[u] != m or least[v] != m
            least[u] = least[v] = m
    return least


def test_components_of_chains_stars_and_random_links(spark):
    pick = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (8, 9), (8, 9)]
    links += [(pick.randrange(1000, 1200), pick.randrange(1000, 1200)) for _ in range(150)]
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    found = {r.node: r.component for r in rows}
    assert len(found) == len(rows)
    expected = brute([p for p in links if p[0] != p[1]])
    assert {n: found.get(n, n) for n in expected} == expected


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).collect() == []
