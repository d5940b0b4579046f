from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from stayrate.llm import sharding
from tests.llm.cases import CLASH, awkward, frame, words


def greedy(sizes, capacity):
    shards, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return None
        if s > room:
            shards, room = shards + 1, capacity
        room -= s
    return shards


def brute(texts, shards):
    """Shard of each text: large groups apart, the others cut at the least capacity."""
    size = Counter()
    for t in texts:
        size[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    total, apart = sum(size.values()), []
    for d, s in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        if len(apart) == shards - 1 or s * (shards - len(apart)) <= total:
            break
        apart.append(d)
        total -= s
    rest = sorted(set(size) - set(apart))
    left = shards - len(apart)
    low, high = 1, max(1, total)
    while low < high:
        middle = (low + high) // 2
        n = greedy([size[d] for d in rest], middle)
        low, high = (low, middle) if n and n <= left else (middle + 1, high)
    found, at, room = {d: shards - 1 - k for k, d in enumerate(apart)}, 0, low
    for d in rest:
        if size[d] > room:
            at, room = at + 1, low
        room -= size[d]
        found[d] = at
    return found


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_equal_brute_force(spark, monkeypatch, digits, shards):
    monkeypatch.setattr(sharding, "DIGITS", digits)
    pick = random.Random(shards)
    texts = [t for t in awkward() if len(t or "") < 30_000] + [words(pick.randrange(1, 80), pick.randrange(150)) for _ in range(300)]
    rows = sharding.sharded(frame(spark, texts, CLASH), shards).collect()
    expected = brute(texts, shards)
    slots = defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None)
        assert r["shard"] == expected[hashlib.sha256(text).hexdigest()]
        slots[r["shard"]].append(r.slot)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_group_of_a_third_leaves_the_others_even(spark):
    texts = ["copy " * 40] * 200 + [words(25, i) for i in range(400)]
    sizes = Counter()
    for r in sharding.sharded(frame(spark, texts), 8).collect():
        sizes[r["shard"]] += r.size
    even = sorted(sizes.values())[:-1]
    assert len(sizes) == 8 and even[-1] - even[0] < 0.15 * even[-1]


def test_runs_number_a_shard_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = sharding.sharded(frame(spark, [words(3, i % 50) for i in range(200)]), 3).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(frame(spark, [])).collect() == []
