from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stayrate.llm import packing
from tests.llm.cases import CLASH, awkward, frame, words
from tests.llm.test_bpe import MORE

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text: str) -> list[int]:
    return np.frombuffer(next(packing.encode_all([text], packing.encoder(PATH))), "<u4").tolist()


def library_ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_each_character_is_encoded_as_in_the_library():
    for first in range(1, 0x3000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)} word{chr(c)}, É{chr(c)}.\n" for c in range(first, first + 64))
        assert ids_of(text) == library_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("abS 'st\n\té7,.$<|>\xa0\x1c日́Σ")), max_size=60))
def test_any_text_is_encoded_as_in_the_library(text):
    assert ids_of(text) == library_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_leaves_the_least_room(sizes):
    bins, offsets, used = packing.best_fit(sizes, 50)
    level: list[int] = []
    for size, at, offset in zip(sizes, bins, offsets):
        fitting = [u for u in level if u + size <= 50]
        if at == len(level):
            assert not fitting
            level.append(0)
        else:
            assert level[at] == max(fitting)
        assert offset == level[at]
        level[at] += size
    assert level == used


def test_looking_up_many_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(packing, "_STEP", 50)
    texts = [t or "" for t in awkward()] + MORE + [words(30, i) for i in range(40)]
    encoder = packing.encoder(PATH)
    monkeypatch.setattr(encoder, "size", 100)
    found = [np.frombuffer(b, "<u4").tolist() for b in packing.encode_all(texts, encoder)]
    assert found == [library_ids(t) for t in texts]


def holds(rows, texts, limit=packing.LIMIT):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = [*library_ids(text or ""), 0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [(r.start, r.length) for r in mine] == [(s, len(ids[s : s + limit])) for s in range(0, len(ids), limit)]
        assert [r.ids_crc32 for r in mine] == [
            zlib.crc32(np.array(ids[s : s + limit], "<u4").tobytes()) for s in range(0, len(ids), limit)
        ]
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= limit
    return len(by_sequence), sum(r.length for r in rows)


def test_query_cuts_and_packs_whole_texts(spark):
    texts = awkward() + MORE + [words(n, n) for n in range(20, 900, 11)]
    n, tokens = holds(packing.packed(frame(spark, texts, CLASH), PATH).collect(), texts)
    assert n <= 1.02 * -(-tokens // packing.LIMIT) + 1
    assert packing.packed(frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("group", [10, 100, 5000])
def test_rounds_place_every_item_once_with_little_waste(spark, group):
    pick = random.Random(4)
    sizes = [pick.choice([1, 7, pick.randrange(1, 2048), pick.randrange(1, 600)]) for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    rows = packing.pack(items, group=group).collect()
    assert sorted(r.item for r in rows) == list(range(1500))
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append((r.offset, sizes[r.item]))
    for placed in bins.values():
        end = 0
        for offset, size in sorted(placed):
            assert offset == end
            end += size
        assert end <= 2048
    assert len(bins) <= (1.25 if group == 10 else 1.03) * sum(sizes) / 2048 + 1


def test_items_that_never_fit_together_end_the_rounds(spark):
    items = spark.range(300).selectExpr("id as item", "cast(1500 as long) as size")
    assert packing.pack(items, group=20).select("bin").distinct().count() == 300


def test_sequences_hold_the_ids(spark):
    texts = [words(700, 1), "a b", None, words(30, 2)]
    rows = packing.packed(frame(spark, texts), PATH, limit=256, with_ids=True)
    total = [i for t in texts for i in [*library_ids(t or ""), 0]]
    held = [i for r in packing.sequences(rows).collect() for i in r.ids]
    assert sorted(held) == sorted(total)
    assert max(len(r.ids) for r in packing.sequences(rows).collect()) <= 256
