from __future__ import annotations

import hashlib
import random
import re

import pytest

from stayrate.llm.decontamination import WORD_PATTERN, Automaton, clean, counted, found, merged
from tests.llm.cases import CLASH, awkward, frame, words

WORD = re.compile(WORD_PATTERN)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def expected(text: str | None, items: list[tuple[int | None, str | None]], window: int = 10):
    """n_words, hit words and names by comparing every run of words."""
    own = WORD.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for name, item in items:
        given = WORD.findall((item or "").translate(LOWER))
        for at in range(max(1, len(given) - window + 1) if given else 0):
            sought = given[at : at + window]
            for start in range(len(own) - len(sought) + 1):
                if own[start : start + len(sought)] == sought:
                    hit.update(range(start, start + len(sought)))
                    names.add("" if name is None else str(name))
    return len(own), hit, sorted(names)


def check(rows, texts, items, window=10):
    for row, text in zip(sorted(rows, key=lambda r: r.doc_id), texts):
        n, hit, names = expected(text, items, window)
        assert row.n_words == n
        assert sorted(w for h in row.hits for w in range(h.first, h.last)) == sorted(hit)
        assert sorted(row.names) == names
        ends = [h.last for h in row.hits]
        assert all(a < h.first for a, h in zip(ends, row.hits[1:]))  # apart from each other
        for h in row.hits:
            said = WORD.findall(text.translate(LOWER))[h.first : h.last]
            assert WORD.findall(text[h.start : h.end].translate(LOWER)) == said
            assert WORD.match(text[h.start].translate(LOWER)) and WORD.match(text[h.end - 1].translate(LOWER))


def some(seed: int, n: int) -> list[str]:
    """Texts over few words, so that many windows recur; words are parted by all sorts of signs."""
    pick = random.Random(seed)
    parts = [" ", ", ", "\n", "-", "'", " ... ", "_"]
    vocabulary = ["a", "B", "c1", "été", "É", "日本", "😀", "Zz"]
    return ["".join(pick.choice(vocabulary) + pick.choice(parts) for _ in range(pick.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("window", [1, 3, 10])
@pytest.mark.parametrize("most", [1 << 21, 60])
def test_equals_brute_force(spark, window, most):
    texts = [*some(1, 60), None, "", " ,;"]
    items = [*enumerate(some(2, 12)), (3, "other B text of the same name"), (None, "b c1"), (90, None), (91, "--"), (92, "é"), (92, "é")]
    # A passage of an item inside a text, other signs between the words.
    texts.append("x " + ", ".join(WORD.findall(items[0][1]))[:400].upper().replace("É", "é") + " y")
    rows = found(frame(spark, texts), spark.createDataFrame(items, ITEMS), window, most=most).collect()
    assert len(rows) == len(texts)
    check(rows, texts, items, window)


def test_awkward_texts(spark):
    texts = awkward()
    items = [(7, words(60, 1)), (8, words(30_000, 5)[2000:90_000]), (9, "a b c"), (10, "日本語" * 4000), (11, None), (None, "")]
    docs = frame(spark, texts, CLASH)
    rows = counted(docs, spark.createDataFrame([(*x, 1) for x in items], ITEMS + ", n_words int")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        own = WORD.findall((texts[row.doc_id] or "").translate(LOWER))
        assert row.n_words == len(own)
        assert row.contaminated == (row.n_hit > 0) == (row.n_items > 0)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_hit == by_id[5].n_hit == by_id[6].n_hit == by_id[4].n_words and by_id[9].n_hit > 9
    assert by_id[4].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert by_id[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[20].n_hit == by_id[21].n_hit == 3
    assert by_id[14].n_hit == 1 and by_id[15].n_hit == 0


def test_names_sort_as_text_and_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (1, "three")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "one"), (9, "two"), (10, "two"), (10, "two")], ITEMS)
    rows = counted(docs, items).collect()
    assert sorted((r.doc_id or -1, r.n_hit, r.n_items) for r in rows) == [(-1, 2, 2), (1, 0, 0), (1, 2, 2), (1, 2, 2)]
    assert {r.items_sha256 for r in rows if r.n_hit} == {hashlib.sha256(b"10,9").hexdigest()}
    left = clean(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "three")]
    # Many passes tell the rows of one id apart.
    assert sorted(r.n_hit for r in counted(docs, items, most=1).collect()) == [0, 2, 2, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], ITEMS)
    some_items = spark.createDataFrame([(1, "a")], ITEMS)
    assert counted(none, some_items).collect() == [] == clean(none, no_items).collect()
    row = counted(frame(spark, ["a b"]), no_items).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


def test_long_items_are_cut_without_losing_a_window(spark):
    long = words(9000, 8)
    own = long.split()
    texts = [" ".join(own[a : a + 10]) for a in range(4080, 4110)] + [" ".join(own[a : a + 9]) for a in (0, 4096)]
    rows = {r.doc_id: r for r in counted(frame(spark, texts), spark.createDataFrame([(1, long)], ITEMS)).collect()}
    assert all(rows[i].contaminated for i in range(30)) and not rows[30].contaminated and not rows[31].contaminated


def test_runs_and_an_automaton_without_items():
    assert merged([(3, 5), (0, 2), (5, 9), (4, 6)]) == [(0, 2), (3, 9)]
    assert merged([(0, 2, 0, 7), (1, 4, 3, 20)]) == [(0, 4, 0, 20)]
    assert Automaton([]).scan(b"A b") == (2, [], [])
