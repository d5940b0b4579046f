from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrate.llm import rules
from tests.llm.cases import CLASH, awkward, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str):
    parts = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    duplicates = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 2000 else len(lines) - len(set(lines))
    windows: dict[tuple, list[int]] = {}
    for i in range(len(parts) - 7):
        windows.setdefault(tuple(parts[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(parts)
    return n, sum(map(len, parts)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered), n < 20 or 100 * len(covered) > 30 * n


def prose(seed: int) -> str:
    return "\n".join(words(random.Random(seed + i).randrange(15, 40), seed + i).capitalize() + "." for i in range(6))


def menu(seed: int) -> str:
    return "\n".join(" | ".join(words(2, seed + i).split()).upper() + " ***" for i in range(9))


@pytest.fixture(scope="module")
def chain():
    return rules.fit([(prose(100 * i), 1) for i in range(60)] + [(menu(100 * i), 0) for i in range(60)])


@pytest.mark.parametrize("text", [t or "" for t in awkward()] + ["a b c d e f g h " * 5, "x " * 40, "l\nl\nl \n\n\n", "a\x85b\x1cc d"])
def test_measures_equal_brute_force(text):
    assert rules.measures(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "\n", " ", "é$", "\x1c", "|"]), max_size=120))
def test_measures_equal_brute_force_on_any_text(parts):
    text = " ".join(parts)
    assert rules.measures(text) == brute(text)


def test_viterbi_finds_the_best_of_all_sequences():
    pick = np.random.default_rng(5)
    for _ in range(20):
        chain = rules.Chain(pick.normal(size=(2, rules.WIDTH)), pick.normal(size=(2, 2)))
        features = [list(map(int, pick.choice(rules.WIDTH, 4, replace=False))) for _ in range(7)]

        def score(states):
            total = sum(chain.emit[s, f].sum() for s, f in zip(states, features))
            return total + sum(chain.step[a, b] for a, b in zip(states, states[1:]))

        best = max(itertools.product((0, 1), repeat=7), key=score)
        assert score(chain.viterbi(features)) == pytest.approx(score(best))
    assert rules.Chain(np.zeros((2, rules.WIDTH)), np.zeros((2, 2))).viterbi([]) == []


def test_gradient_follows_the_likelihood():
    pick = np.random.default_rng(2)
    features = [list(map(int, pick.choice(rules.WIDTH, 3, replace=False))) for _ in range(4)]
    states = np.array([1, 0, 0, 1])

    def likelihood(emit, step):
        def score(s):
            return sum(emit[a, f].sum() for a, f in zip(s, features)) + sum(step[a, b] for a, b in zip(s, s[1:]))

        return score(states) - np.log(sum(np.exp(score(s)) for s in itertools.product((0, 1), repeat=4)))

    emit, step = pick.normal(size=(2, rules.WIDTH)), pick.normal(size=(2, 2))
    moved = emit.copy(), step.copy()
    rules._learn(*moved, features, states, 1e-5, 0.0)
    at = features[1][0]
    more = emit.copy()
    more[0, at] += 1e-5
    assert (moved[0] - emit)[0, at] == pytest.approx(likelihood(more, step) - likelihood(emit, step), abs=1e-9)
    more = step.copy()
    more[1, 0] += 1e-5
    assert (moved[1] - step)[1, 0] * 4 == pytest.approx(likelihood(emit, more) - likelihood(emit, step), abs=1e-9)


def test_content_share_tells_prose_from_menus(chain):
    good, bad = [prose(9000 + 50 * i) for i in range(20)], [menu(9000 + 50 * i) for i in range(20)]
    assert all(rules.content_share(t, chain) > 0.8 for t in good)
    assert all(rules.content_share(t, chain) < 0.2 for t in bad)
    assert 0.3 < rules.content_share(good[0] + "\n" + bad[0], chain) < 1
    assert rules.content_share("", chain) == 0


def test_query_on_all_cases(spark, chain):
    texts = awkward() + [prose(1), menu(1)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = {r.doc_id: r for r in rules.judged(frame(spark, texts, CLASH), chain).collect()}
    for i, text in enumerate(texts):
        assert tuple(rows[i][n] for n in names) == brute(text or "")
        assert rows[i].kept == (not rows[i].base_failed and rules.content_share(text or "", chain) >= 0.5)
    assert rows[len(texts) - 2].kept and not rows[len(texts) - 1].kept
    assert rules.judged(frame(spark, []), chain).collect() == []


def test_without_labels_every_line_is_content():
    assert rules.content_share(menu(3), rules.fit([])) == 1
