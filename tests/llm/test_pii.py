from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayrate.llm import pii
from stayrate.llm.trees import boost
from tests.llm.cases import CLASH, awkward, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "write a.b%c@x.y.zz, or @ no@host, x@a.b@c.d", "1.2.3.4 256.1.1.1 01.002.3.255 1.2.3.4.5.6.7.8 1.2.3 999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111 5", "+1 (171) 555-2028, +49.30.1234567. +1 ((( +12345678 9012345678",
    "a.b@c.d+1 171 555 2028", "+4111 1111 1111 1111", "٣٣٣٣ ٤٤٤٤ 1۲3", "..@..a.b %@a-.-b", "a@b.c.d.@e.f", "x" * 3000 + "@" + "y" * 3000 + ".z",
    "1" * 5000, "1." * 2000, "+1" + "-" * 3000, "@" * 2000,
]


def brute(text: str) -> list[tuple[str, int, int]]:
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and not all(int(p) <= 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((kind, m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@pytest.fixture(scope="module")
def model():
    return pii.fit()


@pytest.mark.parametrize("text", TEXTS + [t or "" for t in awkward() if len(t or "") < 5000])
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("a1294.+-@ ()%0\n٣")), max_size=50))
def test_base_spans_equal_the_patterns_on_any_text(text):
    assert pii.base_spans(text) == brute(text)


def test_held_out_precision_and_recall(model):
    rows = pii.examples(pii.Training(seed=3))
    chances = model.trees.probability(np.array([pii.features(t, s) for t, s, _ in rows], float))
    taken = np.array([c >= model.thresholds[s[0]] for c, (_, s, _) in zip(chances, rows)])
    truth = np.array([bool(y) for *_, y in rows])
    assert truth[taken].mean() > 0.95 and taken[truth].mean() > 0.9


def test_spans_beyond_the_base(model):
    def added(text):
        base, every = model.spans(text)
        assert set(base) <= set(every)
        return [(k, text[s:e]) for k, s, e in every if (k, s, e) not in base]

    assert added('la token = "4d44c79e8bf7c557aa01bb02cc03dd04ee05ff06" on') == [("secret", "4d44c79e8bf7c557aa01bb02cc03dd04ee05ff06")]
    assert added("call (171) 555-2028 now") == [("phone", "(171) 555-2028")]
    assert added("ann.lee [at] mail.org") == [("email", "ann.lee [at] mail.org")]
    for clean in ("released 2021-03-11 as version 3.11.2", "the order 83749283 of page 1234567", "a plain line of words", "commit 4d44c79e8bf7c557aa01bb02cc03dd04ee05ff06"):
        assert added(clean) == []


def test_query_equals_brute_force_on_all_cases(spark, model):
    texts = awkward() + TEXTS
    for r in pii.found(frame(spark, texts, CLASH), model).collect():
        base = brute(texts[r.doc_id] or "")
        kinds = [k for k, _, _ in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(r.spans.split(","))
    assert pii.found(frame(spark, []), model).collect() == []


def test_redacted_tables(spark, model):
    texts = ["mail a@b.cd or +1 (171) 555-2028.", None, "", "+4111 1111 1111 1111", "clean"]
    docs = frame(spark, texts, CLASH)
    out = pii.redacted(docs, model)
    assert out.schema == docs.schema
    rows = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert rows[0] == ("mail [EMAIL] or [PHONE].", 24)
    assert rows[1] == (None, None) and rows[2] == ("", 0) and rows[4] == ("clean", 5)
    assert rows[3][0] in ("[CARD]", "+[CARD]", "[PHONE]")


def test_trees_learn_an_interaction():
    x = np.random.default_rng(1).uniform(-1, 1, (2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((boost(x[:1500], y[:1500]).probability(x[1500:]) >= 0.5) == y[1500:].astype(bool)).mean() > 0.9


@pytest.mark.parametrize("size", [40, 256, 257, 300, 1000, 20_000])
def test_long_secrets_are_redacted(model, size):
    pick = np.random.default_rng(size)
    key = "".join(pick.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), size))
    text = f'the token = "{key}" is theirs'
    assert pii.redact(text, model.spans(text)[1]) == 'the token = "[SECRET]" is theirs'
    mail = f"{key} [at] {key}.org"
    assert ("email", 6, 6 + len(mail)) in pii.proposals(f"reach {mail} now")


def test_long_runs_take_linear_time(model):
    for text in ("a1" * 500_000, "1" * 1_000_000, "1 2." * 250_000, "a1-" * 300_000 + " [at] b", "x@" * 300_000):
        began = time.perf_counter()
        model.spans(text)
        assert time.perf_counter() - began < 20
