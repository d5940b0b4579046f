from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pytest

from stayrate.llm import quality
from tests.llm.cases import CLASH, awkward, frame, words


def held(i) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def made(n: int, seed: int = 0) -> list[tuple[str, int]]:
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(pick.randrange(5, 60), 10_000 * seed + i)
        kind = pick.choice(["good", "good", "shout", "marks", "again"])
        text = {"good": text, "shout": text.upper() + "!!", "marks": text.replace(" ", "$$$ "), "again": (text[:12] + " ") * 30}[kind]
        rows.append((text, int(kind == "good")))
    return rows


def scorer(model):
    """The score of one text."""
    score = model.scorer()
    return lambda text: score([text])[0]


@pytest.fixture(scope="module")
def model():
    return quality.fit(made(800, 1))


def test_accuracy_on_texts_not_seen(model):
    score = scorer(model)
    rows = made(400, 2)
    assert np.mean([(score(t) >= 0.5) == bool(y) for t, y in rows]) > 0.97


def test_accuracy_on_rows_held_out_from_the_given_tables():
    at = "/root/testdata/sf0.1"
    rows = duckdb.sql(
        f"SELECT d.doc_id, d.text, l.quality FROM '{at}/documents.parquet' d JOIN '{at}/labels.parquet' l USING (doc_id) ORDER BY 1"
    ).fetchall()
    score = scorer(quality.fit([(t, y) for i, t, y in rows if not held(i)][:2000]))
    rest = [(score(t) >= 0.5, bool(y)) for i, t, y in rows if held(i)]
    assert np.mean([a == b for a, b in rest]) > 0.97
    assert np.mean([a for a, b in rest if b]) > 0.98


def test_every_row_is_scored_by_its_text_alone(spark, model):
    texts = awkward()
    rows = quality.scored(frame(spark, texts, CLASH), model).collect()
    score = scorer(model)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert r.score == score(texts[r.doc_id] or "") and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id)
    assert quality.scored(frame(spark, []), model).collect() == []


def test_accepted_keeps_columns_and_order_of_scores(spark, model):
    docs = frame(spark, awkward() + [t for t, _ in made(40, 3)], CLASH)
    kept = quality.accepted(docs, model)
    assert kept.schema == docs.schema
    expected = {r.doc_id for r in quality.scored(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == expected
    assert 0 < len(expected) < docs.count()


def test_sample_is_bounded_and_leaves_held_out_and_contradicting_labels_alone(spark):
    docs = frame(spark, [words(5, i) for i in range(60)] + [words(900, 1)], CLASH)
    labels = [(i, i % 2) for i in range(61)] + [(3, 0), (4, None), (999, 1), (None, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.sample(docs, table, "quality", 1000, 2000)
    usable = [i for i in range(60) if not held(i) and i != 3]
    assert sorted(found) == sorted((words(5, i), i % 2) for i in usable)
    assert quality.sample(docs, table, "quality", 7, 2000) == found[:7]


def test_fit_without_both_classes():
    assert scorer(quality.fit([]))("a b") == 0.5
    assert scorer(quality.fit([("a b", 1)] * 8))("") == pytest.approx(0.9)


def test_words_side_by_side_have_the_weights_of_their_buckets():
    given = sorted({w for t in awkward() for w in (t or "").split()[:300]}) + ["a", "é", "日本", "😀" * 7, "x" * 300]
    weights = np.random.default_rng(2).integers(-99, 99, quality.Training().buckets).astype(np.float32)
    total, count = quality.gram_sums(given, weights, quality.Training())
    buckets = [quality.word_buckets(w, quality.Training()) for w in given]
    assert total.tolist() == [weights[b].sum() for b in buckets] and count.tolist() == list(map(len, buckets))
    assert buckets[given.index("a")][0] == zlib.crc32(b"wa") % quality.Training().buckets


def test_scores_are_those_of_the_formula(model):
    t = model.training
    for text in [words(40, 3), "a b a b a b " * 9, "", "é 日本 é", "one"]:
        own = text.split()
        buckets = [b for w in own for b in quality.word_buckets(w, t)]
        buckets += [b for b, n in zip(quality.echo_buckets(t), quality.echoes(own, t)) for _ in range(n)]
        mean = model.weights[buckets].astype(float).mean() if buckets else 0.0
        assert scorer(model)(text) == pytest.approx(1 / (1 + np.exp(-(model.bias + mean))), rel=1e-9)


def test_a_table_ingested_twice_gives_the_same_sample(spark):
    docs = frame(spark, [words(6, i) for i in range(90)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    once = quality.sample(docs, labels, "quality", 20, 2000)
    assert once == quality.sample(docs.union(docs), labels.union(labels), "quality", 20, 2000) and len(once) == 20
    # One id with two texts, and rows without an id.
    free = next(i for i in range(9) if not held(i))
    odd = spark.createDataFrame([(free, "a"), (free, "b"), (free, "a"), (None, "c")], "doc_id long, text string")
    found = quality.sample(odd, spark.createDataFrame([(free, 1), (None, 0)], "doc_id long, quality int"), "quality", 9, 99)
    assert sorted(found) == [("a", 1), ("b", 1)]
    assert quality.sample(docs.limit(0), labels, "quality", 9, 99) == [] == quality.sample(docs, labels.limit(0), "quality", 9, 99)
