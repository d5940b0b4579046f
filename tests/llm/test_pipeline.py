from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stayrate.llm import pii
from stayrate.llm.catalog import QUERIES
from stayrate.llm.tables import read
from tests.llm.cases import CLASH, awkward, frame, words
from tests.llm.test_simhash import brute_components, brute_fingerprint

FOLDER = "/root/testdata/sf0.01"


def staged(spark, docs, folder):
    """The rows of every stage, each given what the one before has written."""
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, out[-1], folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns
            found = corpus_pipeline.durable(found)
        out.append(found)
    return [df.collect() for df in out[1:]]


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check(good, unequal, unlike, private, packed):
    """What each stage made of the one before, by brute force."""
    groups = defaultdict(list)
    for r in good:
        groups[bare(r.text)].append(r)
    stay = [min(rows, key=lambda r: (-len(r.text or ""), r.doc_id is not None, r.doc_id or 0)) for rows in groups.values()]
    assert sorted(unequal, key=str) == sorted(stay, key=str)

    rows = sorted(unequal, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    first = brute_components({i: brute_fingerprint(r.text) for i, r in enumerate(rows)})
    assert sorted(unlike, key=str) == sorted((r for i, r in enumerate(rows) if first[i] == i), key=str)

    assert len(private) == len(unlike) and sorted(str(r.doc_id) for r in private) == sorted(str(r.doc_id) for r in unlike)
    before = defaultdict(list)
    for r in unlike:
        before[r.doc_id].append(r.text)
    for r in private:
        assert not pii.base_spans(r.text or "")
        if not any(pii.proposals(t or "") or pii.base_spans(t or "") for t in before[r.doc_id]):
            assert r.text in before[r.doc_id]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts = [r.text or "" for r in private]
    ids = sorted([*x.ids, 0] for x in library.encode_batch_fast(texts, add_special_tokens=False))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    made = []
    for found in pieces.values():
        for r in sorted(found, key=lambda r: (r.piece, r.start)):
            own = np.frombuffer(bytes(r.ids), "<u2").tolist()
            assert len(own) == r.length <= 2048 and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
            made += [own] if r.piece == 0 else []
            if r.piece:
                assert len(made[-1]) == r.start
                made[-1] += own
    assert sorted(made) == ids
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.fixture(scope="module")
def stages(spark):
    return staged(spark, read(spark, FOLDER, "documents"), FOLDER)


def test_every_stage_equals_brute_force(spark, stages):
    given = read(spark, FOLDER, "documents").collect()
    accepted = {r.doc_id for r in QUERIES["op4_quality"](spark, FOLDER).collect() if r.predicted}
    assert sorted(stages[0], key=str) == sorted((r for r in given if r.doc_id in accepted), key=str)
    assert len(given) > len(stages[0]) > len(stages[1]) >= len(stages[2])
    check(*stages)


def test_run_gives_the_rows_of_its_stages(spark, stages):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids)
    assert sorted(map(key, rows)) == sorted(map(key, stages[-1]))


def test_awkward_rows_go_through_all_stages(spark):
    texts = awkward() + [None, "", words(5000, 1), "mail a@b.cd now " + words(30, 2)]
    docs = frame(spark, texts, CLASH)
    docs = docs.union(docs.where("doc_id % 3 = 0")).unionByName(docs.limit(4).withColumn("doc_id", docs["doc_id"] * None))
    out = staged(spark, docs, FOLDER)
    assert out[0]
    # Rows that repeat an id are told apart by their texts, so pieces need documents of one row.
    assert len({r.doc_id for r in out[3]}) == len(out[3])
    check(*out)


def test_an_empty_table_goes_through_all_stages(spark):
    assert staged(spark, frame(spark, [], CLASH), FOLDER) == [[], [], [], [], []]
