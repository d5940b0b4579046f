from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from stayrate.llm import packing
from tests.llm.cases import frame, words


def test_the_last_stage_gives_the_token_ids_of_the_sequences(spark):
    docs = frame(spark, [words(80, s) for s in range(6)] + [words(3000, 7), None])
    packed = corpus_pipeline.sequences(spark, docs, "").cache()
    rows = packed.collect()
    assert {r.doc_id for r in rows} == set(range(8))
    ids = {(r.doc_id, r.piece): np.frombuffer(bytes(r.ids), "<u2").tolist() for r in rows}
    for r in rows:
        own = ids[r.doc_id, r.piece]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    made = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(made[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id, r.piece] for r in rows)
    assert packing.sequences(packed.limit(0)).collect() == []


def test_ids_take_two_bytes_where_the_vocabulary_allows():
    assert packing.id_type(public_tokenizers.path("word_bpe_49k.json")) == "<u2"
