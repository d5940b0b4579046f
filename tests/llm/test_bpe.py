from __future__ import annotations

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stayrate.llm import bpe
from tests.llm.cases import CLASH, awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MORE = [
    "don't  stop\n\n now ", "  lead", "trail  ", "a<|endoftext|>b <|endoftext|>\n c", "\x1c\x1d a \x85\xa0b  c​", "x" * 999,
    "1234567 $$$*** {}", "tab\tand\r\nline\x0b\x0c", "Ünïcödé ß ﬁ ① ², ४", "\x00\x01", "日本 語。 😀 👩‍👩‍👧", "<|endoftext|>",
]


def same(text: str) -> None:
    ids = bpe.coder(PATH).encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.coder(PATH).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_each_character_is_parted_as_in_the_library():
    for first in range(1, 0x3000, 64):
        same("".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}\n" for c in range(first, first + 64)))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab 'st\n\té7,$<|>\xa0\x1c日")), max_size=60))
def test_any_text_is_encoded_as_in_the_library(text):
    same(text)


def test_query_equals_library(spark):
    texts = awkward() + MORE
    rows = bpe.round_trip(frame(spark, texts, CLASH), PATH).collect()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    for i, text in enumerate(texts):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        said = ",".join(map(str, ids)).encode()
        back = LIBRARY.decode(ids, skip_special_tokens=False).encode()
        assert found[i] == (len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(back).hexdigest())


def test_lists_of_ids_round_trip_through_tables(spark):
    texts = awkward() + MORE
    back = bpe.decoded(bpe.encoded(frame(spark, texts), PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(frame(spark, []), PATH).collect() == []
