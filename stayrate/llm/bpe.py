"""Byte-level BPE: merging by a priority queue over a linked list, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.recent import Recent
from stayrate.llm.tables import known

# The pattern that parts a text for byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = regex.compile(WORD_PATTERN)
#: Runs between which WORD_PATTERN always parts: it looks no further back, and at most at the next space.
#: Latin-1 letters are a run of their own before any other ASCII character, so that words recur whatever follows them.
_RUN = regex.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-@\[-`{-\x7F]|\Z)| ?\S+|\s+(?!\S)|\s+")
_CODERS: dict[str, Bpe] = {}
#: What becomes of a run: how many ids, the ids as decimals, the bytes of their vocabulary strings.
Coded = tuple[int, str, bytes]


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from 256 on.
    """
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = given["model"]["vocab"]
        self.of_byte = [vocab[c] for c in letters]
        #: By rank: the two symbols and what they become; and the rank of two symbols, as one number.
        self.joins, self.rank, self.size = [], {}, max(vocab.values()) + 1
        for rank, pair in enumerate(given["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.joins.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank[vocab[a] * self.size + vocab[b]] = rank
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.bytes_of.update({i: content.encode() for content, i in self.special.items()})
        by_length = sorted(self.special, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        symbols, spelled = self.of_byte.__getitem__, self.bytes_of.__getitem__
        decimal = [str(i) for i in range(max(self.bytes_of) + 1)].__getitem__

        def code(word: str) -> list[int]:
            return self.merge(list(map(symbols, word.encode())))

        words = Recent(lambda keys: list(map(code, keys)))

        def make(runs: list[str]) -> list[Coded]:
            # A run of Latin-1 letters, with or without a space before it, is one word; other runs share the words in them.
            parts = [None if (r[1:] if r[0] == " " else r).isalpha() and max(r) <= "ÿ" else _WORD.findall(r) for r in runs]
            flat = iter(words([w for part in parts if part for w in part]))
            ids = [code(r) if part is None else list(chain.from_iterable([next(flat) for _ in part])) for r, part in zip(runs, parts)]
            return [(len(x), ",".join(map(decimal, x)), b"".join(map(spelled, x))) for x in ids]

        self.runs = Recent(make, 300_000)

    def merge(self, symbols: list[int]) -> list[int]:
        """Joins neighbours, the pair of lowest rank first and of equal ones the leftmost."""
        n, size, joins, find = len(symbols), self.size, self.joins, self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # Rank and place as one number.
        queue = [rank * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := find(a * size + b)) is not None]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            a, b, joined = joins[rank]
            j = after[i]
            if symbols[i] != a or j == n or symbols[j] != b:
                continue  # one of the two has been joined to another since
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := find(joined * size + symbols[k])) is not None:
                    heappush(queue, rank * n + i)
            if (h := before[i]) >= 0 and (rank := find(symbols[h] * size + joined)) is not None:
                heappush(queue, rank * n + h)
        return [s for s in symbols if s >= 0]

    def _pieces(self, text: str) -> list[Coded]:
        if self.parts is None or not any(s in text for s in self.special):
            return self.runs(_RUN.findall(text))
        found: list[Coded] = []
        for part in self.parts.split(text):
            if part in self.special:
                at = self.special[part]
                found.append((1, str(at), self.bytes_of[at]))
            else:
                found += self.runs(_RUN.findall(part))
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, said, _ in self._pieces(text) for i in said.split(",")]

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """How many ids a text has, the ids as decimals with commas between, and the text they decode to."""
        found = self._pieces(text)
        n, said, spelled = (map(itemgetter(k), found) for k in range(3))
        return sum(n), ",".join(said), b"".join(spelled).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def coder(path: str) -> Bpe:
    """One per worker and vocabulary."""
    if path not in _CODERS:
        _CODERS[path] = Bpe(path)
    return _CODERS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the ids of every document; null texts are empty and have no ids. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], [id_col, "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {_kind(docs, id_col)}, ids array<int>")


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of every list of ids; a null list is empty. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            texts = pa.array([bpe.decode(i) for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts], [id_col, "text"])

    given = rows.select(F.col(id_col).alias("id"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))
    return given.mapInArrow(run, f"`{id_col}` {_kind(rows, id_col)}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every document and says what came out.

    Returns id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text in UTF-8). Null texts are empty. Strings of
    special tokens in a text become those tokens. Rows that repeat an id get a row
    each, a null id stays null, an empty table gives no rows, and other columns of
    ``docs`` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column("text").to_pylist():
                n, said, back = bpe.round_trip(text)
                counts.append(n)
                first.append(hashlib.sha256(said.encode()).hexdigest())
                second.append(hashlib.sha256(back.encode()).hexdigest())
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"`{id_col}` {_kind(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), known(text_col).alias("text"))


def _kind(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()
