"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items.

Items and documents become sequences of lower-cased words. Every run of WINDOW words of
an item is a pattern of the automaton, which reads each document once, word by word;
where it stops, word places are mapped back to code points of the text as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat
from math import isqrt

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.tables import known, numbered
from stayrate.session import durable

WINDOW = 10
#: Bytes of item text in one automaton (about 100 MB of it); more text is dealt to several, one pass each.
MOST = 1 << 21
#: Starts of windows that a piece of a long item covers.
PIECE = 4096
# The words of a text, once A-Z are a-z.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on bytes of UTF-8: A-Z to a-z, and what is in no word to spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_HIT = "struct<first:bigint,last:bigint,start:bigint,end:bigint>"
_HITS = pa.list_(pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")]))
_BUILT: dict[bytes, Automaton] = {}


class Automaton:
    """The windows of (name, words) items. A word is two letters of disjoint alphabets, so
    that no node has many children and no match lies across words; unknown words are two zeros."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        parts = [(name, words.encode().split()) for name, words in items]
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in parts for w in words))}
        base = isqrt(len(vocabulary)) + 1
        self.letters = {w: chr(1 + k // base) + chr(1 + base + k % base) for w, k in vocabulary.items()}
        self.names: list[set[str]] = []
        self.lengths: list[int] = []
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, words in parts:
            spelled = [self.letters[w] for w in words]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                key = "".join(spelled[at : at + window])
                found = self.machine.get(key, len(self.names))
                if found == len(self.names):
                    self.machine.add_word(key, found)
                    self.names.append(set())
                    self.lengths.append(len(key) // 2)
                self.names[found].add(name)
        self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """How many words a UTF-8 text has, its hits (words and code points, ends exclusive) and the items found."""
        plain = text.translate(_PLAIN)
        words = plain.split()
        if not self.names:
            return len(words), [], []
        spelled = "".join(map(self.letters.get, words, repeat("\0\0")))
        ends = [((last + 1) // 2, window) for last, window in self.machine.iter(spelled)]
        runs = merged([(end - self.lengths[window], end) for end, window in ends])
        names: set[str] = set().union(*(self.names[window] for window in {window for _, window in ends}))
        return len(words), _placed(text, plain, runs), sorted(names)


def merged(runs: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Sorted runs (first, last, ...) with those joined that overlap or touch; of more fields
    in pairs, the start is that of the earliest and the end that of the latest run."""
    out: list[list[int]] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1]:
            out[-1][1::2] = map(max, out[-1][1::2], run[1::2])
        else:
            out.append(list(run))
    return [tuple(run) for run in out]


def _placed(text: bytes, plain: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of words with their code points in the text."""
    found, places, at = [], _WORD.finditer(plain), -1
    points = seen = 0
    for first, last in runs:
        ends = []
        for wanted in (first, last - 1):
            while at < wanted:
                place, at = next(places), at + 1
            byte = place.start() if wanted == first and not ends else place.end()
            points, seen = points + len(text[seen:byte].decode("utf-8", "replace")), byte
            ends.append(points)
        found.append((first, last, *ends))
    return found


def _automaton(items: list[tuple[str, str]], window: int) -> Automaton:
    """Built once per worker; only the last one is kept."""
    key = hashlib.blake2b(repr((window, items)).encode()).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, window)
    return _BUILT[key]


def pieces(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Different (name, words) of the items; long items in pieces that share window - 1 words."""
    words = F.regexp_extract_all(F.translate(known(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD_PATTERN), 0)
    given = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), words.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)), F.lit(PIECE))
    cut = F.explode(F.transform(starts, lambda at: F.array_join(F.slice("all", at + 1, PIECE + window - 1), " ")))
    return given.select("name", cut.alias("words")).distinct()


def _scanned(docs: DataFrame, items: list[tuple[str, str]], window: int, hits_only: bool) -> DataFrame:
    """row, id, n_words, hits and names of a table with row, id and text (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items, window)
        for batch in batches:
            found = [automaton.scan(x) for x in batch.column("text").to_pylist()]
            columns = [
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([hits for _, hits, _ in found], _HITS),
                pa.array([names for _, _, names in found], pa.list_(pa.string())),
            ]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEYS), *columns], [*_KEYS, "n_words", "hits", "names"])
            yield out.filter(pa.array([bool(hits) for _, hits, _ in found], pa.bool_())) if hits_only else out

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in _KEYS)
    return docs.mapInArrow(run, f"{kinds}, n_words bigint, hits array<{_HIT}>, names array<string>")


_KEYS = ["row", "id"]


def _joined(parts: DataFrame) -> DataFrame:
    """The results of several passes over the same rows as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [merged([tuple(hit.values()) for hit in x]) for x in batch.column("hits").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("hits"), "hits", pa.array(hits, _HITS))

    grouped = parts.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"),
    )
    return grouped.mapInArrow(run, grouped.schema)


def found(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    most: int = MOST,
) -> DataFrame:
    """One row per document with the places of its text that some item also has.

    Words are lower-cased (A-Z). An item of fewer than ``window`` words is one window.
    Returns id_col, n_words, hits (runs of words first to last and their code points start
    to end in the text as given, ends exclusive; runs that overlap or touch are one) and
    names (ids of the items found, as text, each once). Null texts have no words, items
    without words no windows; a null item id is named by the empty text, and items that
    share an id are one name. Rows that repeat an id get a row each, a null id stays null.
    No documents give no rows; no items give no hits. Other columns play no part.

    Items of up to ``most`` bytes go to the executors at once. More are dealt to several
    automatons, each of about ``most`` bytes, with a pass over the documents for each.
    """
    cut = durable(pieces(items, window, item_col, item_text))
    size = cut.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("name")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-size // most))
    # Rows are told apart only where passes are put together again.
    stored, row = (docs, None) if passes == 1 else numbered(docs)[:2]
    given = stored.select(
        (F.lit(None).cast("long") if row is None else F.col(row)).alias("row"),
        F.col(id_col).alias("id"),
        known(text_col).cast("binary").alias("text"),
    )
    parts = None
    for at in range(passes):
        dealt = cut.where(F.pmod(F.xxhash64("name", "words"), F.lit(passes)) == at).collect()
        part = _scanned(given, sorted((x.name, x.words) for x in dealt), window, at > 0)
        parts = part if parts is None else parts.union(part)
    whole = parts if passes == 1 else _joined(parts)
    return whole.select(F.col("id").alias(id_col), "n_words", "hits", "names")


def clean(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The documents without a hit, all columns as they are; rows count one by one, whatever their ids."""
    stored, row, key = numbered(docs)
    hit = found(stored, items, window, row, text_col, item_col, item_text).where(F.size("hits") > 0).select(row)
    return stored.join(hit, row, "left_anti").drop(row, key)


def counted(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: n_words, n_hit (words in hits), n_items, items_sha256 (of the names,
    sorted as text and joined by commas) and contaminated. Options and edge cases as in ``found``."""
    rows = found(docs, items, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, hit: total + hit["last"] - hit["first"])
    return rows.select(
        rows.columns[0],
        "n_words",
        n_hit.alias("n_hit"),
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("names"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
