"""Best-fit packing of tokenised documents into sequences, in hierarchical rounds.

Groups of items are packed best-fit, largest first, side by side. Bins that are
nearly full are final; the others become items of the next round, in fewer groups.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayrate.llm.bpe import byte_letters
from stayrate.llm.recent import Known
from stayrate.llm.tables import known
from stayrate.session import durable

LIMIT = 2048
END = 0
#: Items that one task packs; a bin that lacks fewer tokens than SLACK is final.
GROUP, SLACK = 20_000, 16
#: Words between white space; letters of Latin-1 before another printable ASCII character are a word of
#: their own, as the tokenizer parts there, so that words recur whatever follows them.
_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-@\[-`{-~])|[^ \t\n\r\f\v]+")
#: Words of printable Latin-1, of which normalising does no more than lower them,
#: and their parts: letters, single digits and the like, and runs of other signs.
_LATIN = re.compile("[!-~¡-ÿ]+")
_LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_LETTERS = byte_letters()
_ENCODERS: dict[str, Known] = {}
#: Words of a batch that are looked up at once.
_STEP = 300_000


def encoder(path: str) -> Known:
    """Words to their ids as little-endian unsigned 32-bit numbers, one per worker and tokenizer.

    The tokenizer drops white space and never joins characters across it, so a text
    has the ids of its words, one after the other. A Latin-1 word has those of its
    parts, each of them a string of symbols for the model; the library encodes other
    words, and those that may hold a special token.
    """
    if path not in _ENCODERS:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        merge = tokenizer.model.tokenize

        def symbols(parts: list[str]) -> list[bytes]:
            return _as_bytes([t.id for t in merge("".join([_LETTERS[b] for b in p.encode()]))] for p in parts)

        known = Known(symbols)

        def make(words: list[str]) -> list[bytes]:
            cut = [
                [w.lower()] if w.isalpha() and max(w) <= "ÿ"
                else _LATIN_PARTS.findall(w.lower()) if _LATIN.fullmatch(w) and "<|" not in w
                else None
                for w in words
            ]
            known.learn([c for c in cut if c])
            other = tokenizer.encode_batch_fast([w for w, c in zip(words, cut) if c is None], add_special_tokens=False)
            rest = iter(_as_bytes(x.ids for x in other))
            find = known.values.__getitem__
            return [next(rest) if c is None else b"".join(map(find, c)) for c in cut]

        _ENCODERS[path] = Known(make)
    return _ENCODERS[path]


def _as_bytes(lists: Iterable[list[int]]) -> list[bytes]:
    flat: list[int] = []
    ends = [0]
    for ids in lists:
        flat += ids
        ends.append(len(flat))
    data = np.array(flat, "<u4").tobytes()
    return [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]


def encode_all(texts: list[str], words: Known) -> Iterator[bytes]:
    """The ids of each text, looked up for many texts at a time."""
    held: list[list[str]] = []
    size = 0
    for at, text in enumerate(texts):
        held.append(_WORDS.findall(text))
        size += len(held[-1])
        if size >= _STEP or at == len(texts) - 1:
            words.learn(held)
            find = words.values.__getitem__
            yield from (b"".join(map(find, parts)) for parts in held)
            held, size = [], 0


def id_type(path: str) -> str:
    """The type of stored ids: 16 bits little-endian where every id of the tokenizer allows it, else 32."""
    ids = Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()
    return "<u2" if max(ids, default=0) < 1 << 16 else "<u4"


def pieces(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``limit`` tokens of each document's ids and the end id 0.

    Columns: id, piece, start, length, ids_crc32 and, if asked for, ids (of ``id_type``, one
    after the other). Null texts are empty: one piece of one token.
    """
    kept = id_type(path) if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            rows = []
            for at, packed_ids in enumerate(encode_all(batch.column("text").to_pylist(), words)):
                ids = memoryview(packed_ids + END.to_bytes(4, "little"))
                for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                    cut = ids[4 * start : 4 * (start + limit)]
                    rows.append((at, piece, start, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<u4").astype(kept).tobytes() if with_ids else None))
            at, *columns, tokens = zip(*rows) if rows else [()] * 6
            arrays = [batch.column("id").take(pa.array(at, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(tokens, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), known(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, in this order, and how much each bin holds.

    Each size goes to the bin in which the least room stays. ``rooms`` has a bit for
    each room that some bin has; the lowest bit from the size on is the best room.
    """
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms, bins, offsets, used = 0, [], [], []
    for size in sizes:
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = limit, len(used)
            used.append(0)
        bins.append(at)
        offsets.append(used[at])
        used[at] += size
        by_room[room - size].append(at)
        rooms |= 1 << room - size
    return bins, offsets, used


def _packer(at: int, limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs the items of one group in round ``at``; the bins get numbers that no other group has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        bins, offsets, used = best_fit(rows["size"].tolist(), limit)
        base = (at << 56) + (int(rows["g"].iloc[0]) << 28)
        return pd.DataFrame({"item": rows["item"], "bin": base + np.array(bins), "offset": offsets, "used": np.array(used)[bins]})

    return run


def pack(items: DataFrame, limit: int = LIMIT, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """Bin and offset of every item: ``items`` has item (long, unique) and size (1 to ``limit``).

    Each round deals the open items by hash to groups of about ``group`` and packs
    every group; bins that lack at least ``slack`` are items of the next round. The
    rounds end after one that had a single group, or when a round no longer joins
    enough bins to be worth another. No task ever has more than a group.
    """
    placed, n, at = None, items.count(), 0
    while n:
        at, groups = at + 1, -(-n // group)

        dealt = items.select("item", "size", F.pmod(F.xxhash64("item", F.lit(at)), F.lit(groups)).alias("g"))
        found = durable(dealt.groupBy("g").applyInPandas(_packer(at, limit), "item long, bin long, offset long, used long"))
        if placed is None:
            placed = found.select("item", "bin", "offset")
        else:
            more = found.select(F.col("item").alias("bin"), F.col("bin").alias("outer"), F.col("offset").alias("before"))
            placed = placed.join(more, "bin", "left").select(
                "item", F.coalesce("outer", "bin").alias("bin"), (F.col("offset") + F.coalesce("before", F.lit(0))).alias("offset")
            )
        items = found.where(f"offset = 0 and used <= {limit - slack}").select(F.col("bin").alias("item"), F.col("used").alias("size"))
        before, n = n, items.count()
        if groups == 1 or n > 0.95 * before:
            break
    return placed if placed is not None else items.select("item", F.col("item").alias("bin"), F.col("size").alias("offset"))


def packed(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece with the sequence that holds it and its place there.

    Only documents of more than ``limit`` tokens are cut. Full pieces are sequences of
    their own. Null and empty texts are one token, the end id. Rows that repeat an id
    are packed each for itself; a null id stays null. An empty table gives no rows;
    other columns of ``docs`` play no part. Returns id_col, piece, start, length,
    ids_crc32, sequence_id, offset, and ids if asked for (see ``pieces``).
    """
    stored = durable(pieces(docs, path, limit, id_col, text_col, with_ids).withColumn("item", F.monotonically_increasing_id()))
    # Places of items are below 2 ** 56, so a full piece's own number is no bin's.
    whole = stored.where(F.col("length") == limit).select("*", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"))
    part = stored.where(F.col("length") < limit)
    places = pack(part.select("item", F.col("length").alias("size")), limit)
    rows = whole.unionByName(part.join(places, "item"))
    more = ["ids"] if with_ids else []
    return rows.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", *more
    )


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id and the token ids of every sequence, from rows of ``packed(..., with_ids=True)``.

    Pieces follow each other by their offsets; no rows give none.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    joined = F.aggregate("held", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    width = F.octet_length(F.element_at("held.ids", 1)) / F.element_at("held.length", 1)
    given = rows.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", joined.alias("ids"), width.cast("int").alias("width"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())
            ids = [np.frombuffer(data, f"<u{width}").astype(np.int32) for data, width in both]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return given.mapInArrow(run, "sequence_id bigint, ids array<int>")
