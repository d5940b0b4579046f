"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stayrate.llm.components import components
from stayrate.llm.tables import known, numbered
from stayrate.session import durable

WORDS, SEED, DISTANCE = 3, 42, 2
#: Blocks of a fingerprint; two fingerprints within DISTANCE agree in BLOCKS - DISTANCE of them.
BLOCKS = 5
#: Up to this many fingerprints of one block value are compared directly.
CROWD = 64
_STEP = 65536


def shingles(text: bytes, words: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The lower-cased words of a UTF-8 text, joined, and where each run of ``words`` of them lies; a shorter text is one run."""
    parts = text.lower().split()  # bytes: A-Z, and the white space \x20 \x09-\x0D alone
    if not parts:
        return b"", []
    joined = b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return joined, list(zip(starts, ends[words - 1 :])) or [(0, len(joined))]


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text; 0 without words."""
    joined, spans = shingles(text, words)
    if not spans:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _STEP):
        hashes = np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in spans[at : at + _STEP]), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = int(np.packbits(2 * ones > len(spans), bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and fp (signed long) of every document; null texts are empty and get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), known(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"id {kind}, fp bigint"
    )


def _masks(blocks: int, shared: int) -> list[int]:
    """For each choice of ``shared`` blocks the bits that they cover."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(bits, shared)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def close_pairs(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """All pairs (u, v) of nodes whose fingerprints differ in at most ``distance`` bits.

    ``distinct`` has one row (node, fp) per fingerprint. Fingerprints that are close
    agree in ``blocks - distance`` blocks, for some choice of them: the join is on
    these. Where more than ``crowd`` fingerprints share such a choice, its rows are
    joined on more: on the centres that are within half the distance of both. Each
    centre has a bounded number of fingerprints around it, so no group grows.
    """
    if distance != 2:
        raise ValueError("crowded blocks are resolved by centres one bit away, for a distance of 2")
    masks = _masks(blocks, blocks - distance)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)))
    keyed = distinct.select("node", "fp", F.explode(keys).alias("key")).select("node", "fp", "key.t", "key.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = durable(keyed.join(sizes, ["t", "k"]).select("t", "k", "node", "fp", (F.col("n") > crowd).alias("crowded")))
    rest = F.element_at(
        F.array(*(F.array(*(F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1)) for m in masks)), F.col("t") + 1
    )
    centres = F.concat(F.array("fp"), F.transform(rest, lambda bit: F.col("fp").bitwiseXOR(bit)))
    direct = shared.where("not crowded").select("t", "k", "node", "fp")
    around = shared.where("crowded").select("t", F.explode(centres).alias("k"), "node", "fp")
    found = None
    for side in (direct, around):
        left = side.select("t", "k", F.col("node").alias("u"), F.col("fp").alias("a"))
        right = side.select("t", "k", F.col("node").alias("v"), F.col("fp").alias("b"))
        near = left.join(right, ["t", "k"]).where("a < b and bit_count(a ^ b) <= %d" % distance).select("u", "v")
        found = near if found is None else found.union(near)
    return found.distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its fingerprint and the smallest id reachable by links.

    Fingerprints are of lower-cased (A-Z) word triples and link at up to two differing
    bits. Null and empty texts have fingerprint zero and link like others. Equal
    fingerprints are one node, so copies are never paired. Rows that repeat an id
    get one row each; a null id never becomes a component unless no other id is
    there. An empty table gives no rows; other columns of ``docs`` play no part.
    Returns id_col, fingerprint (16 lowercase hex digits), component_id.
    """
    marked = durable(fingerprints(docs, id_col, text_col))
    # Fingerprints are the nodes, so that rows without an id link others as any row does.
    distinct = durable(marked.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = components(close_pairs(distinct.select(F.col("fp").alias("node"), "fp"))).withColumnRenamed("node", "fp")
    classes = durable(distinct.join(nodes, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    first = durable(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    roots = classes.join(first, "root").select("fp", "component_id")
    return marked.join(roots, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, all columns as they are: that with the smallest id.

    Of rows that repeat an id the first of the stored rows stays; null ids sort last.
    """
    stored, row, key = numbered(docs, F.col(id_col).isNull(), F.col(id_col))
    gone = linked(stored, key, text_col).where(f"{key} <> component_id").select(F.col(f"{key}.row").alias(row))
    return stored.join(gone, row, "left_anti").drop(row, key)
