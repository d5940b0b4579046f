"""Sharding by the smallest largest shard, over groups of equal texts in the order of their digests.

The capacity is found by binary search, checked greedily. The groups never meet in
one place: blocks of groups (a digest's first digits) are summed, and only the
blocks in which a cut may lie are taken apart, until every cut is between groups.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.tables import known
from stayrate.session import durable

SHARDS = 24
#: Bytes that a row counts beyond its text.
ROW = 8
#: Digits of a digest in the first blocks; rows of a shard that are numbered together.
DIGITS, RUN = 3, 50_000


@dataclass(frozen=True)
class Block:
    """Groups whose digest starts with ``prefix``; a single group cannot be cut."""

    prefix: str
    size: int
    groups: int


class Line:
    """Blocks in order, with the places at which they end."""

    def __init__(self, blocks: list[Block]):
        self.blocks = sorted(blocks, key=lambda b: b.prefix)
        self.ends = [0, *accumulate(b.size for b in self.blocks)]
        self.total = self.ends[-1]

    def furthest(self, start: int, capacity: int, fluid: bool) -> int:
        """The last place at which a shard from ``start`` may end; ``fluid``: anywhere in blocks of several groups."""
        end = start + capacity
        if end >= self.total:
            return self.total
        at = bisect_right(self.ends, end) - 1
        return end if fluid and self.blocks[at].groups > 1 else max(start, self.ends[at])

    def cuts(self, capacity: int, shards: int, fluid: bool) -> list[int]:
        """The ends of ``shards`` shards, each filled as far as it goes."""
        places, at = [], 0
        for _ in range(shards):
            at = self.furthest(at, capacity, fluid)
            places.append(at)
        return places

    def least_capacity(self, shards: int, fluid: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, fluid)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def unsettled(self, shards: int) -> tuple[list[Block], list[int]]:
        """Blocks in which a cut may lie, and the cuts once there are none.

        Cutting between blocks alone gives a capacity that surely suffices, cutting
        blocks anywhere one that is surely needed. A greedy cut lies between those that
        the two rules make.
        """
        needed, enough = self.least_capacity(shards, True), self.least_capacity(shards, False)
        first, last = self.cuts(needed, shards, False), self.cuts(enough, shards, True)
        marked = {
            at
            for a, b in zip(first[:-1], last[:-1])
            for at in range(max(0, bisect_right(self.ends, a) - 1), len(self.blocks))
            if self.blocks[at].groups > 1 and self.ends[at] < b and self.ends[at + 1] > a
        }
        return [self.blocks[at] for at in sorted(marked)], self.cuts(enough, shards, False)


def _blocks(groups: DataFrame, parents: list[Block], digits: int) -> list[Block]:
    """The blocks of ``digits`` digits within ``parents`` (of fewer digits), or all."""
    prefix = F.substring("digest", 1, digits).alias("prefix")
    if parents:
        names = groups.sparkSession.createDataFrame([(b.prefix,) for b in parents], "parent string")
        length = len(parents[0].prefix)
        groups = groups.join(F.broadcast(names), F.substring("digest", 1, length) == F.col("parent"))
    rows = groups.groupBy(prefix).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).collect()
    return [Block(r.prefix, int(r.size), r.groups) for r in rows]


def boundaries(groups: DataFrame, shards: int) -> list[str]:
    """Digests at which shards 1, 2, ... start, for the least capacity; ``groups`` has digest and size.

    At most 16 rows for each block in which a cut may lie come to the driver at a time.
    """
    blocks, digits = _blocks(groups, [], DIGITS), DIGITS
    while True:
        line = Line(blocks)
        open_, cuts = line.unsettled(shards)
        if not open_:
            starts = {line.ends[i]: b.prefix for i, b in enumerate(line.blocks)}
            return [starts[c] for c in cuts[:-1] if c < line.total]
        gone = {b.prefix for b in open_}
        blocks = [b for b in blocks if b.prefix not in gone]
        for length in sorted({len(p) for p in gone}):
            blocks += _blocks(groups, [b for b in open_ if len(b.prefix) == length], length + 1)


def giants(groups: DataFrame, shards: int) -> list[str]:
    """Digests of groups that exceed an even share of what is left; each is a shard of its own.

    No cut can make a shard smaller than its largest group, and with these apart the
    others stay even.
    """
    total = groups.agg(F.sum("size").alias("n")).first().n or 0
    found: list[str] = []
    for row in groups.orderBy(F.desc("size"), "digest").limit(shards - 1).collect():
        if row["size"] * (shards - len(found)) <= total:
            break
        found.append(row.digest)
        total -= row["size"]
    return found


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its shard and its place there.

    Equal texts share a shard; null texts are empty. The order of groups is that of the
    SHA-256 of their texts. Returns id_col, size (UTF-8 bytes and 8), text_crc32, law
    ('bytes'), shard (0 to ``shards`` - 1; with few groups, some stay empty), slot (gapless
    from 0, in no order that matters) and grown_shard (null: the law says nothing of more
    shards). Rows that repeat an id get a row each, a null id stays null, an empty table
    gives no rows, and other columns of ``docs`` play no part.
    """
    text = known(text_col)
    base = durable(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(ROW)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
        )
    )
    groups = durable(base.groupBy("digest").agg(F.sum("size").alias("size")))
    apart = giants(groups, shards)
    starts = boundaries(groups.where(~F.col("digest").isin(apart)), shards - len(apart))
    runs = max(1, -(-base.count() // RUN))
    placed = base.select("id", "size", "text_crc32", _shard(starts, apart, shards).alias("shard"), F.pmod(F.xxhash64("id", "text_crc32"), F.lit(runs)).alias("run"))
    counts = placed.groupBy("shard", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    inside = Window.partitionBy("shard", "run").orderBy("id", "text_crc32", "size")
    return placed.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["shard", "run"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _shard(starts: list[str], apart: list[str], shards: int) -> Column:
    """Giants have the last shards; the others the number of starts that are not after them."""
    passed = sum([(F.col("digest") >= s).cast("int") for s in starts], F.lit(0))
    for k, digest in enumerate(apart):
        passed = F.when(F.col("digest") == digest, shards - 1 - k).otherwise(passed)
    return passed.cast("int")
