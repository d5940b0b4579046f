"""Vector code compression: codebooks per part of the vectors, learned by a dual-tree Lloyd.

Blocks of vectors become trees once: for every part position the parts are halved on
their widest component down to leaves, and each node keeps its box and the sum of its
parts. A round holds pairs of a node of parts and a node of entries; bounds on their
distance drop entries that are nearest to no part of the node, a node with one entry
left is assigned with its sum, and parts of leaves that stay open are compared with the
entries left, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.vectors import dense, largest, usable, whole
from stayrate.session import durable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a block's vectors, at most rows of it, and parts of a leaf (up to twice as many).
CELLS, BLOCK, LEAF = 1 << 19, 4096, 16


def _edges(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin and end: every node is halved while it keeps ``leaf`` members."""
    levels = [np.array([0, n])]
    while n >> len(levels) >= leaf:
        last = levels[-1]
        levels.append(np.insert(last, range(1, len(last)), (last[:-1] + last[1:]) // 2))
    return levels


@dataclass
class Tree:
    """Points in tree order, and the boxes of the nodes of each level, from the root on."""

    points: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    edges: list[np.ndarray]


def planted(points: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
    """The tree of some points, and their order in it."""
    edges = _edges(len(points), leaf)
    order = np.arange(len(points))
    for level, below in zip(edges, edges[1:]):
        for a, m, b in zip(level, below[1::2], level[1:]):
            rows = points[order[a:b]]
            axis = int(np.argmax(rows.max(0) - rows.min(0)))
            order[a:b] = order[a:b][np.argpartition(rows[:, axis], m - a)] if m > a else order[a:b]
    ordered = points[order]
    low, high = ([f.reduceat(ordered, x[:-1], axis=0) for x in edges] for f in (np.minimum, np.maximum))
    return Tree(ordered, low, high, edges), order


def sums(tree: Tree) -> list[np.ndarray]:
    """The sum of the points of every node, level by level."""
    return [np.add.reduceat(tree.points, x[:-1], axis=0) for x in tree.edges]


def _open(tree: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes, and for each the place of its parent in ``nodes``; below the last level come the points."""
    if level + 1 < len(tree.edges):
        return (2 * nodes[:, None] + [0, 1]).ravel(), np.repeat(np.arange(len(nodes)), 2)
    if level >= len(tree.edges):
        return nodes, np.arange(len(nodes))
    starts, sizes = tree.edges[level][nodes], np.diff(tree.edges[level])[nodes]
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(starts, sizes) + within, np.repeat(np.arange(len(nodes)), sizes)


def _box(tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
    return (tree.low[level], tree.high[level]) if level < len(tree.edges) else (tree.points, tree.points)


def _possible(low: np.ndarray, high: np.ndarray, node: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which pairs may hold a nearest entry: boxes ``low`` to ``high`` of parts, pairs in order of ``node``, boxes ``near`` to ``far`` of entries.

    Dropped are pairs whose least distance is over the greatest distance of another pair of
    the node, so an entry that ties is never dropped.
    """
    a, b = low[node], high[node]
    least = (np.maximum(0, np.maximum(near - b, a - far)) ** 2).sum(1)
    most = (np.maximum(far - a, b - near) ** 2).sum(1)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    bound = np.minimum.reduceat(most, starts)
    return least <= np.repeat(bound, np.diff(np.r_[starts, len(node)]))


def _winning(low: np.ndarray, high: np.ndarray, node: np.ndarray, entry: np.ndarray, name: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which pairs of nodes and single entries are left when each is held against the entry nearest to the node's middle.

    The difference of two squared distances is linear in the part, so its largest value over
    a box is at a corner. An entry goes if it is farther everywhere, or as far and ``name``d later.
    """
    a, b, at = low[node], high[node], entries[entry]
    middle = ((a + b - 2 * at) ** 2).sum(1)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.r_[starts, len(node)])
    # The first pair of each node with the least distance to the middle.
    best = np.minimum.reduceat(np.where(middle == np.repeat(np.minimum.reduceat(middle, starts), sizes), np.arange(len(node)), len(node)), starts)
    rival = np.repeat(best, sizes)
    turn = 2 * (at - at[rival])
    # |x - rival|^2 - |x - entry|^2, at the corner where it is largest.
    gap = (at[rival] ** 2 - at**2).sum(1) + np.maximum(turn * a, turn * b).sum(1)
    return (rival == np.arange(len(node))) | (gap > 0) | ((gap == 0) & (name < name[rival]))


def assign(parts: Tree, total: list[np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the parts of each entry, and the entry of every part in tree order (the lowest of equally near ones)."""
    book, names = planted(entries, 1)
    points = book.points
    gathered, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    codes = np.empty(len(parts.points), np.int64)
    node, entry, single, level = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while len(node):
        low, high = parts.low[level], parts.high[level]
        near, far = _box(book, single)
        keep = _possible(low, high, node, near[entry], far[entry])
        node, entry = node[keep], entry[keep]
        if single >= len(book.edges):
            keep = _winning(low, high, node, entry, names[entry], points)
            node, entry = node[keep], entry[keep]
            alone = np.bincount(node, minlength=len(low))[node] == 1
            edges = parts.edges[level]
            np.add.at(gathered, names[entry[alone]], total[level][node[alone]])
            np.add.at(counts, names[entry[alone]], np.diff(edges)[node[alone]])
            for a, b, code in zip(edges[node[alone]], edges[node[alone] + 1], names[entry[alone]]):
                codes[a:b] = code
            node, entry = node[~alone], entry[~alone]
            if level + 1 == len(parts.edges):
                break
        if single < len(book.edges):
            entry, of = _open(book, single, entry)
            node, single = node[of], single + 1
        if level + 1 < len(parts.edges):
            # The children of a node take all its pairs; pairs stay in order of their node.
            node, entry, level = np.concatenate([2 * node, 2 * node + 1]), np.tile(entry, 2), level + 1
            order = np.argsort(node, kind="stable")
            node, entry = node[order], entry[order]
    if len(node):
        edges = parts.edges[level]
        open_nodes, of = np.unique(node, return_inverse=True)
        left = np.zeros((len(open_nodes), len(entries)), bool)
        left[of, names[entry]] = True
        sizes = np.diff(edges)[open_nodes]
        at, mine = _open(parts, level, open_nodes)
        distance = ((parts.points[at][:, None, :] - entries[None]) ** 2).sum(2)
        distance[~np.repeat(left, sizes, axis=0)] = np.iinfo(np.int64).max
        codes[at] = chosen = distance.argmin(1)
        np.add.at(gathered, chosen, parts.points[at])
        counts += np.bincount(chosen, minlength=len(entries))
    return gathered, counts, codes


def _blocks(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """A row per block of vectors: ids, labels, and for every part position its tree, as bytes."""
    size = max(64, min(BLOCK, CELLS // (width * parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), size):
                block = batch.slice(start, size)
                given = dense(block.column("vector"), width * parts)
                fields = []
                for part in range(parts):
                    tree, order = planted(given[:, part * width : (part + 1) * width], LEAF)
                    boxes = np.concatenate([np.concatenate(tree.low), np.concatenate(tree.high)])
                    cached = np.concatenate(sums(tree))
                    fields.append((order.astype("<i4"), tree.points.astype("<i4"), boxes.astype("<i4"), cached.astype("<i8")))
                data = [pa.array([[f[k].tobytes() for f in fields]], pa.list_(pa.binary())) for k in range(4)]
                whole_column = lambda name: pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), block.column(name))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([whole_column("id"), whole_column("label"), *data], ["ids", "labels", "orders", "points", "boxes", "sums"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    more = ", ".join(f"{c} array<binary>" for c in ("orders", "points", "boxes", "sums"))
    return rows.select("id", "label", "vector").mapInArrow(run, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, {more}")


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[tuple[Tree, list[np.ndarray], np.ndarray]]]]:
    """Place in the batch and, for each part position, the stored tree with its sums and order."""
    for at in range(len(batch)):
        found = []
        orders, points, boxes, cached = (batch.column(c)[at] for c in ("orders", "points", "boxes", "sums"))
        for order, point, box, total in zip(orders, points, boxes, cached):
            order = np.frombuffer(order.as_buffer(), "<i4")
            edges = _edges(len(order), LEAF)
            cuts = np.cumsum([len(x) - 1 for x in edges])[:-1]
            low, high = np.split(np.frombuffer(box.as_buffer(), "<i4").reshape(-1, width).astype(np.int64), 2)
            rows = np.frombuffer(point.as_buffer(), "<i4").reshape(-1, width).astype(np.int64)
            total = np.frombuffer(total.as_buffer(), "<i8").reshape(-1, width)
            found.append((Tree(rows, np.split(low, cuts), np.split(high, cuts), edges), np.split(total, cuts), order))
        yield at, found


def _totals(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place and total of all parts assigned to each entry; place -1 has how many they are."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, counts = np.zeros_like(books), np.zeros((parts, entries, 1), np.int64)
        for batch in batches:
            for _, trees in _trees(batch, width):
                for part, (tree, total, _) in enumerate(trees):
                    found, n, _ = assign(tree, total, books[part])
                    gathered[part] += found
                    counts[part, :, 0] += n
        flat = np.concatenate([counts, gathered], axis=2)
        places = np.indices(flat.shape).reshape(3, -1)
        columns = [pa.array(x, pa.int32()) for x in (places[0], places[1], places[2] - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(flat.ravel(), pa.int64())], ["part", "entry", "place", "total"])

    found = blocks.select("orders", "points", "boxes", "sums").mapInArrow(run, "part int, entry int, place int, total bigint")
    return found.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def learned(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after some rounds. Only a number per entry and component comes to the driver."""
    for _ in range(rounds):
        rows = _totals(blocks, books).collect()
        total = {(r.part, r.entry, r.place): int(r.total) for r in rows}
        books = books.copy()
        for part, entry in np.ndindex(books.shape[:2]):
            if n := total.get((part, entry, -1), 0):
                books[part, entry] = [total[part, entry, k] // n for k in range(books.shape[2])]
    return books


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of every row of the blocks."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, trees in _trees(batch, width):
                n = len(trees[0][2])
                codes, error = np.empty((n, len(trees)), np.uint8), np.zeros(n, np.int64)
                for part, (tree, total, order) in enumerate(trees):
                    found = assign(tree, total, books[part])[2]
                    codes[order, part] = found
                    error[order] += ((tree.points - books[part][found]) ** 2).sum(1)
                text = [row.tobytes().hex() for row in codes]
                columns = [batch.column(c)[at].values for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    return blocks.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def compressed(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """A code of two hex digits per part for every vector, and how far it is from the vector.

    Components x are floor(scale * x); vectors are cut into ``parts`` equal consecutive
    parts, zeros after the shorter ones. Each codebook starts with that part of the rows of
    the smallest ids (``entries`` of them, at most 256; fewer rows give fewer). A round
    assigns each part to its nearest entry, of equally near ones the first, and makes each
    entry the mean of its parts, rounded down; an entry without parts stays. Returns id_col, code,
    error (the squared distances of the parts to their entries, summed), label_error (error
    summed over the rows of the label, nulls together) and codebooks_sha256.

    Rows whose vector is null or has a component that is null or not finite drop out. Null
    ids sort last; rows that repeat an id get a row each, and where they decide which rows
    start the codebooks, the smaller vector comes first. An empty table gives no rows; other
    columns play no part. Components too large for exact distances in a long are an error.
    """
    given = vectors.where(usable(vector_col)).select(
        F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
        whole(vector_col, scale).alias("vector"),
        largest(vector_col, scale).alias("most"),
    )
    size = given.agg(F.coalesce(F.max("most"), F.lit(0.0)).alias("most"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("n")).first()
    width = max(1, -(-size.n // parts))
    if width * parts * (2 * size.most + 2) ** 2 >= 1 << 61:
        raise ValueError(f"components up to {size.most:g} are too large; pass a smaller scale than {scale}")
    first = given.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for k, row in enumerate(first):
        padded = np.zeros(parts * width, np.int64)
        padded[: len(row.vector)] = row.vector
        books[:, k] = padded.reshape(parts, width)
    blocks = durable(_blocks(given, width, parts))
    books = learned(blocks, books, rounds) if len(first) else books
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = durable(_coded(blocks, books))
    # One row per label and task before the shuffle; the join back is on a table that Spark knows the size of.
    by_label = durable(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
