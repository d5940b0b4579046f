"""Hard-negative mining: exact scores by residue-number-system products, then windowed selection.

Anchors and rows are dealt to cells of bounded size. A cell multiplies its component
matrices modulo a few small primes in float32, in which every partial sum is a whole
number below 2 ** 24, puts the signed scores together by Chinese remaindering, and
keeps what could be among the first of any anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.vectors import dense, usable, whole
from stayrate.session import durable

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative scores from LEAST to MOST hundredths of the positive.
LEAST, MOST = 50, 95
#: Rows and anchors of a cell, on average; and anchors whose scores are held at once.
ROWS, ANCHORS, HELD = 8192, 32_768, 256
#: Columns multiplied before the next reduction: COLUMNS * (p // 2) ** 2 < 2 ** 24 for all primes p below 1024.
COLUMNS = 64
#: Scores are less than this, so that a hundred times a score is a long.
BOUND = 1 << 55


def primes_for(bound: int) -> list[int]:
    """The largest primes below 1024 whose product is over twice ``bound``: no more than needed."""
    found, product = [], 1
    for n in range(1023, 2, -2):
        if product > 2 * bound:
            break
        if all(n % k for k in range(3, 32, 2) if k < n):
            found.append(n)
            product *= n
    return found


class Residues:
    """The rows of a matrix of whole numbers modulo each prime, nearest to zero, in float32."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [((rows + p // 2) % p - p // 2).astype(np.float32) for p in primes]

    def pick(self, at) -> Residues:
        out = object.__new__(Residues)
        out.primes, out.parts = self.primes, [part[at] for part in self.parts]
        return out


def products(a: Residues, b: Residues) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, as long as twice their size is below the primes' product."""
    total = np.zeros((len(a.parts[0]), len(b.parts[0])), np.int64)
    modulus = 1
    for p, left, right in zip(a.primes, a.parts, b.parts):
        residue = np.zeros(total.shape, np.float32)
        for at in range(0, left.shape[1], COLUMNS):
            residue = np.fmod(residue + np.fmod(left[:, at : at + COLUMNS] @ right[:, at : at + COLUMNS].T, np.float32(p)), np.float32(p))
        # total stays the score modulo the primes so far; the next one says how many times their product is lacking.
        lacking = (residue.astype(np.int64) - total % p) * pow(modulus, -1, p) % p
        total += lacking * modulus
        modulus *= p
    return np.where(total > modulus // 2, total - modulus, total)


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Both tables under the numbers of their cells: each row once per block of anchors and the other way round.

    Blocks are dealt by hash, so none grows with the input; a hot label or vector fills no block.
    """
    across, down = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    block = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.withColumns({"asks": F.lit(False), "of_row": block(0, down), "scores": F.lit(None).cast("array<bigint>")})
    asked = anchors.withColumns({"asks": F.lit(True), "of_anchor": block(1, across)})
    own, asked = own.withColumn("of_anchor", every(across)), asked.withColumn("of_row", every(down))
    return own.unionByName(asked)


def _split(cell: pa.Table, width: int, primes: list[int]) -> tuple[pa.Table, Residues, pa.Table, Residues, np.ndarray, np.ndarray]:
    """Anchors and rows of a cell, rows by id (nulls last) and place, with residues and numbers for the labels."""
    labels = cell["label"].combine_chunks().dictionary_encode()
    labels = (labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).indices.to_numpy(zero_copy_only=False)
    asks = cell["asks"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    asked, own = np.flatnonzero(asks), np.flatnonzero(~asks)
    order = pa.compute.sort_indices(cell.select(["id", "row"]).take(own), [("id", "ascending"), ("row", "ascending")], null_placement="at_end")
    own = own[order.to_numpy()]
    parts = [(cell.take(at), Residues(dense(cell["vector"].take(at), width), primes), labels[at]) for at in (asked, own)]
    (a, of_a, la), (b, of_b, lb) = parts
    return a, of_a, b, of_b, la, lb


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest scores of each row, largest first, of equal ones the leftmost."""
    n = scores.shape[1]
    if k < n:
        # The k-th largest score decides; ties with it count from the left.
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above = scores > least
        ties = scores == least
        ties &= np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)
        columns = np.nonzero(above | ties)[1].reshape(len(scores), k)
    else:
        columns = np.broadcast_to(np.arange(n), scores.shape)
    order = np.argsort(-np.take_along_axis(scores, columns, 1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, 1)


def _nearest(width: int, primes: list[int], k: int) -> Callable[[pa.Table], pa.Table]:
    """Of a cell the first ``k`` other rows with the label of each anchor."""

    def run(cell: pa.Table) -> pa.Table:
        a, of_a, b, of_b, la, lb = _split(cell, width, primes)
        a_rows, b_rows = a["row"].to_numpy(), b["row"].to_numpy()
        found = [(np.empty(0, np.int64),) * 3]
        for label in np.unique(la):
            inside = np.flatnonzero(lb == label)
            for at in _steps(np.flatnonzero(la == label)) if len(inside) else ():
                scores = products(of_a.pick(at), of_b.pick(inside))
                itself = a_rows[at][:, None] == b_rows[inside][None, :]
                scores[itself] = -BOUND
                columns = best(scores, min(k, len(inside)))
                kept = ~np.take_along_axis(itself, columns, 1)
                found.append((np.repeat(at, kept.sum(1)), inside[columns[kept]], np.take_along_axis(scores, columns, 1)[kept]))
        at, of, scores = map(np.concatenate, zip(*found))
        return _answer(a, b, at, of, scores)

    return run


def _within(width: int, primes: list[int], k: int) -> Callable[[pa.Table], pa.Table]:
    """Of a cell the first ``k`` rows of another label in the window of each positive of each anchor."""

    def run(cell: pa.Table) -> pa.Table:
        a, of_a, b, of_b, la, lb = _split(cell, width, primes)
        positives = [np.array(x, np.int64) for x in a["scores"].to_pylist()]
        n = max(1, len(lb))
        found = [(np.empty(0, np.int64),) * 4]
        for at in _steps(np.arange(len(la))) if len(lb) else ():
            scores = products(of_a.pick(at), of_b)
            other = la[at][:, None] != lb[None, :]
            if int(np.abs(scores).max()) * n < 1 << 62:
                # A score and its column as one number: larger is better, and of equal scores the leftmost.
                keys = np.where(other, scores * n, -(1 << 62)) + np.arange(n - 1, -1, -1)
                keys.sort(axis=1)
                ranked, columns = keys // n, n - 1 - keys % n
            else:
                scores[~other] = -BOUND
                columns = np.argsort(-scores, axis=1, kind="stable")[:, ::-1]
                ranked = np.take_along_axis(scores, columns, 1)
            for i, own, of in zip(at, ranked, columns):
                sought = positives[i]
                least, most = -(-LEAST * sought // 100), MOST * sought // 100
                ends = np.searchsorted(own, most, "right")[:, None] - 1 - np.arange(k)
                held = (ends >= 0) & (own[ends] >= least[:, None])
                which, _ = np.nonzero(held)
                found.append((np.full(len(which), i), of[ends[held]], own[ends[held]], sought[which]))
        at, of, scores, sought = map(np.concatenate, zip(*found))
        return _answer(a, b, at, of, scores).append_column("of_score", pa.array(sought, pa.int64()))

    return run


def _steps(at: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, len(at), HELD):
        yield at[start : start + HELD]


def _answer(a: pa.Table, b: pa.Table, at: np.ndarray, of: np.ndarray, scores: np.ndarray) -> pa.Table:
    names = ["anchor", "row", "id", "score"]
    return pa.table([a["row"].take(pa.array(at)), b["row"].take(pa.array(of)), b["id"].take(pa.array(of)), pa.array(scores, pa.int64())], names)


def _first(found: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    """The first ``k`` of each group by score, id (nulls last) and row; Spark keeps ``k`` a group in each task before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mined(
    vectors: DataFrame,
    asks: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
) -> DataFrame:
    """Negatives that score close to, but below, the positives of every anchor.

    Anchors are the rows for which ``asks`` holds. Components x are floor(scale * x); a
    score is the whole-number inner product with the anchor, higher first, ties by smaller
    id. An anchor's positives are its first other rows of the same label. For each, the
    first rows of other labels that score from LEAST to MOST hundredths of it are returned:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and beside
    them which row each is.

    Rows with a null label, a null vector or a component that is null or not finite take no
    part. Missing components of shorter vectors are zeros. Null ids sort last; rows
    that repeat an id, or a vector, count one by one, so equal ids are told apart by the
    ``*_row`` columns. No anchors, or no rows, give no rows; other columns play no part.
    Vectors so long that a score could reach 2 ** 55 are an error: no long holds its multiples.
    """
    given = vectors.where(F.col(label_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
        whole(vector_col, scale).alias("vector"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.aggregate(vector_col, F.lit(0.0), lambda sum, x: sum + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2.0))).alias("length"),
    )
    stored = durable(given.withColumn("row", F.monotonically_increasing_id()))
    size = stored.agg(
        F.count("*").alias("rows"),
        F.count_if("asks").alias("anchors"),
        F.coalesce(F.max("length"), F.lit(0.0)).alias("most"),
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"),
    ).first()
    # No inner product exceeds the largest square of a length.
    if size.most * 1.001 >= BOUND:
        raise ValueError(f"scores up to {size.most:g} are too large; pass a smaller scale than {scale}")
    width, primes = max(1, size.width), primes_for(int(size.most * 1.001) + 1)
    rows = stored.select("row", "id", "label", "vector")
    anchors = stored.where("asks").select("row", "id", "label", "vector")
    kind = rows.schema["id"].dataType.simpleString()
    found = f"anchor bigint, row bigint, id {kind}, score bigint"

    asked = anchors.withColumn("scores", F.lit(None).cast("array<bigint>"))
    near = _cells(rows, asked, size.rows, size.anchors).groupBy("of_anchor", "of_row").applyInArrow(_nearest(width, primes, positives), found)
    near = durable(_first(near, ["anchor"], positives, "place").withColumnRenamed("anchor", "of"))

    # Of equal positives one window is enough.
    scores = near.groupBy("of").agg(F.collect_set("score").alias("scores"))
    asked = anchors.join(scores, F.col("row") == F.col("of")).drop("of")
    hard = _cells(rows, asked, size.rows, size.anchors).groupBy("of_anchor", "of_row")
    hard = hard.applyInArrow(_within(width, primes, negatives), f"{found}, of_score bigint")
    hard = _first(hard, ["anchor", "of_score"], negatives, "rank")

    pairs = near.select("of", F.col("row").alias("positive_row"), F.col("id").alias("positive_id"), F.col("score").alias("of_score"))
    named = pairs.join(anchors.select(F.col("row").alias("of"), F.col("id").alias("anchor_id")), "of")
    return named.join(hard.withColumnRenamed("anchor", "of"), ["of", "of_score"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        F.col("of_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
        F.col("of").alias("anchor_row"),
        "positive_row",
        F.col("row").alias("negative_row"),
    )
