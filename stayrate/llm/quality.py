"""Quality classifier: averaged embeddings of hashed words and character n-grams.

A document is the mean of the vectors of its words, of their character n-grams, and
of a mark for each word that equals the word 1 to 8 places on (repetition shows in no
bag of words). A softmax over two classes follows. Vectors and weights are learned by stochastic
gradient descent. As the mean is linear, scoring needs one number per bucket: the
difference that its vector makes between the two classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.recent import Recent
from stayrate.llm.tables import known


@dataclass(frozen=True)
class Training:
    """The bounds and rates of a fit. ``rows`` labelled documents of up to ``longest``
    code points are learned from; every document is scored, whatever its length."""

    rows: int = 3000
    longest: int = 20_000
    buckets: int = 1 << 17
    width: int = 16
    shortest_gram: int = 3
    longest_gram: int = 5
    furthest: int = 8
    epochs: int = 4
    rate: float = 0.5
    seed: int = 11


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int, id_col: str = "doc_id"
) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` labelled documents of up to ``longest`` code points.

    Only of rows that may be learned from, and taken by the hash of the id, so alike on
    every run. Labels that are null, neither 0 nor 1, or contradict each other are left out.
    Rows of equal id and text count once, so a table ingested twice gives the same sample; of
    an id with several texts each is taken, with the label of the id. Null ids have no
    label. No labels, or no documents, give no rows.
    """
    marks = (
        labels.where(~held_out(id_col) & F.col(label).isin(0, 1))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
        .where("_label = _other")
    )
    texts = docs.select(F.col(id_col).alias("_id"), known().alias("_text")).where(F.length("_text") <= longest)
    order = [F.xxhash64("_id"), F.col("_id")]
    # The ids first, so that no text moves but those of the sample.
    ids = texts.select("_id").join(marks, "_id").groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(*order).limit(rows)
    found = texts.join(F.broadcast(ids), "_id").distinct().orderBy(*order, "_text").limit(rows).collect()
    return [(r["_text"], int(r["_label"])) for r in found]


def word_buckets(word: str, t: Training) -> list[int]:
    """Buckets of the word and of the character n-grams in it, its ends marked."""
    marked = f"<{word}>"
    data, n = marked.encode(), len(marked)
    # Where each character begins in UTF-8.
    at = range(n + 1) if len(data) == n else [0, *accumulate(len(c.encode()) for c in marked)]
    grams = [data[at[i] : at[i + k]] for k in range(t.shortest_gram, t.longest_gram + 1) for i in range(n - k + 1)]
    return [crc32(g) % t.buckets for g in (b"w" + data[1:-1], *grams)]


def echoes(words: list[str], t: Training) -> list[int]:
    """For each distance from 1 on, how many words equal the word so many places on."""
    return [sum(map(eq, words, islice(words, k, None))) for k in range(1, t.furthest + 1)]


def echo_buckets(t: Training) -> list[int]:
    return [crc32(b"echo %d" % k) % t.buckets for k in range(1, t.furthest + 1)]


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32, by the rule of its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def gram_sums(words: list[str], weights: np.ndarray, t: Training) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of the weights of its ``word_buckets``, and how many these are: all words side by side."""
    text = "".join([f"<{w}>" for w in words])
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    # Where each character begins, which word it is in, and how many characters of the word are left from it on.
    at = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(of))
    whole = np.fromiter((crc32(w.encode("utf-8", "replace"), _W) for w in words), np.int64, len(words))
    total, count = weights[whole % t.buckets].astype(float), np.ones(len(words), np.int64)
    for k in range(t.shortest_gram, t.longest_gram + 1):
        first = np.flatnonzero(left >= k)
        start, size = at[first], at[first + k] - at[first]
        crc = np.full(len(first), 0xFFFFFFFF, np.uint32)
        for step in range(size.max(initial=0)):
            on = size > step
            byte = data[np.minimum(start + step, len(data) - 1)]
            crc = np.where(on, _CRC[(crc ^ byte) & 0xFF] ^ crc >> 8, crc)
        total += np.bincount(of[first], weights[(~crc).astype(np.int64) % t.buckets], len(words))
        count += np.bincount(of[first], minlength=len(words))
    return total, count


_W = crc32(b"w")
#: Words that are looked up at once.
_STEP = 50_000


@dataclass(frozen=True)
class Model:
    """``weights``: what each bucket adds to the log odds of class 1, before averaging."""

    weights: np.ndarray
    bias: float
    training: Training

    def scorer(self) -> Callable[[list[str]], list[float]]:
        """A function from texts to scores that remembers words met lately."""

        def make(words: list[str]) -> list[tuple[float, int]]:
            total, count = gram_sums(words, self.weights, self.training)
            return list(zip(total.tolist(), count.tolist()))

        recent = Recent(make)
        marks = self.weights[echo_buckets(self.training)].astype(float)

        def some(texts: list[list[str]]) -> Iterator[float]:
            found = recent(list(chain.from_iterable(texts)))
            values = np.array(found, float).reshape(-1, 2)
            # Equal words have the same pair, and others have another.
            same = np.fromiter(map(id, found), np.int64, len(found))
            end = 0
            for words in texts:
                start, end = end, end + len(words)
                own = same[start:end]
                echo = np.array([np.count_nonzero(own[k:] == own[:-k]) for k in range(1, self.training.furthest + 1)])
                total, n = values[start:end].sum(axis=0)
                total, n = total + float(marks @ echo), n + echo.sum()
                yield float(1 / (1 + np.exp(-(self.bias + (total / n if n else 0.0)))))

        def score(texts: list[str]) -> list[float]:
            scores: list[float] = []
            held: list[list[str]] = []
            size = 0
            for at, text in enumerate(texts):
                held.append(text.split())
                size += len(held[-1])
                if size >= _STEP or at == len(texts) - 1:
                    scores += some(held)
                    held, size = [], 0
            return scores

        return score


def fit(rows: list[tuple[str, int]], training: Training = Training()) -> Model:
    """Learns from (text, 0 or 1). Without both classes, every score is the share of ones (0.5 without rows)."""
    t = training
    share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    if not 0 < sum(y for _, y in rows) < len(rows):
        return Model(np.zeros(t.buckets, np.float32), float(np.log(share / (1 - share))), t)
    buckets = Recent(lambda words: [word_buckets(w, t) for w in words])
    given = []
    for text, y in rows:
        words = text.split()
        marks = np.repeat(np.array(echo_buckets(t), np.int32), echoes(words, t))
        flat = np.concatenate([np.fromiter((b for w in buckets(words) for b in w), np.int32), marks])
        ids, counts = np.unique(flat, return_counts=True)
        given.append((ids, (counts / max(1, len(flat))).astype(np.float32), y))
    pick = np.random.default_rng(t.seed)
    vectors = pick.uniform(-1 / t.width, 1 / t.width, (t.buckets, t.width)).astype(np.float32)
    out = np.zeros((2, t.width), np.float32)
    bias = np.log([1 - share, share]).astype(np.float32)
    steps, done = t.epochs * len(given), 0
    for _ in range(t.epochs):
        for at in pick.permutation(len(given)):
            ids, parts, y = given[at]
            rate = t.rate * (1 - done / steps)
            done += 1
            mean = parts @ vectors[ids]
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            # Each part's share of the mean is small, so vectors take a step as if it were the largest.
            vectors[ids] -= (rate / parts.max() if len(ids) else 0) * np.outer(parts, back)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]), t)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted of every document, by its text alone.

    Null texts are empty; empty texts get the score of the bias. Rows that repeat an id
    get a row each, a null id stays null, an empty table gives no rows, and other
    columns of ``docs`` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = pa.array(score(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), known(text_col).alias("text"))
    return given.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score of 0.5 or more, all columns as they are.

    Null texts are empty and get the score of the bias. Rows count one by one, so repeated
    rows stay or go together; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = score([x or "" for x in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([s >= 0.5 for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
