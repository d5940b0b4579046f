"""Quality rules: base measures, and a linear-chain model that marks lines as content or boilerplate.

Each line of words has binary features; a conditional random field, fitted on a bounded
sample of labelled documents, gives the weights, and Viterbi decoding the marks. A
document stays if it passes the base rules and enough of its words are in content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.tables import known

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"

#: Names of the line features, in the order of their weights; shares are cut into steps.
STEPS = {
    "words": (2, 4, 8, 16, 32, 64, 128),
    "symbols": (0.005, 0.02, 0.05, 0.1, 0.2),
    "marks": (0.02, 0.05, 0.1, 0.2),
    "capitals": (0.05, 0.15, 0.4, 0.7),
    "digits": (0.02, 0.1, 0.3),
    "distinct": (0.2, 0.4, 0.6, 0.8),
    "word_length": (2.5, 3.5, 5.0, 7.0, 10.0),
}
FLAGS = ("always", "ends_sentence", "starts_upper", "seen_before", "first", "last")
_BASES = np.cumsum([0, *(len(s) + 1 for s in STEPS.values())])
#: Symbols, other marks, capital letters and digits.
_CLASSES = [re.compile(f"[{c}]") for c in (re.escape(SYMBOLS), r"!?;:=_~^{}\[\]\\/", "A-ZÀ-ÖØ-Þ", "0-9")]
WIDTH = int(_BASES[-1]) + len(FLAGS)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    if len(words) <= window:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - window + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.sort(mixed)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))
    first: dict[tuple[bytes, ...], int] = {}  # equal codes are not yet equal words
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        key = tuple(words[i : i + window])
        before = first.setdefault(key, i)
        if before != i:
            for j in {before, i}:
                covered[j] += 1
                covered[j + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.encode().split()  # bytes part at \x20 and \x09-\x0D alone
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeats = repeated_words(words)
    n = len(words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, n < 20 or 100 * repeats > 30 * n


def line_features(lines: list[str]) -> list[list[int]]:
    """The features that hold for each line; all lines have a word."""
    seen: set[str] = set()
    found = []
    for at, line in enumerate(lines):
        words = line.split() or [line]
        size = len(line)
        symbols, marks, capitals, digits = (len(c.findall(line)) for c in _CLASSES)
        values = (len(words), symbols / size, marks / size, capitals / size, digits / size, len(set(words)) / len(words), size / len(words))
        active = [int(b) + sum(v > s for s in steps) for b, v, steps in zip(_BASES, values, STEPS.values())]
        flags = (True, line.rstrip()[-1:] in ".!?:;\"'", line.lstrip()[:1].isupper(), line in seen, at == 0, at == len(lines) - 1)
        seen.add(line)
        found.append(active + [int(_BASES[-1]) + k for k, on in enumerate(flags) if on])
    return found


@dataclass(frozen=True)
class Training:
    """``rows`` labelled documents of up to ``longest`` code points are learned from."""

    rows: int = 1500
    longest: int = 20_000
    epochs: int = 5
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 23
    content_share: float = 0.5


@dataclass(frozen=True)
class Chain:
    """Weights of state 0 (boilerplate) and 1 (content) per feature, and of each step between states."""

    emit: np.ndarray
    step: np.ndarray

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[:, f].sum(axis=1) for f in features])

    def viterbi(self, features: list[list[int]]) -> list[int]:
        """The likeliest states; of equally likely ones, content."""
        table = self.odds
        (s00, s01), (s10, s11) = self.step.tolist()
        zero = one = 0.0
        back = []
        for at, active in enumerate(features):
            gain = sum([table[f] for f in active])  # content over boilerplate
            if at:
                from0, from1 = (zero + s00, one + s10), (zero + s01, one + s11)
                back.append((int(from0[1] >= from0[0]), int(from1[1] >= from1[0])))
                zero, one = max(from0), max(from1)
            one += gain
        states = [int(one >= zero)] if features else []
        for step in reversed(back):
            states.append(step[states[-1]])
        return states[::-1]

    @property
    def odds(self) -> list[float]:
        return (self.emit[1] - self.emit[0]).tolist()


def fit(rows: list[tuple[str, int]], training: Training = Training()) -> Chain:
    """Learns from (text, 1 for content or 0 for boilerplate), each line having its text's label.

    Likelihood of the label sequence by forward and backward sums, one document a step.
    Documents of both labels are joined in pairs, so that steps between states occur.
    Without both labels every line is content.
    """
    emit, step = np.zeros((2, WIDTH)), np.zeros((2, 2))
    if len({y for _, y in rows}) < 2:
        emit[1, int(_BASES[-1])] = 1.0
        return Chain(emit, step)
    pick = np.random.default_rng(training.seed)
    given = [(line_features(_lines(t)), y) for t, y in rows]
    given = [(f, y) for f, y in given if f]
    for epoch in range(training.epochs):
        order = pick.permutation(len(given))
        for i, j in zip(order, np.roll(order, 1)):
            features = given[i][0] + given[j][0]
            states = np.array([given[i][1]] * len(given[i][0]) + [given[j][1]] * len(given[j][0]))
            _learn(emit, step, features, states, training.rate / (1 + epoch), training.decay)
    return Chain(emit, step)


def _learn(emit: np.ndarray, step: np.ndarray, features: list[list[int]], states: np.ndarray, rate: float, decay: float) -> None:
    n = len(features)
    score = np.array([emit[:, f].sum(axis=1) for f in features])
    score = np.exp(score - score.max(axis=1, keepdims=True))
    move = np.exp(step)
    ahead, behind = np.empty((n, 2)), np.ones((n, 2))
    ahead[0] = score[0] / score[0].sum()
    for t in range(1, n):
        ahead[t] = (ahead[t - 1] @ move) * score[t]
        ahead[t] /= ahead[t].sum()
    for t in range(n - 2, -1, -1):
        behind[t] = move @ (score[t + 1] * behind[t + 1])
        behind[t] /= behind[t].sum()
    p = ahead * behind
    p /= p.sum(axis=1, keepdims=True)
    gap = -p
    gap[np.arange(n), states] += 1
    for f, g in zip(features, gap):
        emit[:, f] += rate * g[:, None]
    if n > 1:
        pair = ahead[:-1, :, None] * move[None] * (score[1:] * behind[1:])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (states[:-1], states[1:]), 1)
        step += rate * (seen - pair.sum(axis=0)) / n
    emit *= 1 - rate * decay
    step *= 1 - rate * decay


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(_SPACE)]


def content_share(text: str, chain: Chain) -> float:
    """The share of the words that lie in lines marked as content; 0 without words."""
    lines = _lines(text)
    sizes = [len(x.encode().split()) for x in lines]
    states = chain.viterbi(line_features(lines))
    return sum(n for n, s in zip(sizes, states) if s) / sum(sizes) if lines else 0.0


def judged(docs: DataFrame, chain: Chain, training: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base measures, base_failed, content_share and kept.

    Null and empty texts have no words and fail. Rows that repeat an id get a row each,
    a null id stays null, an empty table gives no rows, and other columns of ``docs``
    play no part. Returns id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, content_share.
    """
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, share = measures(text), content_share(text, chain)
                rows.append((*base, not base[-1] and share >= training.content_share, share))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in names[1:6]) + ", base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col(id_col).alias("id"), known(text_col).alias("text")).mapInArrow(run, schema)
