"""Personal data: exact base patterns, and proposals judged by boosted trees.

The base patterns are found exactly. Generators with a high recall propose further
spans, which may overlap; boosted trees judge them by format and context, and a
threshold per kind, set for a wanted precision, decides. Of overlapping spans the
likeliest stays. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.tables import known
from stayrate.llm.trees import Trees, boost, calibrated

#: In the order in which spans that start together are listed; the method's own kinds come last.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE = 4
Span = tuple[str, int, int]

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of these can start inside a run of digits that an earlier start has tried in vain.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match starts in the run of local characters before an @; so go from @ to @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and without overlaps in each kind, in order."""
    spans: list[Span] = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                spans.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40 and 12 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# --- Proposals ---------------------------------------------------------------

# None has a greatest length; runs are possessive, so time stays linear in them.
_NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+")
_HIDDEN_AT = re.compile(r"(?<!\S)[A-Za-z0-9._+-]++\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]++(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]++)+")
_NEAR = 32

# Words beside a span that speak for or against it.
CUES = {
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "apikey"),
    "contact": ("tel", "phone", "call", "mobile", "fax", "contact", "whatsapp", "dial"),
    "money": ("card", "visa", "mastercard", "payment", "iban", "account", "credit"),
    "person": ("ssn", "passport", "licence", "license", "social", "taxpayer", "insured"),
    "mail": ("mail", "email", "write", "reach"),
    "against": ("version", "release", "isbn", "order", "page", "commit", "checksum", "sha", "md5", "hash", "figure", "build", "invoice", "uuid"),
}


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they may overlap."""
    found: list[Span] = []
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            digits = sum(map(str.isdigit, m.group()))
            kind = "card" if digits >= 13 else "id" if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m.group()) else "phone"
            found.append((kind, m.start(), m.end()))
        for m in _TOKEN.finditer(text):
            if _DIGIT.search(m.group()) and re.search("[A-Za-z]", m.group()):
                found.append(("secret", m.start(), m.end()))
    if "at]" in text or "at)" in text or "at ]" in text or "at )" in text:
        found += [("email", m.start(), m.end()) for m in _HIDDEN_AT.finditer(text)]
    return found


def features(text: str, span: Span) -> list[float]:
    """Numbers that describe the format of a span and what stands beside it."""
    kind, start, end = span
    s = text[start:end]
    left, right = text[max(0, start - _NEAR) : start].lower(), text[end : end + _NEAR].lower()
    runs = [len(r) for r in re.findall("[0-9]+", s)] or [0]
    digits, letters = sum(runs), sum(map(str.isalpha, s))
    said = set(re.findall("[a-z0-9]+", left)) | set(re.findall("[a-z0-9]+", right[:16]))
    bare = re.sub("[^0-9]", "", s)
    return [
        float(KINDS.index(kind)), len(s), digits, letters, len(s) - digits - letters, len(runs), max(runs), min(runs),
        digits / len(s), len(set(s)) / len(s), s[0] == "+", "(" in s, s.count("."), s.count("-"), s.count(" "), s.count("/"),
        bool(re.fullmatch("[0-9a-fA-F]+", s)), s.lower() != s and s.upper() != s, 12 <= digits <= 19 and luhn(bare),
        s[:1] == "0", bool(re.match(r"(19|20)[0-9]{2}[-/. ]", s)), *(any(c in said for c in cues) for cues in CUES.values()),
        left[-1:] in "\"'`" and bool(left), bool(re.search(r"[=:]\s?[\"'`]?$", left)), left[-1:].isalnum(), right[:1].isalnum(),
        left[-1:] in "#$€£" and bool(left),
    ]


# --- Learning ----------------------------------------------------------------


@dataclass(frozen=True)
class Training:
    """``rows`` examples are made from formats and cues, a third of them to calibrate on."""

    rows: int = 6000
    precision: float = 0.97
    seed: int = 17


def examples(training: Training = Training()) -> list[tuple[str, Span, int]]:
    """(text, proposed span, 1 if personal). Formats alone, cues alone and both, in made-up words."""
    pick = random.Random(training.seed)
    number = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    word = lambda: "".join(pick.choice(["an", "ti", "re", "on", "es", "la", "que", "ion", "sch", "er"]) for _ in range(pick.randint(1, 4)))
    code = lambda chars, n: "".join(pick.choice(chars) for _ in range(n))
    hexes, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def valid_card() -> str:
        body = number(15)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def cue(name: str) -> str:
        return pick.choice(CUES[name])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}", f"+{number(2)} {a} {b}{c}", f"+1 ({a}) {b}-{c}"])

    personal: list[Callable[[], str]] = [
        phone, phone, lambda: f"{cue('contact')}: {phone()}", lambda: f"{cue('contact')} {number(pick.randint(9, 11))}",
        valid_card, lambda: " ".join(re.findall("....", valid_card())), lambda: f"{cue('money')} {number(16)}", lambda: f"{cue('money')}: {valid_card()}",
        lambda: f"{cue('person')} {number(3)}-{number(2)}-{number(4)}", lambda: f"{number(3)}-{number(2)}-{number(4)}",
        lambda: f'{cue("secret")} = "{code(hexes, pick.choice([28, 32, 36, 40, 64]))}"', lambda: f"{cue('secret')}: {code(mixed, pick.randint(20, 48))}",
        lambda: f'{cue("secret")}="{code(mixed + "_-", pick.randint(20, 40))}"', lambda: f"{cue('secret')} {code(hexes, 32)}",
        lambda: f"{word()}.{word()} [at] {word()}.com", lambda: f"{word()}{number(2)} (at) {word()} (dot) org", lambda: f"{cue('mail')} {word()}(at){word()}.net",
    ]
    other: list[Callable[[], str]] = [
        lambda: f"{cue('against')} {number(pick.randint(7, 18))}", lambda: f"{cue('against')} {code(hexes, pick.choice([32, 40, 64]))}",
        lambda: number(pick.randint(7, 18)), lambda: number(16), lambda: f"20{number(2)}-0{pick.randint(1, 9)}-1{pick.randint(0, 9)}",
        lambda: f"19{number(2)}/1{pick.randint(0, 2)}/2{pick.randint(0, 9)}", lambda: f"{number(1)}.{number(2)}.{number(3)}.{number(2)}",
        lambda: f"${number(3)}.{number(3)}.{number(3)}", lambda: " ".join(number(2) for _ in range(pick.randint(4, 9))),
        lambda: f"{cue('against')} {number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}", lambda: f"{word()}-{word()}-{word()}-{number(2)}-{word()}{word()}",
        lambda: f"{word()}/{word()}{word()}/{number(4)}/{word()}", lambda: code(hexes, pick.choice([32, 40])), lambda: f"{word()}{word()}{word()}{word()}{number(2)}{word()}",
        lambda: f"{number(4)}-{number(4)}", lambda: f"{number(3)} {number(3)} {number(3)}", lambda: f"{word()}_{word()}_{word()}_{word()}{number(1)}",
    ]
    rows = []
    while len(rows) < training.rows:
        label = pick.random() < 0.5
        middle = pick.choice(personal if label else other)()
        text = " ".join(word() for _ in range(pick.randint(0, 6))) + " " * (pick.random() < 0.95) + middle
        begin = len(text) - len(middle)
        text += pick.choice(["", ".", ",", " "]) + " " + " ".join(word() for _ in range(pick.randint(0, 6)))
        rows += [(text, s, int(label)) for s in proposals(text) if s[2] > begin and (not label or s[2] - s[1] >= 7)]
    return rows[: training.rows]


@dataclass(frozen=True)
class Model:
    trees: Trees
    thresholds: dict[str, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans beyond ``base``: proposals over their kind's threshold, the likeliest of those that overlap."""
        taken = [(s, e) for _, s, e in base]
        open_ = [p for p in proposals(text) if not any(s < p[2] and p[1] < e for s, e in taken)]
        if not open_:
            return []
        chances = self.trees.probability(np.array([features(text, p) for p in open_], float))
        chosen: list[Span] = []
        for at in np.argsort(-chances, kind="stable"):
            kind, start, end = open_[at]
            if chances[at] >= self.thresholds[kind] and not any(s < end and start < e for _, s, e in chosen):
                chosen.append(open_[at])
        return chosen

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        return base, in_order(base + self.added(text, base))


def fit(training: Training = Training()) -> Model:
    """Grows trees on two thirds of the examples, calibrates on the rest, and sets each kind's threshold there.

    A threshold is the lowest at which the wanted share of what it selects is personal
    data; a kind without such a threshold adds no span.
    """
    rows = examples(training)
    x, y = np.array([features(t, s) for t, s, _ in rows], float), np.array([label for *_, label in rows], float)
    rest = np.arange(len(rows)) % 3 == 0
    trees = calibrated(boost(x[~rest], y[~rest]), x[rest], y[rest])
    chance, thresholds = trees.probability(x[rest]), {}
    for code, kind in enumerate(KINDS):
        own = x[rest][:, 0] == code
        order = np.argsort(-chance[own])
        right = np.cumsum(y[rest][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= training.precision)
        thresholds[kind] = max(0.5, float(chance[own][order][good[-1]])) if len(good) else 2.0
    return Model(trees, thresholds)


# --- Tables ------------------------------------------------------------------


def found(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans.

    Returns id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans. Null texts are
    empty and have no spans. Rows that repeat an id get a row each, a null id stays
    null, an empty table gives no rows, and other columns of ``docs`` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, said = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = model.spans(text)
                kinds = [kind for kind, _, _ in base]
                counts.append([kinds.count(k) for k in KINDS[:BASE]])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                said.append(written(every))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * BASE
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, pa.array(digests, pa.string()), pa.array(said, pa.string())], names)

    names = [id_col, *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in names[1 : 1 + BASE]) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), known(text_col).alias("text")).mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span as its kind in brackets; overlapping spans become one."""
    parts, end = [], 0
    for kind, start, stop in spans:
        if start >= end:
            parts += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*parts, text[end:]])


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with redacted texts, and n_chars, where there, as the new length; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [None if t is None else redact(t, model.spans(t)[1]) for t in old]
            names = batch.schema.names
            batch = batch.set_column(names.index("text"), "text", pa.array(new, pa.string()))
            if "n_chars" in names:
                sizes = [n if a == b else len(b) for n, a, b in zip(batch.column("n_chars").to_pylist(), old, new)]
                at = names.index("n_chars")
                batch = batch.set_column(at, "n_chars", pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
