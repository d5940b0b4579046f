"""Rows with every awkward case, and small helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, score double, fp long, h long, shard int, piece int, norm string, _gone long, size long, label int"


def words(n: int, seed: int = 0) -> str:
    pick = random.Random(seed)
    names = ["alpha", "beta", "gamma", "delta", "été", "straße", "ñandú", "x", "longer-word", "7", "and", "of", "the"]
    return " ".join(pick.choice(names) + str(pick.randrange(400)) for _ in range(n))


def awkward() -> list[str | None]:
    """Null, empty, blank, tied, repeated and very long texts."""
    long = words(30_000, 5)
    base = words(60, 1)
    return [
        None, "", "   ", "\t\n\x0b\f\r ", base, base, base.replace(" ", "\n"), base + " ", base + " more",
        long, long + " tail", long.replace(" ", "  "), "a" * 50_000, "a" * 50_001, "日本語" * 4000, "日本語" * 4000 + "x",
        " ", "😀 😀", "😀😀", "\x1c", "A b C", "a b c", words(300, 2), words(300, 3), words(300, 3).upper(),
    ]


def frame(spark, texts, schema: str = SCHEMA):
    n = schema.count(",") + 1
    rows = [(i, t, "en", "s", None if t is None else len(t), *([None] * (n - 5))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)
