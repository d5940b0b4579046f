"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Weights come from the templates: a word in few templates weighs much, a word in none
as much as one in a single template. Every statement of a text (a sentence or line, or a
sentence that runs over lines, as in licence files and comments) and the text as a whole are
compared. A statement with fewer than two words of templates is similar to none. Words that any
similar statement must have find the few texts worth comparing; that loses none (see ``needed``).
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.tables import known
from stayrate.session import durable

THRESHOLD = 0.8
#: Scores are rounded to six digits; bounds on them allow for that.
_SLACK = 1e-6

# Usual notices, headers, and titles and telling sentences of licence files, by their SPDX names.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "This project is licensed under the Apache License 2.0.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "This software is released under the MIT License, see LICENSE.",
        "This project is licensed under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "AGPL-3.0": (
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "LGPL-2.1": (
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "BSD 2-Clause License"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International",
    ),
    "CC0-1.0": ("Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal"),
}

_WORD = "[a-z0-9]+"
#: Ends of statements: line ends, and white space after a sentence's end.
_ENDS = r"\n|(?<=[.!?])[\x20\x09\x0B-\x0D]+"
#: Ends of sentences that run over lines: lines without letters or digits, and white space after a sentence's end.
_RUNS = r"\n(?:[^A-Za-z0-9\n]*\n)+|(?<=[.!?])[\x20\x09-\x0D]+"
#: What parts the header block from the rest: the first blank line, else the last line's or (in a single line) statement's start.
_BLANK, _LAST, _END = r"\n[\x20\x09\x0B-\x0D]*\n", r"\n(?=[^\n]*\z)", r"(?<=[.!?])[\x20\x09\x0B-\x0D]+"


class Weights:
    """TF-IDF vectors of the templates."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.rows = [(name, Counter(re.findall(_WORD, text.lower()))) for name, texts in templates.items() for text in texts]
        seen = Counter(w for _, counts in self.rows for w in counts)
        self.unseen = math.log(1 + len(self.rows)) + 1
        self.idf = {w: math.log((1 + len(self.rows)) / (1 + n)) + 1 for w, n in seen.items()}
        self.norms = [math.sqrt(sum((c * self.idf[w]) ** 2 for w, c in counts.items())) for _, counts in self.rows]

    def needed(self) -> list[str]:
        """Words of which every statement that is similar enough to a template has one.

        A statement with none of some words of a template has a cosine of at most what the
        other words make of the template's length. Any words will do: first those of templates
        before, then the rarest of at least five letters, which are seldom common words.
        """
        found = set()
        for (_, counts), norm in zip(self.rows, self.norms):
            rest = norm**2
            for w, c in sorted(counts.items(), key=lambda x: (x[0] not in found, len(x[0]) < 5, -self.idf[x[0]], x[0])):
                if math.sqrt(max(rest, 0)) < self.threshold * norm:
                    break
                found.add(w)
                rest -= (c * self.idf[w]) ** 2
        return sorted(found)


def _dot(term: Column, own: Column) -> Column:
    return F.aggregate(term, F.lit(0.0), lambda s, t: s + t["v"] * F.coalesce(own[t["w"]], F.lit(0.0)))


def _similar(parts: DataFrame, weights: Weights) -> DataFrame:
    """``parts`` (with a column part) that are similar enough to a template, with name and score; ties to the first name.

    Words in no template only add to a statement's length, by at least as much as if all of
    them were equally frequent. Where that bound leaves no template similar enough, their
    counts are not worked out.
    """
    names = sorted(weights.idf)
    vocabulary = F.array(*map(F.lit, names))
    idf = F.create_map(*(x for w in names for x in (F.lit(w), F.lit(weights.idf[w]))))
    times = lambda w: F.size(F.filter("words", lambda x: x == w))
    total = lambda terms, of: F.aggregate(terms, F.lit(0.0), lambda s, t: s + of(t))
    cut = _held(parts, "words", F.regexp_extract_all(F.lower("part"), F.lit(_WORD), F.lit(0)))
    counted = F.transform(F.array_intersect("words", vocabulary), lambda w: F.struct(w.alias("w"), times(w).alias("n"), idf[w].alias("idf")))
    cut = _held(cut, "term", F.transform(counted, lambda t: F.struct(t["w"].alias("w"), t["n"].alias("n"), (t["n"] * t["idf"]).alias("v"))))
    cut = _held(cut.where(F.size("term") > 1), "inside", total(F.col("term"), lambda t: t["v"] * t["v"]))
    others = F.size("words") - total(F.col("term"), lambda t: t["n"])
    cut = _held(cut, "least", F.col("inside") + weights.unseen**2 * others * others / F.greatest(F.size(F.array_except("words", vocabulary)), F.lit(1)))
    cut = cut.where(F.col("inside") >= (weights.threshold - _SLACK) ** 2 * F.col("least"))
    dots = []
    for (name, counts), length in zip(weights.rows, weights.norms):
        own = F.create_map(*(x for w, c in sorted(counts.items()) for x in (F.lit(w), F.lit(c * weights.idf[w] / length))))
        dots.append(F.struct(_dot(F.col("term"), own).alias("dot"), F.lit(name).alias("name")))
    cut = _held(cut, "dots", F.array(*dots)).where(F.array_max("dots.dot") >= (weights.threshold - _SLACK) * F.sqrt("least"))
    norm = F.sqrt(F.col("inside") + weights.unseen**2 * _squares(F.filter("words", lambda x: ~F.array_contains(vocabulary, x))))
    cut = _held(cut, "norm", norm)
    scores = F.transform("dots", lambda d: F.struct((-F.round(d["dot"] / F.col("norm"), 6)).alias("minus"), d["name"].alias("name")))
    best = _held(cut, "best", F.array_min(scores))
    return best.where(-F.col("best.minus") >= weights.threshold).select("*", (-F.col("best.minus")).alias("score"), "best.name")


def _squares(words: Column) -> Column:
    """The sum of the squared counts of the words: sorted, the k-th of a kind adds 2 k - 1."""
    start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(s: Column, w: Column) -> Column:
        run = F.when(s["word"] == w, s["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(w.alias("word"), (run + 1).alias("run"), (s["sum"] + 2 * run + 1).alias("sum"))

    return F.aggregate(F.array_sort(words), start, step, lambda s: s["sum"])


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row, and not again in each filter and lambda that uses it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def statements(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, name, score, whole and head of every statement, and every text as a whole, that is similar enough to a template.

    A sentence that runs over lines is compared besides its lines.

    head: the statement is in the text's header block, the lines up to its first blank line. A header is
    followed by something: the last line of a text without blank lines (of a single line, its last statement) is in none.
    """
    needed = "(?i)(?<![a-z0-9])(?:" + "|".join(weights.needed()) + ")(?![a-z0-9])"
    hit = docs.select(F.col(id_col).alias("id"), known(text_col).alias("text")).where(F.col("text").rlike(needed))
    # Each of these ends a statement as well, so the two sides have the statements of the text.
    trimmed = _held(hit, "trimmed", F.trim("text", F.lit(" \t\n\x0b\f\r")))
    line = F.split("trimmed", _END)
    single = F.array(F.array_join(F.slice(line, F.lit(1), F.size(line) - 1), " "), F.element_at(line, -1))
    sides = F.when(F.col("trimmed").rlike(_BLANK), F.split("trimmed", _BLANK, 2)).when(F.col("trimmed").contains("\n"), F.split("trimmed", _LAST, 2))
    sides = _held(trimmed, "sides", sides.otherwise(single))
    item = lambda x, whole, head: F.struct(x.alias("part"), F.lit(whole).alias("whole"), F.lit(head).alias("head"))
    said = lambda side, head: F.transform(F.filter(F.split(side, _ENDS), lambda x: x.rlike(needed)), lambda x: item(x, False, head))
    runs = lambda side, head: F.transform(F.filter(F.split(side, _RUNS), lambda x: x.contains("\n") & x.rlike(needed)), lambda x: item(x, False, head))
    first, second = F.get("sides", F.lit(0)), F.get("sides", F.lit(1))
    none = F.array().cast("array<struct<part:string,whole:boolean,head:boolean>>")
    either = [F.coalesce(x, none) for x in (said(first, True), runs(first, True), said(second, False), runs(second, False))]
    parts = F.concat(*either, F.array(item(F.col("text"), True, False)))
    every = sides.select("id", F.explode_outer(parts).alias("p")).select("id", "p.part", "p.whole", "p.head")
    return _similar(every, weights).select("id", "name", "score", "whole", "head")


def scanned(
    docs: DataFrame, directory: Column, statement_of_directory: Column | None = None, weights: Weights | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document with its licence: its own, else that of the nearest directory above it.

    ``directory`` is the path of a document's directory, parts joined by '/';
    ``statement_of_directory`` says which documents' licence holds for their whole
    directory (besides texts that are a licence as a whole); without it those do that have
    a notice in their header block, with the most similar notice there. Where several do, the licence
    with the most of them holds, ties to the first name. A document with several notices
    has the most similar one, ties to the first name. Returns id_col, directory, own,
    own_score, license, license_directory ('' for the root) and basis ('own', 'inherited' or 'none'). Null texts
    are empty and a null directory is the root ''. Ids are taken to be unique; a null id has no notice of its own.
    An empty table gives no rows; other columns of ``docs`` play no part.
    """
    weights = weights or Weights(TEMPLATES)
    ranked = F.struct((-F.col("score")).alias("minus"), "name")
    found = durable(
        statements(docs, weights, id_col, text_col)
        .groupBy("id")
        .agg(F.min(ranked).alias("best"), F.max("whole").alias("whole"), F.min(F.when(F.col("head"), ranked)).alias("top"))
        .select("id", F.col("best.name").alias("own"), (-F.col("best.minus")).alias("own_score"), "whole", F.col("top.name").alias("top"))
    )
    rules = F.lit(None).cast("boolean") if statement_of_directory is None else F.coalesce(statement_of_directory, F.lit(False))
    placed = docs.select(F.col(id_col).alias("id"), F.coalesce(directory, F.lit("")).alias("directory"), rules.alias("rules"))
    own = durable(placed.join(found, "id", "left"))
    voice = F.when(F.col("rules") | F.col("whole"), F.col("own")) if statement_of_directory is not None else F.coalesce("top", F.when(F.col("whole"), F.col("own")))
    votes = own.select("directory", voice.alias("own")).where("own is not null").groupBy("directory", "own").agg(F.count("*").alias("n"))
    ruled = votes.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("minus"), "own")).alias("best")).select(F.col("directory").alias("above"), F.col("best.own").alias("license"))
    # Every directory with each directory above it; the longest that rules is the nearest.
    parts = F.split("directory", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    paths = own.select("directory").distinct().select("directory", F.explode(F.array_distinct(above)).alias("above"))
    near = paths.join(ruled, "above").groupBy("directory").agg(F.max(F.struct(F.length("above").alias("l"), "above", "license")).alias("n"))
    inherited = durable(near.select("directory", F.col("n.above").alias("license_directory"), F.col("n.license").alias("inherited")))
    return own.join(inherited, "directory", "left").select(
        F.col("id").alias(id_col), "directory", "own", "own_score", F.coalesce("own", "inherited").alias("license"),
        F.when(F.col("own").isNull(), F.col("license_directory")).alias("license_directory"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("basis"),
    )
