from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from stayrate.llm import licenses
from stayrate.llm.catalog import QUERIES
from tests.llm.cases import awkward, frame, words

W = licenses.Weights(licenses.TEMPLATES)


def brute_best(text):
    counts = Counter(re.findall("[a-z0-9]+", text.lower()))
    value = {w: c * W.idf.get(w, W.unseen) for w, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    scores = []
    for (name, own), length in zip(W.rows, W.norms):
        dot = sum(value[w] * c * W.idf[w] for w, c in own.items() if w in value)
        scores.append((-round(dot / norm / length, 6), name))
    low, name = min(scores)
    return name, -low


def known(text):
    return len(set(re.findall("[a-z0-9]+", text.lower())) & set(W.idf))


def sides(text):
    text = text.strip(" \t\n\x0b\f\r")
    if re.search(r"\n[\x20\x09\x0B-\x0D]*\n", text):
        return re.split(r"\n[\x20\x09\x0B-\x0D]*\n", text, maxsplit=1)
    return text.rsplit("\n", 1)


def brute(text):
    text = text or ""
    # The operator's statements end where the header block does as well: a single break before the last line.
    runs = [s for side in sides(text) for s in re.split(r"\n(?:[^A-Za-z0-9\n]*\n)+|(?<=[.!?])[\x20\x09-\x0D]+", side) if "\n" in s]
    found = [s for s in re.split(r"\n|(?<=[.!?])[\x20\x09\x0B-\x0D]+", text) + runs + [text] if known(s) > 1]
    similar = [(n, s) for n, s in map(brute_best, found) if s >= W.threshold]
    return min(similar, key=lambda x: (-x[1], x[0]), default=None)


NOTICES = [
    "Licensed under the Apache License, Version 2.0.", "licensed under the apache license version 2.0", "Some words. Released under the MIT License. More words here.",
    "Licensed under CC BY 4.0.\nrest", "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "SPDX-License-Identifier: GPL-3.0-only", "// SPDX-License-Identifier: MIT",
    "This work is licensed under the GNU General Public License, version 2.", "The license of this dog is under debate in the general public.", "licensed", "Apache", "mit",
    "This is licensed under the GNU General Public License, version 3 of it.",
]


def test_scores_equal_brute_force(spark):
    texts = NOTICES + [t for t in awkward() if len(t or "") < 3000] + [words(200, 3) + ".\n" + NOTICES[0] + "\n" + words(50, 4)]
    texts += ["the license of the " * 4000 + words(3000, 5), (NOTICES[0][:-1] + " ") * 60 + "dog cat dog Dog " * 9, "spdx license identifier mit dog dog dog", "version 2 0 apache\u0130 K license"]
    rows = licenses.scanned(frame(spark, texts), F.lit("d"), F.lit(False)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = brute(texts[r.doc_id])
        assert (r.own, r.own_score) == (expected or (None, None)), texts[r.doc_id]


def test_every_template_finds_itself_and_the_filter_loses_no_similar_statement():
    needed = set(W.needed())
    for (name, counts), norm in zip(W.rows, W.norms):
        rest = math.sqrt(sum((c * W.idf[w]) ** 2 for w, c in counts.items() if w not in needed))
        assert rest < W.threshold * norm
    # The search for them grows with their number; there were 25 templates for the bound of 40 words, now there are more.
    assert len(needed) * 25 < 40 * len(W.rows) and not needed & {"the", "with", "and", "this"}


def test_nearest_directory_above_rules(spark):
    schema = "doc_id long, text string, dir string, rules boolean, own string, directory string, name string, h long"
    mit, apache, by = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY 4.0."
    rows = [
        (0, mit + "\nwords", "a", True), (1, apache, "a/b", False), (2, "x", "a/b/c", None), (3, "x", "a/bc", False), (4, "x", "z", False),
        (5, by + " more words of another kind", "a/b/c", False), (6, "x", None, False), (7, apache + "\nx y", "m", True), (8, mit + "\nx y", "m", True),
        (9, mit + "\ny", "m", True), (10, None, "m/n", False), (11, "x", "", False), (12, by + "\nz", "t", True), (13, apache + "\nz", "t", True), (14, "x", "t", False),
        (None, "x", "a", False),
    ]
    docs = spark.createDataFrame([(*r, "c", "c", "c", 1) for r in rows], schema)
    found = {r.doc_id: (r.license, r.license_directory, r.basis) for r in licenses.scanned(docs, F.col("dir"), F.col("rules")).collect()}
    assert found[0] == ("MIT", None, "own") and found[1] == ("Apache-2.0", None, "own") and found[5][0] == "CC-BY-4.0"
    assert found[2] == ("Apache-2.0", "a/b", "inherited") and found[3] == ("MIT", "a", "inherited")
    assert found[4] == found[6] == found[11] == (None, None, "none")
    assert found[10] == ("MIT", "m", "inherited") and found[14] == ("Apache-2.0", "t", "inherited") and found[None] == ("MIT", "a", "inherited")
    assert licenses.scanned(frame(spark, []), F.col("source"), F.lit(False)).collect() == []


def test_a_notice_in_the_header_block_rules_the_directory(spark, tmp_path):
    cc0, mit, apache = "Released under CC0 1.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = {
        "cc0": cc0 + "\n" + words(40, 1), "long": words(60, 2) + ". " + mit + " " + words(60, 3), "title": "\n \nThe title\nCopyright 2020 A.\n" + apache + "\n\n" + mit,
        "below": "The title\n \n" + mit + "\n" + words(9, 4), "none": words(30, 5),
        "foot": words(30, 6) + "\n" + words(30, 7) + "\n" + mit + " All rights reserved.\n", "end": words(30, 6) + ". " + mit,
    }
    rows = [(k, t, s, "en") for k, (s, t) in enumerate(texts.items())] + [(10 + k, "plain words", s, "en") for k, s in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.license, r.basis) for r in QUERIES["op7_licenses"](spark, str(tmp_path)).collect()}
    assert [found[10 + k] for k in range(7)] == [
        ("CC0-1.0", "inherited"), ("MIT", "inherited"), ("Apache-2.0", "inherited"), (None, "none"), (None, "none"), (None, "none"), (None, "none"),
    ]
    assert found[3] == found[5] == found[6] == ("MIT", "own")


FILES = {
    "MIT": """The MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
""",
    "GPL-3.0": """# A program for something.
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.

import something
""",
    "LGPL-2.1": """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 */

int x;
""",
    "Apache-2.0": """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.
""",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Preamble\n\n Words of it.",
    "BSD-3-Clause": """Some conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "CC-BY-4.0": "Title\n\nThis work is licensed under a Creative Commons Attribution 4.0 International License.\nMore.",
}
SAID = {
    "The MIT License (MIT)": "MIT", "This software is released under the MIT License, see LICENSE.": "MIT", "MIT": None, "mit": None,
    "This work is licensed under a\nCreative Commons Attribution-ShareAlike 4.0\nInternational License.\nEnd.": "CC-BY-SA-4.0",
    "The museum got a license for its software from the general public, and apache helicopters are under version 2 of a plan.": None,
    "We compare the MIT License with the Apache License and the GNU General Public License in the next chapter of this book.": None,
    "Er kommt mit dem Zug, mit dem Rad oder\nmit dem Bus.\nEnde": None,
}


def test_licence_files_headers_over_lines_and_prose(spark):
    texts = [*FILES.values(), *SAID]
    rows = {r.doc_id: r for r in licenses.scanned(frame(spark, texts), F.lit("d"), F.lit(False)).collect()}
    assert [rows[i].own for i in range(len(texts))] == [*FILES, *SAID.values()]
    for i, text in enumerate(texts):
        assert (rows[i].own, rows[i].own_score) == (brute(text) or (None, None)), text
    assert [r.license for r in licenses.scanned(frame(spark, [FILES["GPL-3.0"], "plain"]), F.lit("d")).orderBy("doc_id").collect()] == ["GPL-3.0"] * 2
