from __future__ import annotations

import random
import re

import pytest

from stayrate.llm import line_dedup
from tests.llm.cases import CLASH, awkward, frame, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def parts(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def close(a, b):
    return a == b or (min(len(a), len(b)) >= line_dedup.SHORT and abs(len(a) - len(b)) < 2 and distance(a, b) < 2)


def brute(texts):
    seen, found = [], {}
    for i, t in enumerate(texts):
        equal, near = [], []
        rows = [(at, parts(x)) for at, x in enumerate((t or "").split("\n"))]
        rows = [(at, w) for at, w in rows if w]
        for at, w in rows:
            if w in seen and not any(v != w and close(v, w) for v in seen[: seen.index(w)]):
                equal.append(at)
            elif w in seen:
                equal.append(at)
            elif any(close(v, w) for v in seen):
                near.append(at)
            seen.append(w)
        found[i] = (len(rows), len(equal), len(near), ",".join(map(str, sorted(equal + near))))
    return found


def result(df):
    return {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.dropped) for r in df.collect()}


def edited(line, pick):
    w = line.split()
    for _ in range(pick.choice([0, 1, 1, 1, 2])):
        at = pick.randrange(len(w))
        how = pick.choice(["put", "cut", "change", "swap"])
        if how == "put":
            w.insert(at, pick.choice(["new", w[at]]))
        elif how == "cut" and len(w) > 1:
            del w[at]
        elif how == "change":
            w[at] = "other"
        elif at:
            w[at - 1], w[at] = w[at], w[at - 1]
    return pick.choice([" ", "  ", "\t"]).join(w)


def test_lines_that_go_equal_brute_force(spark):
    pick = random.Random(8)
    stock = [words(pick.choice([1, 2, 7, 8, 9, 10, 17, 30]), i) for i in range(25)] + ["a a a a a a a a a", "b b b b b b b b"]
    texts = ["\n".join(edited(pick.choice(stock), pick) for _ in range(pick.randrange(1, 9))) + pick.choice(["", "\n", "\n \n"]) for _ in range(45)]
    texts += [t for t in awkward() if len(t or "") < 3000]
    assert result(line_dedup.counted(frame(spark, texts, CLASH))) == brute(texts)


def test_template_lines_link_to_the_earliest_without_pairs(spark):
    texts = [f"page {i} of the long printed report about many other things" for i in range(400)]
    rows = line_dedup.counted(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows if r.n_near) == list(range(1, 400))


def test_very_long_lines(spark):
    line = words(20_000, 4).split()
    changed = " ".join([*line[:9000], "x", *line[9001:]])
    texts = [" ".join(line), changed, " ".join(line[:-1]), " ".join(line[2:])]
    assert result(line_dedup.counted(frame(spark, texts))) == {0: (1, 0, 0, ""), 1: (1, 0, 1, "0"), 2: (1, 0, 1, "0"), 3: (1, 0, 0, "")}


@pytest.mark.parametrize("a,b", [("a b c", "a b c"), ("a b c", "a b"), ("b c", "a b c"), ("a x c", "a b c"), ("a b c", "c b a"), ("a b c d", "b a c d"), ("a", "b")])
def test_within_equals_edit_distance(spark, a, b):
    row = spark.createDataFrame([(a.split(), b.split())], "a array<string>, b array<string>").select(line_dedup.within("a", "b").alias("w")).first()
    assert row.w == (distance(a.split(), b.split()) <= 1)


def test_texts_without_the_lines(spark):
    long = "one two three four five six seven eight nine"
    texts = [f"{long}\n\nx", f"y\n{long} ten\n{long}\n\nx\nz", None, ""]
    docs = frame(spark, texts, CLASH)
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: texts[0], 1: "y\n\nz", 2: None, 3: ""}
    assert line_dedup.counted(frame(spark, [])).collect() == []


def test_rows_count_one_by_one(spark):
    # A null id comes first; rows of one id in the order in which they are stored.
    null = spark.createDataFrame([(1, "a"), (None, "a\na"), (None, "b")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.dropped) for r in line_dedup.counted(null).collect()), key=str) == [(1, "0"), (None, ""), (None, "1")]
    assert sorted((tuple(r) for r in line_dedup.dedup(null).collect()), key=str) == [(1, ""), (None, "a"), (None, "b")]
    line, mine, own = "one two three four five six seven eight nine", "only here: four five six seven eight", "z y x w v u t s"
    rows = [(1, f"{line}\n{mine}"), (2, f"{line}\nq"), (2, f"{own}\nr"), (2, f"{line}\nq")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, id long").coalesce(1)
    found = sorted((r.doc_id, r.n_lines, r.dropped) for r in line_dedup.counted(docs).collect())
    assert found == [(1, 2, ""), (2, 2, ""), (2, 2, "0"), (2, 2, "0,1")]
    assert sorted(r.text for r in line_dedup.dedup(docs).collect()) == sorted([rows[0][1], "q", rows[2][1], ""])


def test_rows_of_files_count_one_by_one(spark, tmp_path):
    docs = frame(spark, ["a\nb", "c"]).repartition(2)
    for _ in range(2):
        docs.write.mode("append").parquet(str(tmp_path / "twice"))
    rows = line_dedup.counted(spark.read.parquet(str(tmp_path / "twice"))).collect()
    assert sorted((r.doc_id, r.dropped) for r in rows) == [(0, ""), (0, "0,1"), (1, ""), (1, "0")]
