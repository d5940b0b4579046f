from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stayrate.llm import exact_dedup
from tests.llm.cases import CLASH, awkward, frame, words


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    found = {}
    for (i, _), n in zip(rows, norm):
        same = [(-len(t or ""), j) for (j, t), m in zip(rows, norm) if m == n]
        keep = min(same)[1]
        found[i] = (keep, len(same), keep == i, hashlib.sha256(n.encode()).hexdigest())
    return found


def result(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


@pytest.mark.parametrize(
    "identify",
    [exact_dedup.digest, lambda c: F.length(c).cast("bigint"), lambda c: F.lit(1).cast("bigint")],
    ids=["hash", "length", "constant"],
)
def test_groups_equal_brute_force_even_if_identifiers_clash(spark, identify):
    texts = awkward() + [words(400, s) for s in range(12)] + [words(400, 3).replace(" ", "")]
    docs = frame(spark, texts)
    assert result(exact_dedup.groups(docs, identify=identify)) == brute(list(enumerate(texts)))


def test_extra_columns_and_order(spark):
    docs = frame(spark, awkward(), CLASH)
    assert result(exact_dedup.groups(docs)) == brute(list(enumerate(awkward())))
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in brute(list(enumerate(awkward()))).items() if v[2]}


def test_empty_table_null_ids_and_repeated_rows(spark):
    empty = frame(spark, [])
    assert exact_dedup.groups(empty).collect() == []
    assert exact_dedup.dedup(empty).collect() == []
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    rows = sorted(exact_dedup.groups(docs).collect(), key=str)
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows] == [
        (1, None, 2, False), (2, 2, 2, True), (2, 2, 2, True), (None, None, 2, True),
    ]


def test_chunks_cover_the_text_and_find_their_cuts_again(spark):
    text = words(4000, 9).replace(" ", "")
    pattern = exact_dedup.chunk_pattern()
    df = spark.createDataFrame([(text,), ("x" * 77 + text,), ("日本" * 9000,)], "t string")
    a, b, c = (r.c for r in df.select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("c")).collect())
    assert "".join(a) == text and "".join(c) == "日本" * 9000
    assert max(map(len, a)) <= exact_dedup.MOST and len(a) > 8
    assert len(set(a) & set(b)) > 0.6 * len(a)


def test_dedup_counts_rows_and_not_ids(spark, tmp_path):
    rows = [(None, "a"), (1, " a"), (None, "b"), (2, "c"), (2, "d"), (3, "c c"), (4, "e"), (4, "e"), (4, None), (5, "cc ")]
    for clash in ("", ", _row long, _key string"):
        docs = spark.createDataFrame([(*r, *([None] * clash.count(","))) for r in rows], f"doc_id long, text string{clash}")
        docs.write.parquet(f"{tmp_path}/docs{len(clash)}")
        for table in (docs, spark.read.parquet(f"{tmp_path}/docs{len(clash)}")):
            kept = exact_dedup.dedup(table)
            assert kept.columns == docs.columns
            found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
            assert found == sorted([(1, " a"), (None, "b"), (2, "c"), (2, "d"), (3, "c c"), (4, "e"), (4, None)], key=str)
