"""The registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from stayrate.llm import (
    bpe,
    decontamination,
    exact_dedup,
    licenses,
    line_dedup,
    negatives,
    packing,
    pii,
    quality,
    rules,
    sharding,
    simhash,
    vector_codes,
)
from stayrate.llm.tables import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.counted(read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(read(spark, sf_dir, "documents"), pii.fit())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, training = read(spark, sf_dir, "documents"), quality.Training()
    rows = quality.sample(docs, read(spark, sf_dir, "labels"), "quality", training.rows, training.longest)
    return quality.scored(docs, quality.fit(rows, training))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories are source/lang; a text with a notice in its header block speaks for its directory."""
    return licenses.scanned(read(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, training = read(spark, sf_dir, "documents"), rules.Training()
    rows = quality.sample(docs, read(spark, sf_dir, "labels"), "quality", training.rows, training.longest)
    return rules.judged(docs, rules.fit(rows, training), training)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.counted(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; ids divisible by 7 have the next label."""
    given = read(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mined(given.withColumn("label", shifted), F.col("vec_id") % 50 == 0)
    return found.drop("anchor_row", "positive_row", "negative_row")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_dedup, op2_exact_dedup, op3_pii, op4_quality, op5_simhash, op6_sharding, op7_licenses, op8_bpe, op9_rules,
        op10_packing, op11_decontamination, op12_negatives, op13_vector_codes,
    )
}

_OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_OP11 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0)),
spots AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT r, i, n, item_id FROM spots JOIN windows USING (win, n)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP12 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a, v AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positives AS p JOIN pairs AS n
    ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


def _lloyd_round(k: int) -> str:
    """The codebooks after round ``k`` from those before it, and the parts assigned to the latter."""
    return f"""
near_{k} AS MATERIALIZED (
  SELECT vec_id, label, p, x, arg_min(e, (distance, e)) AS e, min(distance) AS distance FROM (
    SELECT vec_id, label, cut.p, x, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
    FROM cut JOIN book_{k} ON cut.p = book_{k}.p) GROUP BY ALL),
totals_{k} AS (
  SELECT p, e, place, sum(c) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS place FROM near_{k}) GROUP BY ALL),
book_{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(z, y) AS y FROM book_{k} LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS z FROM totals_{k} GROUP BY ALL) USING (p, e))"""


_OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS q FROM embeddings WHERE {_FINITE}),
cut AS MATERIALIZED (
  SELECT vec_id, label, p, q[p * (len(q) // 8) + 1:(p + 1) * (len(q) // 8)] AS x FROM v, range(8) AS t(p)),
book_0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y
  FROM cut WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
{",".join(_lloyd_round(k) for k in range(7))},
coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(distance) AS BIGINT) AS error
  FROM near_6 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, place))
   FROM (SELECT p, e, unnest(y) AS c, unnest(range(len(y))) AS place FROM book_6)) AS codebooks_sha256
FROM coded
"""

ORACLE: dict[str, str] = {
    "op2_exact_dedup": _OP2,
    "op11_decontamination": _OP11,
    "op12_negatives": _OP12,
    "op13_vector_codes": _OP13,
}
