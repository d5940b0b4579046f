"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. A stage's result is written as Parquet and read
again as the documents of the next. Null texts are empty texts: the classifier
scores them, and of those that it keeps one stays. Rows count one by one: of repeated
rows one stays, as of equal texts under one id; rows without an id are documents
like others. No text is too long. An empty table gives no rows, and other columns
go through all stages but the last untouched, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stayrate.llm import exact_dedup, packing, pii, quality, simhash
from stayrate.llm.tables import read
from stayrate.session import durable


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    training = quality.Training()
    rows = quality.sample(docs, read(spark, sf_dir, "labels"), "quality", training.rows, training.longest)
    return quality.accepted(docs, quality.fit(rows, training))


def unequal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.dedup(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of word triples are linked: at most two differing bits."""
    return simhash.dedup(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs, pii.fit())


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, as little-endian numbers, and their places in training sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", unequal),
    ("SimHash near-dedup", unlike),
    ("PII", private),
    ("best-fit packing", sequences),
]

#: A trained classifier, fingerprints and a tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = durable(docs)
    return docs
