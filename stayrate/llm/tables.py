"""Reading the given tables, and small helpers that several operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.session import durable

#: The six white-space characters that the contracts name: \\x20 and \\x09-\\x0D.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known(text: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text), F.lit(""))


def numbered(docs: DataFrame, *order: Column) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: what tells a row from all others, and a key that no other row has.

    A row of a table that is read from Parquet as it is stored has its place there (a 64-bit
    hash of the file's path, and the row); other tables are stored with a number. The key is a
    struct that sorts by ``order`` and then by the first column, its last field, ``row``.
    """
    taken = {name.lower() for name in docs.columns}
    row, key = (next(x for k in range(len(taken) + 1) if (x := name + "_" * k) not in taken) for name in ("_row", "_key"))
    stored = _placed(docs, row)
    if stored is None:
        stored = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    fields = [x.alias(f"o{k}") for k, x in enumerate(order)]
    return stored.withColumn(key, F.struct(*fields, F.col(row).alias("row"))), row, key


def _placed(docs: DataFrame, row: str) -> DataFrame | None:
    """``docs`` with the place of each row, if it is a plain scan of Parquet files."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" and not plan.nodeName().startswith("Relation"):
        return None
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.withColumn(row, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at")))
    except AnalysisException:
        return None


def put_back(df: DataFrame, docs: DataFrame, key: str, names: list[str], how: str = "inner") -> DataFrame:
    """``docs`` joined with the columns ``names`` of ``df``, which may clash with columns of ``docs``.

    The named columns of ``df`` win; every other column of ``docs`` stays as it is.
    """
    return docs.drop(*names).join(df.select(key, *names), key, how)
