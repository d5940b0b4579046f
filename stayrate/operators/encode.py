"""Category columns to 0/1 features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..session import durable


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for every non-null value of the columns, in one scan."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequent_categories(df: DataFrame, columns: Sequence[str], min_count: int) -> DataFrame:
    return category_counts(df, columns).where(F.col("n") >= min_count)


def category_lists(
    df: DataFrame, columns: Sequence[str], min_count: int, max_categories: int
) -> dict[str, list[str]]:
    """The frequent values of each column, for use as column names.

    Only names come to the driver, and never more than ``max_categories`` of
    them: a wider one-hot table is an error, not a cut.
    """
    names = frequent_categories(df, columns, min_count).select("column", "value")
    rows = names.limit(max_categories + 1).collect()
    if len(rows) > max_categories:
        raise ValueError(
            f"more than {max_categories} frequent categories; raise min_count or max_categories, "
            "or use one_hot_long or category_vectors"
        )
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        found[row["column"]].append(row["value"])
    return {c: sorted(values) for c, values in found.items()}


def one_hot_wide(df: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replace each column by one 0/1 column per listed value (null gives 0s)."""
    dummies = {
        f"{c}_{v}": F.coalesce((F.col(quoted(c)).cast("string") == F.lit(v)).cast("int"), F.lit(0))
        for c, values in categories.items()
        for v in values
    }
    return df.withColumns(dummies).drop(*categories)


def one_hot_long(df: DataFrame, id: str, columns: Sequence[str], min_count: int) -> DataFrame:
    """(id, feature) rows for the 1s of the one-hot table, for any number of values.

    The kept categories are stored first: with its size known, Spark broadcasts
    the list while that is small, and else joins by shuffle with skew handling.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value"))
            for c in columns
        ]
    )
    rows = df.select(id, F.inline(pairs))
    kept = durable(frequent_categories(df, columns, min_count).select("column", "value"))
    return rows.join(kept, ["column", "value"], "left_semi").select(
        id, F.concat_ws("_", "column", "value").alias("feature")
    )


MARK = "="


@dataclass(frozen=True)
class Categories:
    """How category columns become sparse 0/1 vectors, one place per frequent category.

    ``names`` has the category of each place, ``stages`` turn the columns that
    ``with_texts`` adds into the vectors of ``vectors``, one per column.
    """

    columns: list[str]
    names: list[str]
    stages: list[Transformer]

    @property
    def vectors(self) -> list[str]:
        return [f"_dummies{i}" for i in range(len(self.columns))]

    def with_texts(self, df: DataFrame) -> DataFrame:
        """Add the columns as text under plain names; marked, as the stages take no empty text."""
        return df.withColumns(
            {f"_text{i}": F.concat(F.lit(MARK), F.col(quoted(c)).cast("string")) for i, c in enumerate(self.columns)}
        )


def category_vectors(df: DataFrame, columns: Sequence[str], min_count: int) -> Categories:
    """Vectors for any number of frequent categories; rare values, new ones and null have no 1.

    The same features as ``one_hot_wide``, but a row carries only its 1s, so neither
    the plan nor a row grows with the categories. Their names come to the driver, which
    has to name the features of a model in any case: at most rows / ``min_count`` a column.
    """
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in frequent_categories(df, columns, min_count).select("column", "value").toLocalIterator():
        found[row["column"]].append(row["value"])
    lists = {c: sorted(values) for c, values in found.items() if values}
    names = [f"{c}_{v}" for c, values in lists.items() for v in values]
    if not lists:
        return Categories([], [], [])
    texts, places = ([f"{name}{i}" for i in range(len(lists))] for name in ("_text", "_place"))
    indexers = [
        StringIndexerModel.from_labels([MARK + v for v in values], text, place, handleInvalid="keep")
        for values, text, place in zip(lists.values(), texts, places)
    ]
    # The last place is that of values that are not listed: it is dropped. Sizes come from the indexers, no row is read.
    placed = df.sparkSession.createDataFrame([], ", ".join(f"{t} string" for t in texts))
    for indexer in indexers:
        placed = indexer.transform(placed)
    encoder = OneHotEncoder(inputCols=places, outputCols=[f"_dummies{i}" for i in range(len(lists))], dropLast=True)
    return Categories(list(lists), names, [*indexers, encoder.fit(placed)])


def active_categories(df: DataFrame, id: str, categories: Categories) -> DataFrame:
    """(id, feature) rows: the name of each 1 in the vectors of a row."""
    if not categories.columns:
        return df.select(id, F.lit("").alias("feature")).limit(0)
    rows = categories.with_texts(df)
    for stage in [*categories.stages, VectorAssembler(inputCols=categories.vectors, outputCol="_all")]:
        rows = stage.transform(rows)
    places = F.filter(F.transform(vector_to_array("_all"), lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    names = F.array(*[F.lit(n) for n in categories.names])
    return rows.select(id, F.explode(places).alias("_at")).select(id, F.get(names, F.col("_at")).alias("feature"))
