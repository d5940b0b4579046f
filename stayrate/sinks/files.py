"""Feature table, prediction and report outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import half_even, quoted

CSV = {"header": True, "escape": '"'}


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Overwrite the feature table and return a DataFrame that reads it back."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**CSV).csv(path)
        return df.sparkSession.read.schema(df.schema).options(**CSV).csv(path)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Written:
    """A table read back, and what was counted while it was written."""

    table: DataFrame
    rows: int
    nulls: dict[str, int]

    def gaps(self) -> DataFrame:
        """(rows, column, nulls), one row per column, without another scan."""
        found = [(self.rows, c, n) for c, n in self.nulls.items()]
        return self.table.sparkSession.createDataFrame(found, "rows bigint, column string, nulls bigint")


def write_counted(df: DataFrame, path: str, fmt: str = "parquet") -> Written:
    """Write the feature table and count its rows and gaps in the same pass.

    The counts are those of the tasks that wrote: a retried task counts once.
    """
    counted = Observation()
    gaps = [F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    table = write_features(df.observe(counted, F.count(F.lit(1)).alias("rows"), *gaps), path, fmt)
    got = counted.get
    return Written(table, got["rows"], {c: got[f"n{i}"] for i, c in enumerate(df.columns)})


def prediction_table(scored: DataFrame, label: str, features: list[str], id: str) -> DataFrame:
    """Test features with actual class, predicted class and probability (4 digits)."""
    return scored.select(
        id,
        *[F.col(f"`{c}`") for c in features],
        F.col(label).cast("int").alias("actual_churn"),
        F.col("prediction").cast("int").alias("predicted_churn"),
        half_even(F.col("score"), 4).alias("churn_probability"),
    )


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.options(**CSV).csv(path) if fmt == "csv" else writer.parquet(path)


def write_report(spark: SparkSession, text: str, path: str) -> None:
    """One text file; the text is a page long, whatever the size of the data."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
