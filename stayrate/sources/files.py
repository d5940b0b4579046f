"""CSV and Parquet scans with a declared schema."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    IntegralType,
    StringType,
    StructField,
    StructType,
)

from ..config import Layout
from ..session import durable

# The cell texts that users' CSV files use for a missing value.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def client_schema(layout: Layout = Layout()) -> StructType:
    """Declared types of the customer table; dates arrive as text."""
    integers = [layout.label, "nb_prod_act", "num_years_antig"]
    texts = [layout.id, *layout.category_columns, *layout.flag_columns, *layout.date_columns]
    doubles = list(
        dict.fromkeys(
            [
                *layout.log_columns,
                "net_margin",
                "pow_max",
                "margin_gross_pow_ele",
                "margin_net_pow_ele",
            ]
        )
    )
    fields = [StructField(c, StringType()) for c in texts]
    fields += [StructField(c, IntegerType()) for c in integers]
    fields += [StructField(c, DoubleType()) for c in doubles]
    return StructType(fields)


def price_schema(layout: Layout = Layout()) -> StructType:
    fields = [StructField(layout.id, StringType()), StructField(layout.price_date, StringType())]
    return StructType(fields + [StructField(c, DoubleType()) for c in layout.price_columns])


def _typed(name: str, field: StructField | None) -> Column:
    column = F.col(f"`{name}`")
    text = F.when(~F.trim(column).isin(*MISSING_TOKENS), column)
    if field is None or isinstance(field.dataType, StringType):
        return text.alias(name)
    if isinstance(field.dataType, IntegralType):
        # A column with gaps is often written as 1.0, 2.0, ...
        number = text.cast("decimal(38,10)")
        broken = F.raise_error(F.concat(F.lit(f"{name} is not whole: "), text))
        return F.when(number == F.floor(number), number.cast(field.dataType)).when(number.isNotNull(), broken).alias(name)
    return text.cast(field.dataType).alias(name)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Scan CSV files with a header row.

    Columns are matched to ``schema`` by name, so files may order them freely or
    carry more of them. One pass over the columns without a declared type decides
    theirs: double if every value is a number, else text. All files
    of a folder must have the same header; another order or name is an error, as
    Spark would take cells by position. Missing value tokens become null before the
    cast; a malformed number, or a fraction in a column of whole numbers, is an error.
    """
    declared = {f.name: f for f in (schema.fields if schema else [])}
    # A quote inside a quoted cell is written twice.
    raw = spark.read.options(header=True, mode="FAILFAST", escape='"', enforceSchema=False).csv(path)
    if schema is not None:
        declared |= _numeric_fields(raw, [c for c in raw.columns if c not in declared])
    return raw.select(*[_typed(name, declared.get(name)) for name in raw.columns])


def _numeric_fields(raw: DataFrame, names: list[str]) -> dict[str, StructField]:
    """The columns of ``names`` that hold numbers and missing values alone, and at least one number."""
    if not names:
        return {}
    given = [_typed(c, None).alias(f"c{i}") for i, c in enumerate(names)]
    number = {f"c{i}": F.col(f"c{i}").try_cast("double") for i in range(len(names))}
    fit = raw.select(*given).agg(
        *[((F.count(c) > 0) & (F.count(c) == F.count(n))).alias(c) for c, n in number.items()]
    ).first()
    return {c: StructField(c, DoubleType()) for i, c in enumerate(names) if fit[f"c{i}"]}


@dataclass(frozen=True)
class Scanned:
    """Rows of a scan, and the records that could not be read: (file, record, reason)."""

    table: DataFrame
    rejects: DataFrame


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | None = None) -> Scanned:
    """Scan CSV files with unlike headers, and set broken records aside.

    Files are grouped by their header and read by name, so each may order its columns
    in its own way; a column that a file lacks is null there. A record with too few or too many
    cells, or with a cell that its declared type does not take, is a reject with its reason,
    as many as there are, and no row. Types of undeclared columns are decided from the
    good records, as in ``read_csv``. One pass finds the headers, one parses and
    stores the cells. Without a file that has a header the table has the declared columns and no rows.
    """
    declared = {f.name: f for f in (schema.fields if schema else [])}
    groups = _headers(spark, path)
    names = list(dict.fromkeys(c for header, _ in groups for c in header))
    if not groups:
        empty = spark.createDataFrame([], schema or StructType([]))
        return Scanned(empty, spark.createDataFrame([], "file string, record string, reason string"))
    line, file = (_free(c, names) for c in ("_line", "_file"))
    cells = durable(
        reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [_cells(spark, header, files, line, file) for header, files in groups],
        )
    )
    wrong = {c: _wrong(c, declared[c]) for c in names if c in declared and not isinstance(declared[c].dataType, StringType)}
    notes = [F.when(F.col(f"`{line}`").isNotNull(), "number of cells")]
    notes += [F.when(F.col(f"`{line}`").isNull() & w, F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c, w in wrong.items()]
    good = cells.where(F.col(f"`{line}`").isNull() & ~reduce(Column.__or__, wrong.values(), F.lit(False)))
    if schema is not None:
        declared |= _numeric_fields(good, [c for c in names if c not in declared])
    table = good.select(*[_typed(c, declared.get(c)) for c in names])
    record = F.coalesce(F.col(f"`{line}`"), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names]), {"escape": '"'}))
    rejects = cells.select(F.col(f"`{file}`").alias("file"), record.alias("record"), F.concat_ws("; ", *notes).alias("reason"))
    return Scanned(table, rejects.where("reason <> ''"))


def _free(name: str, names: Sequence[str]) -> str:
    taken = {c.lower() for c in names}
    while name in taken:
        name += "_"
    return name


def _headers(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """Each header with its files, in the order of the files' names. The driver lists the files of any scan."""
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place")
    )
    # The ids grow along a file's first block.
    first = lines.where("file_block_start = 0 and value <> ''").groupBy("file_path").agg(F.min_by("value", "place").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file_path").collect():
        groups.setdefault(row["header"], []).append(row["file_path"])
    parsed = [(next(csv.reader([header.lstrip("\ufeff").rstrip("\r")])), files) for header, files in groups.items()]
    for header, files in parsed:
        if len({c.lower() for c in header}) < len(header):
            raise ValueError(f"{files[0]} names a column twice")
    return parsed


def _cells(spark: SparkSession, header: list[str], files: list[str], line: str, file: str) -> DataFrame:
    """The cells of files of one header as text; ``line`` holds a record that has another number of them."""
    fields = StructType([StructField(c, StringType()) for c in [*header, line]])
    reader = spark.read.schema(fields).options(header=True, mode="PERMISSIVE", escape='"', columnNameOfCorruptRecord=line)
    # The metadata names files as URLs; a reader takes paths, and patterns among them.
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(f)) for f in files]
    return reader.csv(plain).select("*", F.col("_metadata.file_path").alias(file))


def _wrong(name: str, field: StructField) -> Column:
    """Whether a cell holds a text that its type does not take."""
    column = F.col(f"`{name}`")
    text = F.when(~F.trim(column).isin(*MISSING_TOKENS), column)
    taken = text.try_cast(field.dataType)
    if isinstance(field.dataType, IntegralType):
        number = text.try_cast("decimal(38,10)")
        taken = F.when(number == F.floor(number), number.try_cast(field.dataType))
    return text.isNotNull() & taken.isNull()


def read_parquet(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """Scan Parquet files; NaN in a float column becomes null, as in the CSV scan.

    A declared schema saves the job that reads it from a file footer.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null(reader.parquet(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark's avg and max do not skip NaN, so NaN must not pass the scan."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats})


def drop_artefact(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Remove the index column that some CSV writers add; no error if absent."""
    return df.drop(layout.index_artefact)


def require_ids(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Fail on a null id, which an equi-join would drop without a word."""
    id = F.col(layout.id)
    return df.withColumn(layout.id, F.when(id.isNull(), F.raise_error(F.lit("null id"))).otherwise(id))


def parse_dates(df: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    """Parse ``yyyy-MM-dd`` text; bad text is null, or an error if ``strict``."""
    fmt = "yyyy-MM-dd"
    done = {f.name for f in df.schema.fields if isinstance(f.dataType, DateType)}
    parse = (lambda c: F.to_date(c, fmt)) if strict else (lambda c: F.try_to_date(c, fmt))
    return df.withColumns({c: parse(c) for c in columns if c in df.columns and c not in done})
