"""Nearest rows of a table by random hyperplanes: several orders, compared in blocks.

Each table of the index orders the rows by the sides of random hyperplanes on which
they lie, so rows with a long common start of sides stand together, and cuts this order into
blocks of even size. Rows are compared within their blocks only. A block never exceeds
the given size, whatever the number of rows on the same sides, so the work is rows x tables x block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.columns import quoted
from ..session import durable
from .ordered import running_totals, with_even_bucket

#: Steps of a standard deviation in which features are held: distances are exact whole numbers.
STEPS = 1024
#: Hyperplanes of a table; with the number of the table they fit the 53 bits of a double.
SIDES = 44
#: Rows that place the hyperplanes. They decide how evenly rows fall on both sides, and nothing else.
SAMPLE = 2000
#: Rows of a block that are held against the block at a time.
AT_ONCE = 64


def standard_steps(df: DataFrame, features: Sequence[str]) -> Column:
    """The standardised features as an array of whole numbers; 0 where a feature does not vary. Reads ``df`` once."""
    stats = df.agg(
        *[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_samp(quoted(f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    return F.array(
        *[
            F.floor((F.col(quoted(f)) - stats[f"m{i}"]) / stats[f"s{i}"] * STEPS).cast("bigint")
            if stats[f"s{i}"]
            else F.lit(0).cast("bigint")
            for i, f in enumerate(features)
        ]
    )


def nearest(
    df: DataFrame,
    id: str,
    features: Sequence[str],
    hash: Column,
    hash_range: int,
    k: int = 5,
    tables: int = 16,
    block: int = 512,
    seed: int = 42,
) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest other rows by standardised features.

    ``distance`` is squared Euclidean, in steps of 1/1024 deviation; equal ones are ordered by hash and id.
    Exact where the rows fit a block; beyond, a neighbour counts if any table puts it into
    the same block. At most ``tables`` x k proposals of a row are merged. Ids must be unique and
    features not null. Tables without rows give none.
    """
    kind = df.schema[id].dataType
    vectors = durable(df.select(F.col(id).alias("id"), hash.cast("bigint").alias("hash"), standard_steps(df, features).alias("v")))
    n = vectors.count()
    sample = [r.v for r in vectors.orderBy("hash", "id").limit(SAMPLE).select("v").collect()]
    if not sample:
        return _merged(vectors.select("id", F.col("id").alias("neighbour"), F.lit(0).cast("bigint").alias("distance"), "hash"), k, id)
    blocks = -(-n // block)
    # A single block needs no second table.
    tables = 1 if blocks == 1 else tables
    sides = _sides(np.array(sample, dtype=np.float64), tables, seed)
    keyed = vectors.select("id", "hash", "v").mapInPandas(
        sides, StructType([StructField("id", kind), StructField("hash", LongType()), StructField("keys", ArrayType(LongType()))])
    )
    order = keyed.select("id", "hash", F.posexplode("keys").alias("table", "key")).withColumn(
        "value", (F.col("table") * F.lit(2.0**SIDES) + F.col("key")).cast("double")
    )
    # Stored: the cuts and the buckets read it.
    order = durable(order.drop("key"))
    placed = running_totals(with_even_bucket(order, "value", "hash", hash_range), ["value", "hash", "id"], {"rows": F.lit(1)})
    place = F.col("rows_before") - F.col("table") * F.lit(n)
    blocked = placed.select("id", "table", F.floor(place * F.lit(blocks) / F.lit(n)).alias("block"))
    proposed = (
        blocked.join(vectors, "id")
        .groupBy("table", "block")
        .applyInPandas(
            _compared(k),
            StructType(
                [StructField("id", kind), StructField("neighbour", kind), StructField("distance", LongType()), StructField("hash", LongType())]
            ),
        )
    )
    return _merged(proposed, k, id)


def _sides(sample: np.ndarray, tables: int, seed: int):
    """A function that adds the side of every hyperplane, as one number a table.

    Hyperplanes stand between the 0.3 and 0.7 quantiles of the sample along a random direction.
    """
    pick = np.random.default_rng(seed)
    # Far-off values would decide every side: directions weigh a feature by its middle half.
    spread = np.maximum(np.quantile(sample, 0.9, axis=0) - np.quantile(sample, 0.1, axis=0), STEPS)
    directions = pick.standard_normal((sample.shape[1], tables * SIDES)) / spread[:, None]
    along = sample @ directions
    at = pick.uniform(0.3, 0.7, directions.shape[1])
    cuts = np.array([np.quantile(along[:, j], at[j]) for j in range(along.shape[1])])
    weights = 1 << np.arange(SIDES - 1, -1, -1, dtype=np.int64)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            above = np.stack(rows["v"].to_numpy()) @ directions > cuts
            keys = above.reshape(len(rows), tables, SIDES) @ weights
            yield pd.DataFrame({"id": rows["id"], "hash": rows["hash"], "keys": list(keys)})

    return add


def _compared(k: int):
    """A function that gives the k nearest others of every row of a block."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hash", "id"]).reset_index(drop=True)
        v = np.stack(rows["v"].to_numpy())
        reach = min(k, len(rows) - 1)
        near, far = [], []
        for start in range(0, len(rows), AT_ONCE):
            part = v[start : start + AT_ONCE]
            distance = ((part[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
            own = np.arange(len(part))
            distance[own, start + own] = np.iinfo(np.int64).max
            # A stable sort leaves equal distances in the order of the rows.
            best = np.argsort(distance, axis=1, kind="stable")[:, :reach]
            near.append(best.ravel())
            far.append(np.take_along_axis(distance, best, axis=1).ravel())
        other = np.concatenate(near)
        return pd.DataFrame(
            {
                "id": rows["id"].repeat(reach).to_numpy(),
                "neighbour": rows["id"].to_numpy()[other],
                "distance": np.concatenate(far),
                "hash": rows["hash"].to_numpy()[other],
            }
        )

    return compare


def _merged(proposed: DataFrame, k: int, id: str) -> DataFrame:
    """The k best of a row's proposals; those of several tables repeat."""
    others = proposed.where(F.col("id") != F.col("neighbour"))
    best = others.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "hash", "neighbour"))), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("rank", "other")).select(
        F.col("id").alias(id), (F.col("rank") + 1).alias("rank"), F.col("other.neighbour").alias("neighbour"), F.col("other.distance").alias("distance")
    )
