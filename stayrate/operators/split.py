"""Deterministic stratified split, folds, class weights and oversampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..session import durable
from .neighbours import nearest
from .ordered import ranks

HASH_RANGE = 2**32
#: Repeats of a row that one task makes at a time.
COPIES = 4096


def integer_hash(id: str | Column) -> Column:
    """Multiplicative hash of an integer id, in [0, 2^32)."""
    key = F.pmod(F.col(id) if isinstance(id, str) else id, F.lit(2**31))
    return F.pmod(key.cast("bigint") * F.lit(2654435761), F.lit(HASH_RANGE))


def text_hash(id: str | Column) -> Column:
    """Hash of an id of any type, in [0, 2^32)."""
    return F.pmod(F.xxhash64(id), F.lit(HASH_RANGE))


def stratified_split(
    df: DataFrame,
    id: str,
    label: str,
    test_share: float = 0.25,
    folds: int = 5,
    hash: Column | None = None,
) -> DataFrame:
    """Add ``split`` ('test' or 'train') and ``fold`` (0.. in train, -1 in test).

    Rows of each class are ranked by a hash of their id. The first
    ceil(share * class size) are the test part, the rest are cut into folds of
    equal size. Depends on ids alone, so a re-run or a retried task gives the
    same split, whatever the partitioning. Only keys are ranked, when this is
    called; of them come the last key of each part, and a row of ``df`` finds its
    part by comparing its key, without a join. An id that repeats is an error;
    rows without a label belong to no class and are left out.
    """
    value = (text_hash(id) if hash is None else hash).cast("bigint")
    rows = df.where(F.col(label).isNotNull())
    keys = durable(rows.select(id, label, value.alias("_hash")))
    _require_unique(keys, id)
    if set(df.columns) == {id, label}:
        rows = keys.select(*df.columns)
    size = F.col("group_size")
    test_size = F.ceil(size * F.lit(test_share))
    ends = [test_size] + [test_size + F.ceil((size - test_size) * k / folds) for k in range(1, folds)]
    named = F.array(*[e.cast("bigint") for e in ends])
    # A row per class and part, whatever the number of rows.
    last = (
        ranks(keys, [label], "_hash", id, HASH_RANGE)
        .withColumn("ends", named)
        .where((F.col("rank") == 1) | F.array_contains("ends", F.col("rank")))
        .collect()
    )
    part = F.lit(None).cast("int")
    kind = keys.schema[id].dataType

    def key(hashed: Column, own: Column) -> Column:
        return F.struct(hashed.cast("bigint").alias("hash"), own.cast(kind).alias("id"))

    own = key(value, F.col(id))
    for of_class in {r[label] for r in last}:
        at = {r["rank"]: key(F.lit(r["_hash"]), F.lit(r[id])) for r in last if r[label] == of_class}
        cuts = next(r["ends"] for r in last if r[label] == of_class)
        # A part that ends before the first row has no row: every key is past it.
        passed = sum(((own > at[end]).cast("int") if end else F.lit(1) for end in cuts), F.lit(0))
        part = F.when(F.col(label) == of_class, passed).otherwise(part)
    return rows.withColumns(
        {"split": F.when(part == 0, "test").otherwise("train"), "fold": part.cast("int") - 1}
    )


def _require_unique(keys: DataFrame, id: str) -> None:
    twice = keys.groupBy(id).count().where(F.col("count") > 1).first()
    if twice:
        raise ValueError(f"id {twice[id]} has {twice['count']} rows")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class, so the totals over all classes are a tiny aggregate.
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")))
    total = totals.scalar()
    weight = total.getField("rows") / (total.getField("classes") * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def with_class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Add the balanced weight of a 0/1 label.

    The two class sizes come in as one scalar row: a join on the label would
    send nearly all rows to the task of the larger class.
    """
    sizes = df.agg(
        F.struct(
            F.count_if(F.col(label) == 1).alias("ones"),
            F.count_if(F.col(label) == 0).alias("zeros"),
        )
    ).scalar()
    ones, zeros = sizes.getField("ones"), sizes.getField("zeros")
    # A row without a label belongs to no class and has no weight.
    own = F.when(F.col(label) == 1, ones).when(F.col(label) == 0, zeros)
    return df.withColumn(weight, (ones + zeros) / (2 * own))


def oversample(
    df: DataFrame, id: str, label: str, minority: int = 1, hash: Column | None = None
) -> DataFrame:
    """Repeat the rows of the minority class until both classes have equal size.

    Each row is repeated floor(majority / minority) times; the first rows in
    hash order take one more to make up the remainder. ``copy`` numbers the
    repeats from 1. Repeats are made in blocks that are dealt out first, so a few
    rows that stand against very many do not make them all in one task. Rows
    without a label are left out.
    """
    value = text_hash(id) if hash is None else hash
    few = df.where(F.col(label) == minority)
    keys = few.select(id, value.alias("_hash"))
    ranked = ranks(keys, [], "_hash", id, HASH_RANGE).select(id, "rank", "group_size")
    largest = (
        df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).scalar()
    )
    times = F.floor(largest / F.col("group_size")) + (
        F.col("rank") <= F.pmod(largest, F.col("group_size"))
    ).cast("int")
    block = F.col("_block") * COPIES
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = (
        few.join(ranked.select(id, times.cast("bigint").alias("_times")), id)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_times") - 1) / COPIES))))
        .repartition(tasks, F.col(id), F.col("_block"))
        .withColumn("copy", F.explode(F.sequence((block + 1).cast("int"), F.least(F.col("_times"), block + COPIES).cast("int"))))
        .drop("_times", "_block")
    )
    others = df.where(F.col(label) != minority).withColumn("copy", F.lit(1))
    return others.unionByName(repeated)


def synthetic_minority(
    df: DataFrame,
    id: str,
    label: str,
    features: Sequence[str],
    minority: int = 1,
    neighbours: int = 5,
    seed: int = 42,
    hash: Column | None = None,
) -> DataFrame:
    """Even out the classes with new minority rows between neighbouring ones.

    Neighbours are the nearest rows of the class by all standardised features, as
    ``neighbours.nearest`` finds them: exact for a class that fits a block. A new row lies
    at a random place on the line from its origin (``id``) to the neighbour, which the copies
    take in turn; ``copy`` is 1 for given rows. A class of a single row repeats it. Features
    must not be null. ``df`` is read several times, so pass a stored table.
    """
    value = text_hash(id) if hash is None else hash
    rows = df.select(
        id, label, *[F.col(quoted(f)).cast("double").alias(f) for f in features]
    )
    few = rows.where(F.col(label) == minority)
    found = durable(nearest(few, id, features, value, HASH_RANGE, neighbours, seed=seed))

    missing = oversample(df.select(id, label), id, label, minority, value).where(F.col("copy") > 1)
    # A row has as many neighbours as the class has others, or as were asked for.
    lists = found.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("_near"))
    step = F.pmod(F.col("copy") - 2, F.size("_near"))
    other = F.coalesce(F.when(F.col("_near").isNotNull(), F.get("_near", step)["neighbour"]), F.col(id))
    origins = missing.join(few.drop(label), id).join(lists, id, "left").withColumn("_other", other).drop("_near")
    others = few.select(
        F.col(id).alias("_other"),
        *[F.col(quoted(f)).alias(f"_o{i}") for i, f in enumerate(features)],
    )
    # Odd multiples of the id's hash spread the copies of a row along the line.
    part = F.pmod(value * (2 * F.col("copy") + 1), F.lit(HASH_RANGE)) / HASH_RANGE
    new = origins.join(others, "_other").select(
        id,
        label,
        *[
            (F.col(quoted(f)) + part * (F.col(f"_o{i}") - F.col(quoted(f)))).alias(f)
            for i, f in enumerate(features)
        ],
        "copy",
    )
    return rows.withColumn("copy", F.lit(1)).unionByName(new)
