"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stayrate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps.

    Partition counts and sizes are left to the cluster's own settings; pass
    overrides as keyword arguments with ``__`` for each dot.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Do not record a Python call site for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session, where driver and executors are one process, may
    fall back to a temporary folder.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="stayrate-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


_MADE: list[str] = []


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``durable`` stores inside, when the block ends well or ill.

    Results that outlive the block must have been written elsewhere, and nothing else
    may store tables in this process meanwhile. A job that was killed leaves its tables;
    they are in ``shared_folder``, named table-*.
    """
    before = len(_MADE)
    try:
        yield
    finally:
        made, _MADE[before:] = _MADE[before:], []
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from there.

    Used where a result is read several times (category list, curves), so that
    the upstream scans and shuffles run once, a lost executor costs a re-read
    and not a recomputation, and each reader scans only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    _MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``, keeping its partitions and the row order in them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
