"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from every node that has a link.

    ``links`` has the columns u and v, in either direction, repeated or not; links
    of a node to itself and links with a null end count for nothing. Returns node
    and component; no links give no rows. Each round is written to the shared
    folder, so that neither the plan nor the loss of an executor costs more than
    one round. Rounds end when the set of links no longer changes.
    """
    edges = durable(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    while True:
        state = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("a"),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("b"),
        ).first()
        if not state.n or state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        edges = durable(_small_star(durable(_large_star(edges))))
