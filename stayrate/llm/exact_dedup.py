"""Exact dedup by recipes of content-defined chunks.

The normalised text is cut into chunks whose ends depend on the characters around
them alone, so an edit moves only the cuts next to it. Each distinct chunk gets an
identifier; a text becomes the ordered list of its chunks' identifiers, and two
texts are equal exactly if their lists are. Chunks move once, to verify that no
two different chunks share an identifier; documents never move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.tables import SPACES, known, numbered
from stayrate.session import durable

LEAST, MOST = 256, 4096
#: A chunk ends after four characters whose code points leave these remainders.
ANCHOR = (1, 2, 3, 0)
ANCHOR_RANGE = (0x21, 0x100)


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """A pattern whose successive matches are the chunks.

    A chunk runs from ``least`` characters to the first anchor, or has ``most``
    characters where no anchor comes, so texts without anchors are cut as well.
    """
    ends = "".join(
        "[" + "".join(f"\\x{{{c:x}}}" for c in range(*ANCHOR_RANGE) if c % len(ANCHOR) == r) + "]" for r in ANCHOR
    )
    return f"(?s).{{{least - len(ANCHOR)},{most - len(ANCHOR)}}}?{ends}|(?s).{{1,{most}}}"


def digest(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    identify: Callable[[Column], Column] = digest,
) -> DataFrame:
    """One row per document with the row that stays of its group of equal texts.

    Texts are equal when identical without white space (\\x20, \\x09-\\x0D); null
    and empty texts, and texts of white space alone, are equal. The text with the
    most code points before that stays, of these the smallest id. Returns id_col,
    keep_id, group_size, kept, text_sha256; other columns of ``docs`` play no part.
    Rows that repeat an id count in group_size, and share their fate: a repeated
    row that stays, stays as often as it is there. A null id sorts first. An empty
    table gives no rows. ``identify`` may be any function of a chunk: where two
    different chunks get one identifier, they are told apart by their content.
    """
    pattern = F.lit(chunk_pattern())
    plain = docs.select(
        F.col(id_col).alias("id"), F.length(known(text_col)).alias("points"),
        F.regexp_replace(known(text_col), SPACES, "").alias("norm"),
    )
    cut = plain.select("id", "points", "norm", F.regexp_extract_all("norm", pattern, F.lit(0)).alias("chunks"))
    clashing, content = _verify(cut, identify)
    if clashing is None:
        listed = cut.select(
            "id", "points", F.sha2("norm", 256).alias("text_sha256"), F.transform("chunks", identify).alias("recipe"),
            F.array().cast("array<int>").alias("ranks"),
        )
    else:
        listed = _ranked(cut, content, clashing, identify)
    listed = durable(listed)
    # Stored, so that both sides of the join are dealt out for it: Spark can then split a hot group.
    best = durable(
        listed.groupBy("recipe", "ranks").agg(
            F.count("*").alias("group_size"), F.min(F.struct((-F.col("points")).alias("p"), F.col("id").alias("keep_id"))).alias("best")
        )
    )
    return listed.join(best, ["recipe", "ranks"]).select(
        F.col("id").alias(id_col), F.col("best.keep_id").alias("keep_id"), "group_size",
        F.col("id").eqNullSafe(F.col("best.keep_id")).alias("kept"), "text_sha256",
    )


def _verify(cut: DataFrame, identify: Callable[[Column], Column]) -> tuple[DataFrame | None, DataFrame]:
    """Identifiers that several different chunks share (None without any), and the distinct chunks."""
    # explode() would have Spark add a filter on the array, which cuts every text once more.
    chunk = cut.select(F.explode_outer("chunks").alias("chunk")).where("chunk is not null")
    content = chunk.select(identify(F.col("chunk")).alias("h"), "chunk").distinct()
    clashing = durable(content.groupBy("h").count().where("count > 1").select("h"))
    return (None if clashing.isEmpty() else clashing), content


def _ranked(cut: DataFrame, content: DataFrame, clashing: DataFrame, identify: Callable[[Column], Column]) -> DataFrame:
    """Recipes in which chunks that share an identifier are also told apart by their rank."""
    order = Window.partitionBy("h").orderBy("chunk")
    ranks = content.join(clashing, "h").select("h", "chunk", F.row_number().over(order).alias("rank"))
    marked = durable(cut.select(F.monotonically_increasing_id().alias("row"), "id", "points", "norm", "chunks"))
    found = (
        marked.select("row", F.posexplode("chunks").alias("pos", "chunk"))
        .select("row", "pos", "chunk", identify(F.col("chunk")).alias("h"))
        .join(ranks, ["h", "chunk"], "left")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("placed"))
        .select("row", F.col("placed.rank").alias("ranks"))
    )
    return marked.join(found, "row", "left").select(
        "id", "points", F.sha2("norm", 256).alias("text_sha256"), F.transform("chunks", identify).alias("recipe"),
        F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of which an equal text stays; all columns are kept as they are.

    One row of each group stays: of those with the longest text, that with the smallest
    id (a null id sorts first), and of rows that repeat an id the first of the stored rows.
    """
    stored, row, key = numbered(docs, F.col(id_col))
    gone = groups(stored, key, text_col).where("not kept").select(F.col(f"{key}.row").alias(row))
    return stored.join(gone, row, "left_anti").drop(row, key)
