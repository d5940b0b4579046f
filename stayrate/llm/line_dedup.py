"""Line dedup by a deletion-neighbourhood join: lines that are equal but for one word.

The edit bound is one word (put in, left out or replaced) between lines of at least
``SHORT`` words; shorter lines must be equal. White space within a line does not
count. Two lines are within the bound exactly if they share a key: a line, or a line
without one of its words, hashed. First, hashes of line halves tell which lines can
have a partner at all, as an edit leaves one half as it is; only these emit keys. A
group of equal keys names its earliest line, so no pairs are made. Links are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayrate.llm.tables import SPACES, known, numbered
from stayrate.session import durable

SHORT = 8
_BITS = (1 << 62) - 1


def _hash(*columns: Column) -> Column:
    """A number from 0 to 2 ** 62 - 1, so that two of them can be added."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(_BITS))


def _add(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(F.lit(_BITS))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, at (line number from 0) and the line, its words joined by single spaces, of every line that has a word."""
    bare = F.transform(F.split(known(text_col), "\n"), _bare)
    return docs.select(F.col(id_col).alias("id"), F.posexplode_outer(bare).alias("at", "line")).where("line <> ''")


def _bare(line: Column) -> Column:
    """The line with its words joined by single spaces; most lines are so already, which a search for bytes tells."""
    odd = line.startswith(" ") | line.endswith(" ")
    for space in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(space)
    return F.when(odd, F.regexp_replace(F.regexp_replace(line, SPACES, " "), "^ | $", "")).otherwise(line)


def _halves(words: Column) -> Column:
    """Hashes that two lines within the bound share: of the first half, or of the rest.

    For either length that the shorter of the two may have: first the line's own, then one less.
    """
    n, found = F.size(words), []
    for k in (0, 1):
        half = F.floor((n - k) / 2).cast("int")
        rest = n - k - half
        found.append(F.xxhash64(n - k, F.lit(0), F.slice(words, F.lit(1), half)))
        found.append(F.xxhash64(n - k, F.lit(1), F.slice(words, n - rest + 1, rest)))
    none = F.array().cast("array<bigint>")
    return F.when(n > SHORT, F.array(*found)).when(n == SHORT, F.array(*found[:2])).otherwise(none)


def _running(values: Column, n: Column) -> Column:
    """Sums of the n values up to each place, by doubling steps: no quadratic work on long lines."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))

    def double(sums: Column, step: Column) -> Column:
        shift = F.least(F.pow(F.lit(2.0), step).cast("int"), n)
        moved = F.concat(F.array_repeat(F.lit(0).cast("long"), shift), F.slice(sums, F.lit(1), n - shift))
        return F.zip_with(sums, moved, _add)

    return F.aggregate(steps, values, double)


def neighbourhood(candidates: DataFrame) -> DataFrame:
    """Keys of each line (columns id, at, words, shared): itself, and itself without each word.

    ``shared`` says which of its four halves the line shares; the edit is in the other half.

    role 0: lines of one length that lack the same place; 1: the line itself; 2: a line
    without one word, to meet lines that are that. A word's hash depends on its place,
    and a line's is the sum; without word j, the words behind move up one place.
    """
    n = F.size("words")
    here = F.transform("words", lambda w, i: _hash(w, i))
    moved = F.transform("words", lambda w, i: _hash(w, i - 1))
    base = candidates.select("id", "at", "shared", n.alias("n"), here.alias("here"), moved.alias("moved"))
    gap = F.zip_with("here", "moved", lambda a, b: _add(a, F.lit(_BITS + 1) - b))
    n = F.col("n")
    summed = base.select(
        "id", "at", "shared", "n", "here",
        F.aggregate("moved", F.lit(0).cast("long"), _add).alias("all_moved"),
        F.aggregate("here", F.lit(0).cast("long"), _add).alias("whole"), _running(gap, n).alias("gaps"),
    )
    # The words before j in their place, those behind it moved: all moved + gaps up to j - here[j].
    without = F.zip_with("gaps", "here", lambda g, h: _add(_add(F.col("all_moved"), g), F.lit(_BITS + 1) - h))
    left = summed.select("id", "at", "shared", "n", F.posexplode(without).alias("j", "rest"))

    def other_half(k: int) -> Column:
        half = F.floor((F.col("n") - k) / 2)
        return (F.col("shared")[2 * k] & (F.col("j") >= half)) | (F.col("shared")[2 * k + 1] & (F.col("j") < half + k))

    replaced = left.where(other_half(0)).select("id", "at", F.lit(0).alias("role"), F.xxhash64(F.lit(0), "n", "j", "rest").alias("key"))
    longer = left.where(other_half(1)).select("id", "at", F.lit(2).alias("role"), F.xxhash64(F.lit(1), F.col("n") - 1, "rest").alias("key"))
    itself = summed.where(F.col("shared")[0] | F.col("shared")[1]).select("id", "at", F.lit(1).alias("role"), F.xxhash64(F.lit(1), "n", "whole").alias("key"))
    return replaced.union(longer).union(itself)


def _first(*more: Column) -> Column:
    return F.min(F.struct("id", "at", *more))


def near(distinct: DataFrame, every: DataFrame) -> DataFrame:
    """Lines (id, at) that have an earlier line (to_id, to_at) within the bound, the earliest of these.

    ``distinct`` has the first place of each distinct line (id, at) and its halves,
    ``every`` all lines.
    """
    halves = distinct.select("id", "at", F.posexplode_outer("halves").alias("which", "half")).where("half is not null")
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    able = halves.join(shared, "half").groupBy("id", "at").agg(F.array(*(F.max(F.col("which") == k) for k in range(4))).alias("shared"))
    candidates = durable(every.join(able, ["id", "at"]).select("id", "at", F.split("line", " ").alias("words"), "shared"))
    keys = durable(neighbourhood(candidates))
    # Role 0 looks among its own; lines themselves among those that lack a word, and the other way round.
    met = keys.withColumn("side", F.when(F.col("role") == 1, 2).when(F.col("role") == 2, 1).otherwise(0))
    firsts = durable(keys.groupBy("key", "role").agg(_first().alias("first"), F.count("*").alias("n")).where("role > 0 or n > 1").select("key", F.col("role").alias("side"), "first"))
    found = met.join(firsts, ["key", "side"]).where("struct(id, at) > first").groupBy("id", "at").agg(F.min("first").alias("first"))
    links = found.select("id", "at", F.col("first.id").alias("to_id"), F.col("first.at").alias("to_at"))
    other = candidates.select(F.col("id").alias("to_id"), F.col("at").alias("to_at"), F.col("words").alias("to_words"))
    both = links.join(candidates.select("id", "at", "words"), ["id", "at"]).join(other, ["to_id", "to_at"])
    return both.where(within("words", "to_words")).select("id", "at", "to_id", "to_at")


def within(a: str, b: str) -> Column:
    """Whether two word lists are at most one word apart."""
    a, b = F.col(a), F.col(b)
    n, m = F.size(a), F.size(b)
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), F.least(n, m)), F.slice(b, F.lit(1), F.least(n, m)), lambda x, y: x != y), True).cast("int")
    at = F.when(differ == 0, F.least(n, m) + 1).otherwise(differ)
    rest = lambda x, size, start: F.slice(x, start, F.greatest(size - start + 1, F.lit(0)))
    return (
        F.when(n == m, rest(a, n, at + 1) == rest(b, m, at + 1))
        .when(n == m + 1, rest(a, n, at + 1) == rest(b, m, at))
        .when(m == n + 1, rest(a, n, at) == rest(b, m, at + 1))
        .otherwise(False)
    )


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines (id, at) that are not kept, and ``near``: whether an earlier line is equal (false) or within the bound.

    ``id_col`` must tell rows apart (see ``_told_apart``). Earlier is by id, then line number. A line goes if any earlier line is equal or
    within the bound, whether that one stays or not. Lines without words never go.
    """
    every = lines(docs, id_col, text_col)
    # 128 bits tell lines apart; the lines themselves stay where they are.
    placed = every.select("id", "at", F.unhex(F.md5("line")).alias("line"), F.split("line", " ").alias("words"))
    placed = durable(placed.select("id", "at", "line", _halves(F.col("words")).alias("halves")))
    distinct = durable(
        placed.groupBy("line").agg(F.min(F.struct("id", "at", "halves")).alias("first"), F.count("*").alias("n"))
        .select("line", "first.id", "first.at", "first.halves", (F.col("n") > 1).alias("again"))
    )
    near_firsts = near(distinct, every).select("id", "at")
    marked = distinct.select("line", "id", "at", "again").join(near_firsts.withColumn("near", F.lit(True)), ["id", "at"], "left")
    gone = durable(marked.where("again or near").select("line", F.struct("id", "at").alias("first"), F.coalesce("near", F.lit(False)).alias("near")))
    return (
        placed.select("id", "at", "line").join(gone, "line")
        .where("near or struct(id, at) <> first")
        .select("id", "at", (F.struct("id", "at") == F.col("first")).alias("near"))
    )


def _told_apart(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, Column]:
    """``docs`` with a column that tells rows apart and sorts by id, its name, and the id in a column ``id`` of such values.

    Where ids do so, it is the id itself; else a struct of the id and the place of the row.
    """
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or id is null").isEmpty():
        return docs, id_col, F.col("id")
    stored, row, key = numbered(docs)
    kind = stored.schema[row].dataType
    parts = [F.col(f"{row}.{f}").alias(f) for f in kind.names] if isinstance(kind, StructType) else [F.col(row).alias("row")]
    return stored.withColumn(key, F.struct(F.col(id_col).alias("id"), *parts)).drop(row), key, F.col("id.id")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_lines (with words), n_equal and n_near (lines that go), dropped (their numbers from 0).

    Null and empty texts have no lines. Rows count one by one: those that repeat an id
    are in the order in which they are stored, and a null id comes before all others.
    An empty table gives no rows; other columns of ``docs`` play no part.
    """
    stored, key, own = _told_apart(docs, id_col)
    n_lines = F.size(F.filter(F.split(known(text_col), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    rows = stored.select(F.col(key).alias("id"), n_lines.alias("n_lines"))
    per = repeats(stored, key, text_col).groupBy("id").agg(
        F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_list("at")).alias("dropped")
    )
    return rows.join(per, "id", "left").select(
        own.alias(id_col), "n_lines", F.coalesce("n_equal", F.lit(0)).alias("n_equal"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts of the lines that stay; other columns are kept as they are, null texts stay null.

    Rows count one by one, as in ``counted``: of a repeated row the lines of the first stay.
    """
    stored, key, _ = _told_apart(docs, id_col)
    gone = repeats(stored, key, text_col).groupBy(F.col("id").alias("_line_id")).agg(F.collect_set("at").alias("_line_gone"))
    joined = stored.join(gone, stored[key] == gone["_line_id"], "left")
    stay = F.filter(F.split(stored[text_col], "\n"), lambda x, i: ~F.array_contains(gone["_line_gone"], i))
    text = F.when(gone["_line_gone"].isNull(), stored[text_col]).otherwise(F.array_join(stay, "\n"))
    return joined.select(*(text.alias(c) if c == text_col else stored[c] for c in docs.columns))
