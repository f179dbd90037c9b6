"""Line dedup with DataFrame functions only.

Hashes of long lines are range-partitioned and sorted by document and position inside each
range, so that one pass sees the first occurrence of a line before its later ones. What
comes out is a compressed bitmap per document of the lines to drop, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.llm.common import SharedTable, free_name

#: White space that a line's key loses at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash with more than one in HOT_SHARE of all long lines is hot; there are fewer than
#: HOT_SHARE such hashes at any size of the corpus, so their table may be broadcast.
HOT_SHARE = 2000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case."""
    cut = F.trim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(cut) == F.char_length(cut)
    return F.when(ascii_only, F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def long_lines(docs: DataFrame, min_chars: int, text: str, id_col: str) -> DataFrame:
    """(id, pos, h1, h2) of the lines whose keys have `min_chars` code points or more; h1
    and h2 are 128 bits of hash. Rows that share an id are one document's."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= min_chars).select("id", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, pos) of each long line that a document with a smaller id holds too.

    Hot lines are found by a count with map-side combine and resolved beside their rows by
    a broadcast of fewer than HOT_SHARE hashes; they never meet in one task. All others are
    range-partitioned by hash, sorted by document and position, and read once.
    """
    lines = SharedTable(long_lines(docs.where(F.col(id_col).isNotNull()), min_chars, text, id_col), "lines").df
    counted = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    held = SharedTable(counted.where("n > 1"), "repeated-lines").df
    total = held.agg(F.sum("n")).first()[0] or 0
    hot = held.where(F.col("n") * HOT_SHARE > total).select("h1", "h2", "first_id")
    cold = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    by_hash = Window.partitionBy("h1", "h2").orderBy("id", "pos")
    ordered = cold.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos")
    streamed = ordered.withColumn("first_id", F.first("id").over(by_hash)).where("id > first_id")
    beside = lines.join(F.broadcast(hot), ["h1", "h2"]).where("id > first_id")
    return streamed.select("id", "pos").unionByName(beside.select("id", "pos"))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(id, n_dropped, drop_runs): a run-length bitmap per document. drop_runs holds pairs
    (first line, number of lines) of neighbouring dropped lines, in order."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    runs = dropped.distinct().withColumn("run", F.col("pos") - place).groupBy("id", "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("lines"))
    pairs = F.sort_array(F.collect_list(F.struct("first", F.col("lines").cast("int").alias("lines"))))
    return runs.groupBy("id").agg(F.sum("lines").alias("n_dropped"), pairs.alias("drop_runs"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_dropped, drop_runs) of the documents that lose lines; the others keep all."""
    return drop_bitmaps(dropped_lines(docs, min_chars, text, id_col))


def kept_text(text: Column, drop_runs: Column) -> Column:
    """The text without the lines of its bitmap; a null bitmap keeps all, a null text is ''."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n", -1)
    after = F.concat(F.array(F.lit(0)), F.transform(drop_runs, lambda r: r["first"] + r["lines"]))
    until = F.concat(F.transform(drop_runs, lambda r: r["first"]), F.array(F.size(lines)))
    left = F.flatten(F.zip_with(after, until, lambda a, b: F.slice(lines, a + 1, b - a)))
    return F.when(drop_runs.isNull(), whole).otherwise(F.array_join(left, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with the columns n_lines, n_dropped, drop_runs and kept_text, which replace
    columns of those names.

    A null or empty text is one empty line. Rows that repeat an id count as one document and
    keep the lines that the document keeps; rows without an id keep all lines and take none
    from others. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "drop_runs", "kept_text")]
    # The document's columns stay in one struct, so that none of their names can clash.
    row = free_name(names, "row")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row))
    joined = own.join(keep_bitmaps(docs, min_chars, text, id_col), F.col(f"{row}.`{id_col}`") == F.col("id"), "left")
    whole = F.col(f"{row}.`{text}`")
    lines = F.size(F.split(F.coalesce(whole, F.lit("")), "\n", -1)).cast("long")
    return joined.select(
        *[F.col(f"{row}.`{c}`") for c in names],
        lines.alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "drop_runs",
        kept_text(whole, F.col("drop_runs")).alias("kept_text"),
    )
