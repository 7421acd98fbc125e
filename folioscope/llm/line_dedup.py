"""Removal of repeated passages: windows of three consecutive lines that occur earlier in the corpus.

DataFrame functions only. Lines are the parts of a text between newlines; lines without a word (blank ones) belong
to no window. Each window of three consecutive other lines, trimmed of blanks at both ends, is hashed to 128 bits. Occurrences are ordered by
(id, text hash, position); every occurrence but the first is marked, and a line goes if any marked window covers
it, so overlapping windows merge into one removed stretch. The text of a removed line stays at an earlier place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import scratch_table, text_key, unused_name

#: Lines in a window.
WINDOW = 3
#: The characters that part words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def _lines(df: DataFrame, text_col: str) -> Column:
    return F.split(df[text_col], "\n", -1)


def _worded(lines: Column) -> Column:
    """(position, trimmed line) of the lines with a word."""
    trimmed = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "").alias("line")))
    return F.filter(trimmed, lambda x: F.length(x["line"]) > 0)


def _windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row per window: (h1, h2, place struct(id, key, at of its first line), covered positions)."""
    hashed = docs.select(
        F.col(id_col).alias("id"),
        text_key(text_col).alias("key"),
        F.transform(_worded(_lines(docs, text_col)), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(11), x["line"]).alias("b"))).alias("w"),
    ).where(F.size("w") >= width)
    each = F.transform(F.sequence(F.lit(0), F.size("w") - width), lambda i: F.slice(F.col("w"), i + 1, F.lit(width)))
    out = hashed.select("id", "key", F.explode(each).alias("w"))
    return out.select(
        F.xxhash64("w.a").alias("h1"),
        F.xxhash64("w.b").alias("h2"),
        F.struct("id", "key", F.col("w")[0]["at"].alias("at")).alias("place"),
        F.col("w.at").alias("covered"),
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, key, gone): the positions of lines to remove from each document that has some."""
    windows = _windows(docs, id_col, text_col, width)
    firsts = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = scratch_table(firsts, "windows")  # so both sides of the join below are plain exchanges, whose hot keys can be split
    later = windows.join(firsts, ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first")))
    return later.select(F.col("place.id").alias("id"), F.col("place.key").alias("key"), F.explode("covered").alias("at")).groupBy("id", "key").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """An array without the positions in gone (ascending): what lies between each two neighbours of them, end to end."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    n = F.size(gone) + 1
    return F.flatten(F.zip_with(F.slice(ends, F.lit(1), n), F.slice(ends, F.lit(2), n), lambda p, q: F.slice(lines, p + 2, q - p - 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with the repeated lines taken out of text_col, plus n_lines and n_removed (long).

    Every row stays, with all its columns; a text that loses all lines becomes empty. A null text stays null (0
    lines), an empty one has one line. Rows with null ids come first in the order of occurrences. Repeated rows
    (same id and text) count as one document for the order, so they are cleaned alike. Columns of docs named
    n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    key = unused_name(docs, "text_hash")
    gone = repeated_lines(docs, id_col, text_col, width)
    keyed = docs.withColumn(key, text_key(text_col))
    joined = keyed.join(gone, keyed[id_col].eqNullSafe(gone["id"]) & (keyed[key] == gone["key"]), "left")
    kept = F.array_join(_without(_lines(keyed, text_col), gone["gone"]), "\n")
    columns = [F.when(gone["gone"].isNull(), keyed[c]).otherwise(kept).alias(c) if c == text_col else keyed[c] for c in docs.columns]
    return joined.select(
        *columns,
        F.when(keyed[text_col].isNull(), 0).otherwise(F.size(_lines(keyed, text_col))).cast("long").alias("n_lines"),
        F.when(gone["gone"].isNull(), 0).otherwise(F.size(gone["gone"])).cast("long").alias("n_removed"),
    )
