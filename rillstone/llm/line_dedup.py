"""Line dedup over windows of two neighbouring lines, in DataFrame functions only.

Boundaries that a rolling hash chooses miss most short repeats (README, with figures), so
none are chosen: each pair of neighbouring lines is a window, whatever stands around it, and a
repeated passage of two lines or more consists of windows that repeat.  A line of ``PASSAGE`` words or
more is a whole paragraph written without breaks and a window of its own, too.
Windows that occur more than once anywhere are told apart by the SHA-256 of their
bytes; the lines of every occurrence but the first (smallest id, then place) are
removed.  The first place of any line is in no later occurrence, so one copy of each
line always stays.

Empty lines make no window: they belong to the window around them, with which they go.
A part of a line is never removed: a passage inside a longer line stays.

Both joins are sort-merge joins at every size, so small and large tables run one plan.

Edge cases: a null text stays null; an empty one stays empty; a text without line
breaks is one line, touched only if it has ``PASSAGE`` words; rows that repeat both id and text are one
document and all stay; rows without an id come first; an empty table gives an empty
result; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled


PASSAGE = 40  # words (runs between spaces) that make a line a paragraph of its own


def _wide(line: Column) -> Column:
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return (F.octet_length(line) >= 2 * PASSAGE - 1) & (spaces >= PASSAGE - 1)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def line_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with repeated lines removed from the text, and the columns
    ``n_removed`` (runs of lines), ``n_removed_lines`` and
    ``n_removed_chars`` added."""
    order, text = F.col(id_col), F.col(text_col)
    keys = [F.xxhash64(order, text).alias("key_a"), F.xxhash64(text, order, F.lit(1)).alias("key_b")]
    filled = F.filter(F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("at"))), lambda x: x["line"] != "")
    texts = documents.where(text.contains("\n") | _wide(text)).select(order.alias("id"), *keys, filled.alias("lines"))
    lines, most = F.col("lines"), F.greatest(F.size("lines") - 1, F.lit(0))
    window = lambda a, b, x: F.struct(a["at"].alias("at"), b["at"].alias("to"), _digest(x).alias("bytes"))
    pairs = F.zip_with(F.slice(lines, F.lit(1), most), F.slice(lines, F.lit(2), most), lambda a, b: window(a, b, F.concat(a["line"], F.repeat(F.lit("\n"), b["at"] - a["at"]), b["line"])))
    alone = F.transform(F.filter(lines, lambda a: _wide(a["line"])), lambda a: window(a, a, a["line"]))
    # Texts are cut once; the written windows serve both the grouping and the places.
    cut_once = Settled(texts.select("id", "key_a", "key_b", F.inline(F.concat(pairs, alone))), 8 << 20)
    pieces = cut_once.df
    where = F.struct("id", "key_a", "key_b", "at", "to")
    repeated = Settled(pieces.groupBy("bytes").agg(F.count("*").alias("n"), F.min(where).alias("first")).where("n > 1").select("bytes", "first"))
    spots = pieces.select(where.alias("spot"), "bytes")
    drop = spots.join(repeated.df.hint("merge"), "bytes").where("spot <> first").select("spot.key_a", "spot.key_b", F.explode(F.sequence("spot.at", "spot.to")).alias("line"))
    drop = Settled(drop.groupBy("key_a", "key_b").agg(F.collect_set("line").alias("gone"))).df
    cut_once.free()
    repeated.free()
    every = [F.col(c) for c in documents.columns]
    own = documents.select(F.struct(*every).alias("row"), *keys).join(drop.hint("merge"), ["key_a", "key_b"], "left")
    # Only texts that lose something are cut again.
    own = own.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(F.col("row")[text_col], "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    own = own.withColumn("new", F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(left))
    runs = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    return own.select(*[(F.col("new") if c == text_col else F.col("row")[c]).alias(c) for c in documents.columns],
                      F.coalesce(F.when(F.col("gone").isNotNull(), runs), F.lit(0)).alias("n_removed"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).alias("n_removed_lines"),
                      F.coalesce(F.length(F.col("row")[text_col]) - F.length("new"), F.lit(0)).alias("n_removed_chars"))


def report(documents: DataFrame) -> DataFrame:
    """A row for each document: what is left of its text and what went."""
    out = line_dedup(documents.select("doc_id", "text"))
    return out.select("doc_id", "text", "n_removed", "n_removed_lines", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
