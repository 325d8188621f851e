"""Benchmark decontamination by winnowing.

Both sides are cut to words (``wordbytes.ALNUM``).  Of every ``SPAN`` - ``GRAM`` + 1
consecutive ``GRAM``-gram hashes the smallest is kept (the right-most of equals),
so two texts that share ``SPAN`` words in a row keep at least one fingerprint of
that stretch in common, whatever surrounds it.  Kept fingerprints of both sides
are joined and every hit is extended word by word in both directions, comparing
the words themselves.

The document side first passes a Bloom filter of the benchmark's fingerprints
(fixed size, at most 8 MB), so only likely hits are shuffled; the join that
follows is exact.

Edge cases: a null or empty text has no words; a benchmark item of fewer than
``SPAN`` words (but at least one) is one window of all its words, found through
the hashes of all document grams of its length; repeated rows are kept and each
gets the same result; null ids are carried; an empty benchmark leaves every
document clean; columns beyond the ones named here are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import bloom, bloom_size, in_bloom, map_arrow, settle

SPAN, GRAM = 10, 6

_FOUND = "id string, row long, n_words long, key long, pos long, before int, around array<string>, short int"


def _lowered(data: np.ndarray) -> bytes:
    return wb.LOWER[data].tobytes()


def _winnowed(hashes: np.ndarray, first: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of kept grams for rows that own words first[r]:first[r + 1]."""
    g = wb.grams(hashes, gram)
    windows = len(hashes) - span + 1
    if windows <= 0:
        return np.zeros(0, np.int64), g[:0]
    least, place = g[:windows].copy(), np.arange(windows)
    for i in range(1, span - gram + 1):
        later = g[i : i + windows]
        less = later <= least
        least[less] = later[less]
        place[less] = np.flatnonzero(less) + i
    starts = np.arange(windows)
    row = np.searchsorted(first, starts, side="right") - 1
    place = np.unique(place[starts + span <= first[row + 1]])
    return place, g[place]


def _salted(g: np.ndarray, length: int) -> np.ndarray:
    return wb.mix(g + np.uint64(length))


def _fingerprints(ids: pa.Array, texts: pa.Array, span: int, gram: int, lengths: tuple, passes, summary: bool):
    """Batches of ``_FOUND``: kept fingerprints that ``passes`` with the words around
    them and, for ``summary``, a row for each text with the text's own key."""
    names = ids.cast(pa.string()).to_pylist()
    for at, offsets, data in wb.runs(texts):
        hashes, starts, ends, first = wb.words(data, offsets, wb.ALNUM)
        raw = _lowered(data)
        count = np.diff(first)
        row_key = np.zeros(len(count), np.uint64)
        salt = wb.mix(np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], count).astype(np.uint64))
        np.add.at(row_key, np.repeat(np.arange(len(count)), count), wb.mix(hashes ^ salt))
        row_key = wb.mix(row_key + count.astype(np.uint64))
        found = []
        if summary:
            found += [(names[at + r], int(row_key[r].astype(np.int64)), int(count[r]), int(row_key[r].astype(np.int64)), None, None, None, None) for r in range(len(count))]
        tries = [(0, *_winnowed(hashes, first, span, gram))]
        for length in lengths:
            g = wb.grams(hashes, length)
            place = np.arange(len(g))
            row = np.searchsorted(first, place, side="right") - 1
            whole = place + length <= first[row + 1]
            if not summary:  # an item shorter than a window is one window of all its words
                whole &= (place == first[row]) & (count[row] == length)
            tries.append((length, place[whole], g[whole]))
        for length, place, g in tries:
            keys = _salted(g, length)
            if passes is not None:
                hit = in_bloom(passes, keys)
                place, keys = place[hit], keys[hit]
            row = np.searchsorted(first, place, side="right") - 1
            for p, k, r in zip(place.tolist(), keys.astype(np.int64).tolist(), row.tolist()):
                low = p if length else max(int(first[r]), p - (span - gram))
                high = p + length if length else min(int(first[r + 1]), p + span)
                around = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in range(low, high)]
                found.append((names[at + r], int(row_key[r].astype(np.int64)), int(count[r]), k, p - int(first[r]), p - low, around, length))
        if found:
            columns = list(zip(*found))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in _FOUND.split(", ")])


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays of words."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1)


def decontaminate(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM,
                  id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document row: ``id``, ``row`` (its words' hash), ``n_words``, ``hits``
    (array of distinct ``[start, stop)`` word ranges) and ``items`` (item ids)."""
    spark = documents.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    n_words = map_arrow(items, _lengths, "n int")
    lengths = tuple(sorted(r[0] for r in n_words.where(F.col("n").between(1, span - 1)).distinct().collect()))  # at most span - 1 values

    prints = settle(map_arrow(items, lambda b: _fingerprints(b.column(0), b.column(1), span, gram, lengths, None, False), _FOUND)
                    .select("key", F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("before").alias("item_before"), F.col("around").alias("item_around"))
                    .dropDuplicates(["key", "item", "item_before", "item_around"]))
    size = bloom_size(prints.count())
    filled = spark.sparkContext.broadcast(bloom(prints.select("key"), size))

    source = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = map_arrow(source, lambda b: _fingerprints(b.column(0), b.column(1), span, gram, lengths, filled.value, True), _FOUND)
    pairs = found.join(prints, "key", "left")
    left = _common(F.reverse(F.slice("around", F.lit(1), F.col("before"))), F.reverse(F.slice("item_around", F.lit(1), F.col("item_before"))))
    right = _common(F.slice("around", F.col("before") + 1, F.size("around")), F.slice("item_around", F.col("item_before") + 1, F.size("item_around")))
    pairs = pairs.withColumn("l", F.when(F.col("pos").isNotNull() & F.col("item").isNotNull(), left)).withColumn("r", F.when(F.col("l").isNotNull(), right))
    true = F.col("r").isNotNull() & F.when(F.col("short") > 0, F.col("r") >= F.col("short")).otherwise(F.col("l") + F.col("r") >= span)
    return (pairs.groupBy("id", "row")
            .agg(F.max("n_words").alias("n_words"),
                 F.collect_set(F.when(true, F.struct((F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop")))).alias("hits"),
                 F.collect_set(F.when(true, F.col("item"))).alias("items"),
                 F.count_if(F.col("pos").isNull()).alias("copies"))
            .withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .drop("copies"))


def _lengths(batch: pa.RecordBatch):
    for _, offsets, data in wb.runs(batch.column(1)):
        first = wb.words(data, offsets, wb.ALNUM)[3]
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(first).astype(np.int32))], ["n"])


def covered(hits: Column) -> Column:
    """Words in the union of ``[start, stop)`` ranges."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    fold = F.aggregate(F.array_sort(hits), start, lambda a, h: F.struct(
        (a["n"] + F.greatest(F.lit(0), h["stop"] - F.greatest(h["start"], a["to"]))).alias("n"),
        F.greatest(a["to"], h["stop"]).alias("to")))
    return fold["n"]


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest columns, a row for each row of ``documents``."""
    return decontaminate(documents, benchmark).select(
        F.col("id").cast("long").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("hits")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"))
