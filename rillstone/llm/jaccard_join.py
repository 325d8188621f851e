"""Exact n-gram Jaccard join by filtering under several global token orders.

A text's set holds the hashes of its distinct ``n``-word shingles (words by
``wordbytes.SPACED``; fewer words than ``n`` make one shingle).  For a similarity
of ``num``/``den`` two linked texts must share a token among the first
``|x| - ceil(|x| num / den) + 1`` of each *under every total order*.  Three are
used: rarest first (frequencies of all shingles of all texts, in a count table of
fixed size; ties by hash) and two by independent hashes.  The first one, with the set's
size class (a doubling of sizes; sets near the upper border are in the next class, too),
is the join key.  A 512-bit parity sketch (its Hamming distance never exceeds the sets'
symmetric difference) is compared inside the join; candidates are intersected with the
other orders' prefixes and compared by a parity sketch of two bits a token or more, and
what passes all filters is verified on the full sets.

No pairs are expanded within a group.  Equal sets become one class; in every
bucket of a prefix token all members are first compared with one leader (the
member whose shingles are the most frequent, i.e. the likeliest original of a
family), components are formed, and then only pairs of *different* components are
compared.  Links between members of one component are implied, so components are
exact.

Edge cases: null, empty or blank texts have an empty set and are linked with
nothing; repeated rows and equal texts share a class; null ids are carried and
never chosen as a component's id unless there is no other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordbytes as wb
from .common import Settled, bloom, bloom_size, components, in_bloom, map_arrow

CELL_BITS = 23
CELLS = 1 << CELL_BITS  # counters of the frequency table, at most 16 MB a task; 8 MB broadcast
SKETCH = 512  # bits of the parity sketch

SLICES = 64  # parts of the frequency table, each counted by a task of its own
FEW = 500_000  # nodes (8 bytes each) that are broadcast; more are joined by a shuffle

_PROFILE = ("id long, n long, node long, typical double, sketch array<long>, "
            "first array<long>, second array<int>, third array<int>, wide array<long>")


def _shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows (with repeats) and where each row's begin."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(begin[-1], np.uint64)
    g = wb.grams(hashes, n)
    if len(g):
        place = np.arange(len(g))
        row = np.searchsorted(first, place, side="right") - 1
        whole = place + n <= first[row + 1]
        out[np.repeat(begin[:-1], np.where(count >= n, made, 0)) + (place - first[row])[whole]] = g[whole]
    for r in np.flatnonzero((count > 0) & (count < n)):
        out[begin[r]] = wb.grams(hashes[first[r] : first[r + 1]], int(count[r]))[0]
    return out, begin


def _sets(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row and where each row's begin."""
    out, begin = _shingles(hashes, first, n)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        out[a:b].sort()
    if not len(out):
        return out, begin
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[begin[:-1][np.diff(begin) > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def _frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """log2 of shingle counts by cell, as one byte each; over all texts.

    Every task counts on its own and hands on the ``SLICES`` parts of its table; a part is
    added up by one task, so no task reads more than a slice of all tables."""
    width = CELLS // SLICES

    def local(batches):
        own = np.zeros(CELLS, np.uint16)
        for batch in batches:
            for _, offsets, data in wb.runs(batch.column(0)):
                hashes, _, _, first = wb.words(data, offsets, wb.SPACED)
                cells, counts = np.unique(_shingles(hashes, first, n)[0] >> np.uint64(64 - CELL_BITS), return_counts=True)
                own[cells] = np.minimum(own[cells] + counts, 65_535)
        parts = [zlib.compress(own[i * width : (i + 1) * width].tobytes(), 1) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "cells"])

    def added(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own[at] = own.get(at, 0) + np.frombuffer(zlib.decompress(value.as_buffer()), np.uint16).astype(np.uint32)
        for at, total in own.items():
            logs = (8 * np.log2(np.minimum(total, 65_535).astype(np.float32) + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(logs.tobytes(), 1)], pa.binary())], ["slice", "cells"])

    schema = "slice int, cells binary"
    out = np.zeros(CELLS, np.uint8)
    for row in texts.mapInArrow(local, schema).repartition(SLICES, "slice").mapInArrow(added, schema).toLocalIterator():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["cells"]), np.uint8)
    return out


def _lists(values: list[np.ndarray], dtype) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(dtype)))


def _parity(places: np.ndarray, size: int) -> np.ndarray:
    """Parity sketch of ``size`` bits, as longs; bit p of half the size is that of p and p + size / 2."""
    return np.packbits((np.bincount(places & (size - 1), minlength=size) & 1).astype(bool)).view(np.int64)


def _profiles(ids: pa.Array, texts: pa.Array, n: int, num: int, den: int, common: np.ndarray):
    for at, offsets, data in wb.runs(texts):
        hashes, _, _, first = wb.words(data, offsets, wb.SPACED)
        flat, begin = _sets(hashes, first, n)
        size = np.diff(begin)
        row = np.repeat(np.arange(len(size)), size)
        rank = common[(flat >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        typical = np.bincount(row, rank, len(size)) / np.maximum(size, 1)
        node = np.zeros(len(size), np.uint64)
        np.add.at(node, row, wb.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        node = wb.mix(node + size.astype(np.uint64))
        orders = [(rank.astype(np.uint64) << np.uint64(56)) | (wb.mix(flat) >> np.uint64(8)), wb.mix(flat + np.uint64(1)) >> np.uint64(32), wb.mix(flat + np.uint64(2)) >> np.uint64(32)]
        length = np.where(size > 0, size - -(-size * num // den) + 1, 0)
        prefixes: list[list] = [[], [], []]
        sketches, wide = [], []
        bits = (flat >> np.uint64(34)).astype(np.int64) & (SKETCH - 1)
        for a, b, p in zip(begin[:-1].tolist(), begin[1:].tolist(), length.tolist()):
            for order, out in zip(orders, prefixes):
                out.append(np.sort(np.partition(order[a:b], p - 1)[:p]) if p else order[:0])
            sketches.append(_parity(bits[a:b], SKETCH))
            wide.append(_parity((flat[a:b] >> np.uint64(17)).astype(np.int64), 64 << max(0, int(2 * (b - a) - 1).bit_length() - 6)))
        yield pa.RecordBatch.from_arrays([
            ids.slice(at, len(size)).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(node.view(np.int64)), pa.array(typical),
            _lists(sketches, np.int64), _lists([p.view(np.int64) for p in prefixes[0]], np.int64),
            _lists([p.astype(np.uint32).view(np.int32) for p in prefixes[1]], np.int32), _lists([p.astype(np.uint32).view(np.int32) for p in prefixes[2]], np.int32),
            _lists(wide, np.int64),
        ], [x.split()[0] for x in _PROFILE.split(", ")])


def _wanted(ids: pa.Array, texts: pa.Array, n: int, filled: np.ndarray):
    """``(node, tokens)`` of texts whose id may be in the filter."""
    keep = in_bloom(filled, ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
    keep |= np.asarray(ids.is_null())
    for _, offsets, data in wb.runs(texts.filter(pa.array(keep))):
        hashes, _, _, first = wb.words(data, offsets, wb.SPACED)
        flat, begin = _sets(hashes, first, n)
        size = np.diff(begin)
        row = np.repeat(np.arange(len(size)), size)
        node = np.zeros(len(size), np.uint64)
        np.add.at(node, row, wb.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        node = wb.mix(node + size.astype(np.uint64))
        tokens = [flat[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(tokens, pa.binary())], ["node", "tokens"])


def _shared(batch: pa.RecordBatch):
    """Adds the size of the intersection of columns 2 and 3 (sorted tokens)."""
    out = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(2), batch.column(3))]
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64()), pa.array([len(x.as_buffer()) // 8 for x in batch.column(2)], pa.int64()), pa.array([len(x.as_buffer()) // 8 for x in batch.column(3)], pa.int64())], ["a", "b", "both", "na", "nb"])


def _apart(x: Column, y: Column) -> Column:
    """Differing bits of two sketches of equal length."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)


def _near(x: str, y: str, num: int, den: int) -> Column:
    """Size and parity-sketch filters on the structs x and y."""
    a, b = F.col(x), F.col(y)
    sizes = (a["n"] * den >= b["n"] * num) & (b["n"] * den >= a["n"] * num)
    return sizes & (_apart(a["sketch"], b["sketch"]) * (den + num) <= (a["n"] + b["n"]) * (den - num))


def _folded(x: Column, to: Column) -> Column:
    """A parity sketch brought to the length of a shorter one (half of it; sizes within the
    similarity's ratio differ by less than a doubling for similarities above one half)."""
    half = F.size(to)
    return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)


def _some(table: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Rows of ``table`` whose node is among ``nodes`` (``count`` of them)."""
    return table.join(F.broadcast(nodes) if count <= FEW else nodes, "node", "left_semi")


def _compared(pairs: DataFrame, details: DataFrame, columns: list[str], fit: Column) -> DataFrame:
    """Those of the written ``pairs(a, b)`` whose ``columns``, as structs x and y, ``fit``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = _some(details, nodes, nodes.count()).select("node", F.struct(*columns).alias("it"))
    pairs = (pairs.join(some.select(F.col("node").alias("a"), F.col("it").alias("x")), "a")
             .join(some.select(F.col("node").alias("b"), F.col("it").alias("y")), "b"))
    return Settled(pairs.where(fit).select("a", "b")).df


def _filtered(pairs: DataFrame, details: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)``, which share a token of the first order, that pass the wide
    sketch and the filters of the other orders."""
    pairs, x, y = Settled(pairs).df, F.col("x.wide"), F.col("y.wide")
    if 2 * num > den:
        pairs = _compared(pairs, details, ["n", "wide"], _apart(_folded(x, y), _folded(y, x)) * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num))
    return _compared(pairs, details, ["second", "third"], F.arrays_overlap("x.second", "y.second") & F.arrays_overlap("x.third", "y.third"))


def _verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` (nodes) whose sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = Settled(nodes.join(classes, "node").select("node", "least"))
    count = needed.df.count()
    if not count:
        return pairs
    filled = documents.sparkSession.sparkContext.broadcast(bloom(needed.df.select("least"), bloom_size(count)))
    sets = map_arrow(documents, lambda batch: _wanted(batch.column(0), batch.column(1), n, filled.value), "node long, tokens binary")
    # One shuffle by node serves the grouping and both joins.
    sets = _some(sets, needed.df.select("node"), count).groupBy("node").agg(F.first("tokens").alias("tokens"))
    both = (pairs.join(sets.withColumnsRenamed({"node": "b", "tokens": "y"}), "b")
            .join(sets.withColumnsRenamed({"node": "a", "tokens": "x"}), "a").select("a", "b", "x", "y"))
    both = map_arrow(both, _shared, "a long, b long, both long, na long, nb long")
    links = Settled(both.where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b"))
    needed.free()
    filled.destroy()
    return links.df


def jaccard_join(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``documents``: ``id``, ``n_shingles`` and ``component_id``, the
    smallest id reachable by links (texts linked when den * intersection >= num * union)."""
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common = spark.sparkContext.broadcast(_frequencies(source.select("text"), n))
    profile = Settled(map_arrow(source, lambda b: _profiles(b.column(0), b.column(1), n, num, den, common.value), _PROFILE)).df
    common.destroy()
    facts = ["n", "typical", "sketch", "first", "second", "third", "wide"]
    unique = profile.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.first(F.struct("node", *facts)).alias("it"))
    unique = Settled(unique.select("node", "least", "it.n", "it.typical", "it.sketch", "it.first", "it.second", "it.third", "it.wide")).df
    classes, details = unique.select("node", "least"), unique.select("node", "n", "second", "third", "wide")

    # Buckets of a prefix token and size class that hold two classes or more.  Both sides of
    # the join read the same two columns, so that one shuffle by key serves them.
    size = F.floor(F.log2("n")).cast("int")
    sizes = F.array_distinct(F.array(size, F.floor(F.log2(F.col("n") * den / num + 1e-6)).cast("int")))
    tokens = unique.select("node", "first", F.explode(sizes if 2 * num >= den else F.array(F.lit(0))).alias("size")).select("node", F.explode(F.transform("first", lambda t: F.xxhash64(t, F.col("size")))).alias("token")).repartition("token")
    shared = tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token")
    buckets = Settled(tokens.join(shared.hint("merge"), "token").distinct()).df

    # Every member against its bucket's leader.  Bucket rows carry no sets or prefixes.
    short = Settled(unique.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "n", "typical", "sketch")).df
    ranked = buckets.join(short.select("node", "typical"), "node")
    leaders = ranked.groupBy("token").agg(F.max(F.struct("typical", "node"))["node"].alias("leader"))
    pairs = buckets.join(leaders, "token").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    near = (pairs.join(short.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("x")), "a")
            .join(short.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y")), "b").where(_near("x", "y", num, den)))
    pairs = _filtered(near.select("a", "b"), details, num, den)
    links = _verified(pairs, source, classes, n, num, den)
    joined = Settled(components(links)).df

    # Then members of different components, unless both are in the bucket's main one.
    placed = buckets.join(joined, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root")).repartition("token")
    several = placed.groupBy("token").agg(F.min(F.struct("root", "node"))["root"].alias("low"), F.max(F.struct("root", "node"))["root"].alias("high")).where("low < high").select("token")
    placed = Settled(placed.join(several.hint("merge"), "token")).df
    sized = placed.groupBy("token", "root").agg(F.count("*").alias("members"))
    main = sized.groupBy("token").agg(F.max(F.struct("members", "root"))["root"].alias("main"))
    placed = placed.join(main, "token").join(short, "node").select("token", "root", (F.col("root") == F.col("main")).alias("inside"), F.struct("node", "n", "sketch").alias("it"))
    left = placed.where(~F.col("inside")).select("token", F.col("root").alias("root_x"), F.col("it").alias("x"))
    right = placed.select(F.col("token").alias("token_y"), F.col("root").alias("root_y"), "inside", F.col("it").alias("y"))
    other = F.col("inside") | (F.col("x.node") < F.col("y.node"))
    crossing = left.join(right, (F.col("token") == F.col("token_y")) & (F.col("root_x") != F.col("root_y")) & other & _near("x", "y", num, den))
    crossing = crossing.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    crossing = _filtered(crossing, details, num, den)
    more = _verified(crossing, source, classes, n, num, den)
    if more.take(1):
        joined = Settled(components(links.unionByName(more))).df

    roots = classes.join(joined, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    named = profile.select("id", "n", "node").join(named, "node", "left")
    return named.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of linked texts, and of rows that repeat both id and text.

    Rows are told apart by id and text, so rows without an id and different texts that
    share one are judged each for itself; texts without words all stay, repeats apart."""
    columns = documents.columns
    keyed = documents.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.xxhash64(id_col, text_col).alias("key"))
    groups = Settled(jaccard_join(keyed.select("key", F.col("row")[text_col].alias("text")), id_col="key", **how).select(F.col("id").alias("key"), "component_id")).df
    drop = groups.where("key <> component_id").select("key").distinct()
    again = groups.where("key = component_id").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    few = lambda keys: F.broadcast(keys) if keys.count() <= FEW else keys
    kept, again = keyed.join(few(Settled(drop).df), "key", "left_anti"), few(Settled(again).df)
    once = kept.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return kept.join(again, "key", "left_anti").select("row.*").unionByName(once.select("row.*"))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns: three words, 90 of 100."""
    return jaccard_join(documents, 3, 90, 100).withColumnRenamed("id", "doc_id")
