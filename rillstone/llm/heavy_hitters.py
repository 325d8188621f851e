"""Guaranteed heavy hitters of every group, by a count-min grid with majority votes.

A group's grid has ``ROWS`` rows of ``COLUMNS`` cells; a key falls in one cell of each
row.  A cell holds its *total* weight and a majority vote: a *candidate* and its *votes*,
so that the cell's weight is the votes of the candidate plus pairs of unlike keys.  Hence
the candidate weighs at least its votes and at most (total + votes) / 2, and any other key
of the cell at most (total - votes) / 2.  Votes of parts of the data are added up by the
same rule, in any order (``_vote`` and ``_merged``).

A group's grid is *sure* if one row has no cell in which a heavy key could hide behind
another candidate, and if the bounds of each possible heavy key lie within 1 / ``WIDTH``
of the group's total.  Groups that aren't are built again with Misra-Gries summaries of
``COUNTERS`` counters, which err by at most total / (``COUNTERS`` + 1) and so always
suffice.  The candidates left are recounted, and those above the share are returned.

Heavy groups (more than 1 / ``SLICES`` of all entries, and more than ``SLICE_ROWS``) are
dealt out in slices whose grids are added up; their list is the only thing broadcast
beside two Bloom filters of fixed size, which only spare shuffling: exact joins follow.

Entries: a null group, key or weight drops the entry; repeated rows count again; keys are
compared as strings, however long; a weight of 0 counts as an entry; a negative weight is
an error, as no summary bounds it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Settled, bloom, give_back, in_bloom

SHARE, WIDTH = 10, 40
ROWS, COLUMNS, COUNTERS = 2, 64, WIDTH
SLICES, SLICE_ROWS = 4096, 1 << 14
FLUSH, BLOOM_BITS = 1 << 20, 1 << 24
_CELLS = "stream string, grp long, cell int, item string, votes long, total long"
_COUNTED = "stream string, grp long, item string, c long"
_GROUP = ["stream", "grp"]


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    made = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins (columns are sorted)."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _vote(votes: pa.Table) -> pa.Table:
    """One row for each cell of ``votes``: unlike keys are paired off, what is left votes on.

    An entry is a cell of its own, with its weight as votes and total.
    """
    (stream, streams), (item, items) = _codes(votes["stream"]), _codes(votes["item"])
    grp, cell, weight, total = (votes[c].to_numpy() for c in ("grp", "cell", "votes", "total"))
    order = np.lexsort((item, cell, grp, stream))
    stream, grp, cell, item, weight, total = (x[order] for x in (stream, grp, cell, item, weight, total))
    head = _heads(stream, grp, cell, item)
    weight, total = np.add.reduceat(weight, head), np.add.reduceat(total, head)
    stream, grp, cell, item = (x[head] for x in (stream, grp, cell, item))
    start = _heads(stream, grp, cell)
    run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(cell)]))
    last = np.lexsort((weight, run))[np.r_[start[1:], len(cell)] - 1]  # the most votes of each cell
    cast = np.add.reduceat(weight, start)
    left = np.maximum(2 * weight[last] - cast, cast & 1)
    columns = [streams.take(pa.array(stream[start])), pa.array(grp[start]), pa.array(cell[start].astype(np.int32)), items.take(pa.array(item[last])), pa.array(left), pa.array(np.add.reduceat(total, start))]
    return pa.Table.from_arrays(columns, names=["stream", "grp", "cell", "item", "votes", "total"])


def _flushed(batches, step, most: int = FLUSH):
    """``step`` of tables of about ``most`` rows, its results gathered and put through it again."""
    held, rows, kept = [], 0, []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= most:
            kept.append(step(pa.Table.from_batches(held)))
            held, rows = [], 0
            if len(kept) > 1 and sum(t.num_rows for t in kept) >= most:
                kept = [step(pa.concat_tables(kept).combine_chunks(), again=True)]
                if kept[0].num_rows >= most:
                    yield from kept.pop().to_batches(1 << 16)
    if held:
        kept.append(step(pa.Table.from_batches(held)))
    if kept:
        yield from (step(pa.concat_tables(kept).combine_chunks(), again=True) if len(kept) > 1 else kept[0]).to_batches(1 << 16)
    give_back()


def _grids(entries: DataFrame) -> DataFrame:
    """Cells of the parts of each group that meet in a task."""

    def step(table, again=False):
        if again:
            return _vote(table)
        h, w = table["h"].to_numpy().view(np.uint64), table["w"]
        cells = [pa.array((((h >> np.uint64(20 * r)) % np.uint64(COLUMNS)).astype(np.int32) + r * COLUMNS)) for r in range(ROWS)]
        rows = [pa.Table.from_arrays([table["stream"], table["grp"], pa.chunked_array([c]), table["item"], w, w], names=["stream", "grp", "cell", "item", "votes", "total"]) for c in cells]
        return _vote(pa.concat_tables(rows))

    return entries.select("stream", "grp", "item", F.xxhash64("item").alias("h"), "w").mapInArrow(lambda batches: _flushed(batches, step), _CELLS)


def _merged(cells: DataFrame) -> DataFrame:
    """``_vote`` over the parts of all tasks, and the cells of a group as one array (at most ``ROWS * COLUMNS``)."""
    own = cells.repartition(*_GROUP).groupBy(*_GROUP, "cell", "item").agg(F.sum("votes").alias("votes"), F.sum("total").alias("total"))
    best = F.max(F.struct("votes", "item")).alias("best")
    voted = own.groupBy(*_GROUP, "cell").agg(best, F.sum("votes").alias("cast"), F.sum("total").alias("v"))
    left = F.greatest(2 * F.col("best.votes") - F.col("cast"), F.col("cast") % 2)
    return voted.groupBy(*_GROUP).agg(F.collect_list(F.struct("cell", F.col("best.item").alias("item"), left.alias("c"), "v")).alias("cells"))


def _judged(grids: DataFrame, totals: DataFrame, share: int, width: int) -> DataFrame:
    """Each group's possible heavy keys with their bounds, and whether its grid is sure."""
    row = lambda r: F.filter("cells", lambda x: F.floor(x["cell"] / COLUMNS) == r)
    hides = lambda x: F.lit(share) * F.floor((x["v"] - x["c"]) / 2).cast("long") > F.col("total")
    open_row = F.array_min(F.array(*[F.exists(row(r), hides) for r in range(ROWS)]))
    likely = F.array_distinct(F.transform(F.filter("cells", lambda x: F.lit(share) * (x["v"] + x["c"]) > 2 * F.col("total")), lambda x: x["item"]))
    h = lambda item, r: F.pmod(F.shiftrightunsigned(F.xxhash64(item), 20 * r), F.lit(COLUMNS)).cast("int") + r * COLUMNS

    def bounds(item):
        mine = [F.element_at(F.filter("cells", lambda x: x["cell"] == h(item, r)), 1) for r in range(ROWS)]
        high = F.least(*[F.when(m["item"] == item, m["v"] + m["c"]).otherwise(m["v"] - m["c"]) for m in mine])
        low = F.greatest(*[F.when(m["item"] == item, m["c"]).otherwise(F.lit(0)) for m in mine])
        return F.struct(item.alias("item"), low.cast("long").alias("low"), F.shiftright(high, 1).cast("long").alias("high"))

    possible = F.filter(F.transform("likely", bounds), lambda x: F.lit(share) * x["high"] > F.col("total"))
    judged = grids.join(totals, _GROUP).withColumn("open_row", open_row).withColumn("likely", likely).withColumn("possible", possible)
    return judged.select(*_GROUP, "possible", (~F.col("open_row") & F.forall("possible", lambda x: F.lit(width) * (x["high"] - x["low"]) <= F.col("total"))).alias("sure"))


def _misra_gries(table: pa.Table, again: bool = False) -> pa.Table:
    """At most ``COUNTERS`` counters for each group, and what they were cut by (a null item)."""
    table = table.rename_columns(["stream", "grp", "item", "c"])
    lost = table.filter(pc.is_null(table["item"]))
    table = table.filter(pc.is_valid(table["item"]))
    (stream, streams), (item, items) = _codes(table["stream"]), _codes(table["item"])
    grp, c = table["grp"].to_numpy(), table["c"].to_numpy()
    order = np.lexsort((item, grp, stream))
    stream, grp, item, c = stream[order], grp[order], item[order], c[order]
    head = _heads(stream, grp, item)
    c = np.add.reduceat(c, head) if len(head) else c
    stream, grp, item = stream[head], grp[head], item[head]
    order = np.lexsort((-c, grp, stream))
    stream, grp, item, c = stream[order], grp[order], item[order], c[order]
    start = _heads(stream, grp)
    size = np.diff(np.r_[start, len(c)])
    cut = np.where(size > COUNTERS, c[np.minimum(start + COUNTERS, len(c) - 1)] if len(c) else 0, 0)
    c = c - np.repeat(cut, size)
    kept, over = np.flatnonzero(c > 0), np.flatnonzero(cut)
    made = pa.Table.from_arrays([streams.take(pa.array(stream[kept])), pa.array(grp[kept]), items.take(pa.array(item[kept])), pa.array(c[kept])], names=table.column_names)
    cuts = pa.Table.from_arrays([streams.take(pa.array(stream[start[over]])), pa.array(grp[start[over]]), pa.nulls(len(over), items.type), pa.array(cut[over])], names=table.column_names)
    if lost.num_rows:
        sums = pa.TableGroupBy(pa.concat_tables([lost, cuts]), _GROUP).aggregate([("c", "sum")])
        cuts = pa.Table.from_arrays([sums["stream"], sums["grp"], pa.nulls(sums.num_rows, items.type), sums["c_sum"]], names=table.column_names)
    return pa.concat_tables([made, cuts])


def _rebuilt(entries: DataFrame, totals: DataFrame, share: int) -> DataFrame:
    """Possible heavy keys and bounds by Misra-Gries: parts by task, then one more cut of their sum."""
    parts = entries.select("stream", "grp", "item", F.col("w").alias("c")).mapInArrow(lambda batches: _flushed(batches, _misra_gries), _COUNTED)
    parts = Settled(parts).df
    lost = parts.where("item IS NULL").groupBy(*_GROUP).agg(F.sum("c").alias("lost"))
    sums = parts.where("item IS NOT NULL").groupBy(*_GROUP, "item").agg(F.sum("c").alias("c"))
    ranked = sums.withColumn("place", F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("c"), "item"))).where(F.col("place") <= COUNTERS + 1)
    kept = ranked.groupBy(*_GROUP).agg(F.collect_list(F.struct("item", "c", "place")).alias("kept")).withColumn("cut", F.coalesce(F.array_max(F.transform(F.filter("kept", lambda x: x["place"] == COUNTERS + 1), lambda x: x["c"])), F.lit(0)))
    all_ = kept.join(lost, _GROUP, "left").join(totals, _GROUP)
    bounds = lambda x: F.struct(x["item"].alias("item"), F.greatest(x["c"] - F.col("cut"), F.lit(0)).alias("low"), (x["c"] + F.coalesce("lost", F.lit(0))).alias("high"))
    return all_.select(*_GROUP, F.filter(F.transform("kept", bounds), lambda x: F.lit(share) * x["high"] > F.col("total")).alias("possible"))


def _passing(entries: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Entries whose ``keys`` may be among ``wanted`` (a filter of fixed size; an exact join has to follow)."""
    filled = bloom(wanted.select(F.xxhash64(*keys)), BLOOM_BITS)

    def run(batches):
        for batch in batches:
            keep = in_bloom(filled, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))
            if keep.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns[:-1], ["stream", "grp", "item", "w"])
        give_back()

    return entries.select("stream", "grp", "item", "w", F.xxhash64(*keys).alias("h")).mapInArrow(run, "stream string, grp long, item string, w long")


def _summed(table: pa.Table, again: bool = False) -> pa.Table:
    sums = pa.TableGroupBy(table, ["stream", "grp", "item"]).aggregate([("w", "sum")])
    return sums.select(["stream", "grp", "item", "w_sum"]).rename_columns(["stream", "grp", "item", "w"])


def heavy_hitters(entries: DataFrame, share: int = SHARE, width: int = WIDTH) -> DataFrame:
    """Keys of ``entries(stream, grp, item, w)`` that weigh more than 1 / ``share`` of their group."""
    if width > COUNTERS:
        raise ValueError("a summary of COUNTERS counters is no narrower than 1 / COUNTERS of the total")
    w = F.col("w").cast("long")
    fine = entries.where("grp IS NOT NULL AND item IS NOT NULL AND w IS NOT NULL")
    checked = F.when(w >= 0, w).otherwise(F.raise_error(F.lit("a weight is negative")).cast("long"))
    held = Settled(fine.select(F.col("stream").cast("string").alias("stream"), F.col("grp").cast("long").alias("grp"), F.col("item").cast("string").alias("item"), checked.alias("w")))
    own = held.df
    totals = Settled(own.groupBy(*_GROUP).agg(F.count("*").alias("n_entries"), F.sum("w").alias("total"))).df
    most = max((totals.agg(F.sum("n_entries")).first()[0] or 0) // SLICES, SLICE_ROWS)
    large = totals.where(F.col("n_entries") > most).select(*_GROUP, F.ceil(F.col("n_entries") / most).alias("slices"))  # fewer than SLICES rows
    none = own.sparkSession.createDataFrame([(None, None, 1)], "stream string, grp long, slices long")  # so that the plan is the same where no group is large
    sliced = own.join(F.broadcast(large.unionByName(none)), _GROUP, "left").withColumn("slice", F.pmod(F.hash(F.monotonically_increasing_id()), F.coalesce("slices", F.lit(1))))
    cells = _grids(sliced.repartition("stream", "grp", "slice"))
    judged = Settled(_judged(_merged(cells), totals.select(*_GROUP, "total"), share, width)).df
    sure = judged.where("sure").select(*_GROUP, F.explode("possible").alias("p"))
    unsure = judged.where("NOT sure").select(*_GROUP)
    again = _rebuilt(_passing(own, _GROUP, unsure), totals.select(*_GROUP, "total"), share).join(unsure, _GROUP).select(*_GROUP, F.explode("possible").alias("p"))
    found = Settled(sure.unionByName(again).select(*_GROUP, "p.item", "p.low", "p.high")).df
    parts = _passing(own, ["stream", "grp", "item"], found).mapInArrow(lambda batches: _flushed(batches, _summed), "stream string, grp long, item string, w long")
    exact = parts.groupBy(*_GROUP, "item").agg(F.sum("w").alias("w"))
    whole = found.join(exact, [*_GROUP, "item"]).join(totals, _GROUP).where(F.lit(share) * F.col("w") > F.col("total"))
    middle = (F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)).cast("long")
    return whole.select("stream", "grp", "item", "n_entries", "total", "w", "low", middle.alias("estimate"), "high")


def of_json(clicks: DataFrame) -> DataFrame:
    """``(grp, item)`` for ``clicks(grp, props)``: operating system, tags and items of a JSON text.

    Texts that aren't JSON as a whole give nothing; numbers stay as written; lists and
    objects in place of a value, as JSON without blanks.
    """

    def refuse(name):
        raise ValueError(name)

    def said(value):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    def keys(text):
        try:
            read = json.loads(text, parse_constant=refuse, parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            return
        if not isinstance(read, dict):
            return
        device, tags, items = (read.get(x) for x in ("device", "tags", "items"))
        if isinstance(device, dict) and device.get("os") is not None:
            yield "os=" + said(device["os"])
        for tag in tags if isinstance(tags, list) else ():
            if tag is not None:
                yield "tag=" + said(tag)
        for item in items if isinstance(items, list) else ():
            if isinstance(item, dict) and item.get("sku") is not None:
                yield "sku=" + said(item["sku"])

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for key in keys(text) if text is not None else ():
                    rows.append(i)
                    found.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["grp", "item"])

    named = F.contains("props", F.lit("\\"))  # a name may be spelt with escapes
    for name in ("device", "tags", "items"):
        named |= F.contains("props", F.lit(f'"{name}"'))
    return clicks.select(F.col("grp").cast("long"), F.col("props").cast("string")).where(F.col("grp").isNotNull() & named).mapInArrow(run, "grp long, item string")


def report(clicks: DataFrame, sale_lines: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long").alias("w")
    user = clicks.select(F.lit("user").alias("stream"), F.unix_date(F.to_date("ts")).cast("long").alias("grp"), F.col("client_id").cast("string").alias("item"), one)
    part = sale_lines.select(F.lit("part").alias("stream"), F.col("vendor_id").alias("grp"), F.col("item_id").cast("string").alias("item"), F.col("quantity").cast("long").alias("w"))
    prop = of_json(clicks.select(F.col("client_id").alias("grp"), "props")).select(F.lit("prop").alias("stream"), "grp", "item", one)
    return heavy_hitters(user.unionByName(part).unionByName(prop))
