"""Top-k retrieval that leaves out what can't reach the first k: postings in blocks with bounds.

Neighbouring texts are a shard, of at most ``SHARD`` postings unless it is one text.  Within a shard a word's postings stand in
one row, by falling impact (the part of BM25 that doesn't depend on the query), in blocks of
``BLOCK``, each with its greatest impact.  A search goes in three steps:

1. *Seed*: the first block of each word is read, from the shard where its impact is greatest, and
   the ``SEEDS`` x k best sums of a query are scored over all their words.  The k-th best of those
   is the threshold.
2. *Prune*: shards and queries meet once.  In each shard the words of a query come by falling
   bounds.  A text that is first met under a word gets no more than the bound of its block and
   those of the words to come: a block where that stays below the threshold isn't read, only looked
   up for texts met before that can still reach it.  ``TIERS`` times a query, the texts are left out that can't reach
   the threshold any more, and the threshold rises to the k-th best sum of the shard.
3. *Finish*: the first k of all shards.

Rows are those of ``Index.search`` (score above 0, ties to the smaller id): a text is left out only
where its bound is below the threshold by more than rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.spans import counted
from ..plans.registry import ask, plan, table
from ..plans.tables import written
from .retrieval import B, K1, Index, _few, bm25
from ..plans.dialect import DUCK

BLOCK, SEEDS, TIERS = 64, 4, 4
SHARD = 1 << 20  # most postings of a shard, which meets a group of queries in one task
QUERIES = 512  # queries that meet a shard at once
_SLACK = 1e-5  # scores are rounded to six places


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _flat(lists: pa.ChunkedArray) -> pa.Array:
    made = pc.list_flatten(lists)
    return made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made


def _numbered(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of ``ids`` in their order, and the distinct ids by number."""
    code = ids.dictionary_encode()
    order = pc.sort_indices(code.dictionary)
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(len(order))
    return number[code.indices.to_numpy()], code.dictionary.take(order)


def _packed(counts: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbouring ``(id, term, f)`` of one id as a row ``(id, dl, terms, fs)``, ``dl`` the sum of ``fs``."""
    code = counts.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
    begin = np.flatnonzero(np.diff(code, prepend=-1))
    upto = pa.array(np.append(begin, len(code)).astype(np.int32))
    total = np.add.reduceat(counts.column(2).to_numpy(), begin) if len(begin) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([counts.column(0).take(pa.array(begin)), pa.array(total), *[pa.ListArray.from_arrays(upto, counts.column(i)) for i in (1, 2)]], ["id", "dl", "terms", "fs"])


def _rows(counts: DataFrame, of) -> DataFrame:
    """``(id, dl, terms, fs)`` of what ``of`` makes of each batch of ``counts``: batches of ``(id, term, f)``."""

    def run(batches):
        for batch in batches:
            yield from map(_packed, of(batch))

    return counts.mapInArrow(run, f"id {_kind(counts, 'id')}, dl long, terms array<string>, fs array<long>")


def _united(rows: DataFrame) -> DataFrame:
    """One row for each id."""
    each = rows.select("id", F.inline(F.arrays_zip("terms", "fs")).alias("term", "f")).groupBy("id", "term").agg(F.sum("f").alias("f"))
    whole = each.groupBy("id").agg(F.sum("f").alias("dl"), F.collect_list(F.struct("term", "f")).alias("x"))
    return whole.select("id", "dl", F.col("x.term").alias("terms"), F.col("x.f").alias("fs"))


def _lists(rows: DataFrame, mean: float, block: int) -> DataFrame:
    """The rows of ``BlockIndex.lists``: neighbouring texts are a shard, without a shuffle."""

    def made(shard: int, texts: pa.Table) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(texts["terms"]).to_numpy())
        terms, f = _flat(texts["terms"]).dictionary_encode(), _flat(texts["fs"]).to_numpy()
        impact = f * (K1 + 1) / (f + K1 * (1 - B + B * texts["dl"].to_numpy()[row] / mean))
        number, ids = _numbered(texts["id"].combine_chunks())
        word = terms.indices.to_numpy()
        order = np.lexsort((number[row], -impact, word))
        impact, number = impact[order], number[row][order]
        size = np.bincount(word, minlength=len(terms.dictionary))
        blocks = -(-size // block)
        upto, heads = (np.concatenate([[0], np.cumsum(x)]) for x in (size, blocks))
        at = np.repeat(upto[:-1] - heads[:-1] * block, blocks) + np.arange(heads[-1]) * block
        packed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
        same = lambda value: pa.array(np.full(len(size), value, np.int64))
        columns = {"shard": same(shard), "term": terms.dictionary, "block": same(block), "size": pa.array(size.astype(np.int64)), "tops": packed(heads, pa.array(impact[at])), "ids": packed(upto, ids.take(pa.array(number))), "impacts": packed(upto, pa.array(impact))}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches):
        shard, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())])
            at = 0
            while at < len(batch):
                stop = max(int(np.searchsorted(upto, upto[at] + SHARD - n, side="right")) - 1, at if held else at + 1)
                held.append(batch.slice(at, stop - at))
                n, at = n + int(upto[stop] - upto[at]), stop
                if at < len(batch):
                    yield made(shard, pa.Table.from_batches(held))
                    shard, held, n = shard + 1, [], 0
        if n:
            yield made(shard, pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"shard long, term string, block long, size long, tops array<double>, ids array<{_kind(rows, 'id')}>, impacts array<double>")


def _first(k: int, tiers: int):
    """The best texts of each query in one shard, ``(query_id, id, s, n)``, and a row without an id
    with the number of postings that were scored.  Of texts of one sum, ``k`` are enough."""

    def run(lists, queries):
        kept, found, sums, read = [], [], [], []
        number, ids = _numbered(_flat(lists["ids"]))
        impact, tops = _flat(lists["impacts"]).to_numpy(), _flat(lists["tops"]).to_numpy()
        size, block = lists["size"].to_numpy(), lists["block"].to_numpy()
        upto, heads = (np.concatenate([[0], np.cumsum(x)]) for x in (size, -(-size // np.maximum(block, 1))))
        words = lists["term"].combine_chunks()
        asked = pc.index_in(_flat(queries["terms"]), value_set=words).fill_null(-1).to_numpy()
        weight = _flat(queries["ws"]).to_numpy()
        own = np.concatenate([[0], np.cumsum(pc.list_value_length(queries["terms"]).to_numpy())])
        for q, theta in enumerate(queries["theta"].to_pylist()):
            place, w = asked[own[q] : own[q + 1]], weight[own[q] : own[q + 1]]
            place, w = place[place >= 0], w[place >= 0]
            bound = w * tops[heads[place]]
            order = np.argsort(-bound, kind="stable")
            place, w, bound = place[order], w[order], bound[order]
            rest = np.cumsum(bound[::-1])[::-1] - bound  # what the words to come can add
            tier = np.floor(np.cumsum(bound) / max(bound.sum(), 1e-300) * tiers * (1 - 1e-9))
            theta = -np.inf if theta is None else theta
            s, scored = np.zeros(len(ids)), 0  # 0: not met, -inf: left out
            for i, (p, v) in enumerate(zip(place, w)):
                begin, end = upto[p], upto[p + 1]
                stop = min(begin + block[p] * int(np.count_nonzero(v * tops[heads[p] : heads[p + 1]] + rest[i] >= theta)), end)
                s[number[begin:stop]] += v * impact[begin:stop]
                scored += int(stop - begin)
                if stop < end:
                    met = np.flatnonzero(s[number[stop:end]] > 0) + stop
                    able = s[number[met]] + v * impact[stop] + rest[i] >= theta
                    s[number[met[~able]]] = -np.inf
                    met = met[able]
                    s[number[met]] += v * impact[met]
                    scored += len(met)
                if i + 1 == len(place) or tier[i + 1] > tier[i]:
                    held = np.flatnonzero(s > 0)
                    if len(held) > k:
                        theta = max(theta, np.partition(s[held], -k)[-k] - _SLACK)
                    s[held[s[held] + rest[i] < theta]] = -np.inf
            near = np.flatnonzero(s > 0)
            near = near[np.argsort(-s[near], kind="stable")]
            fresh = np.flatnonzero(np.diff(s[near], prepend=np.inf))
            near = near[np.arange(len(near)) - np.repeat(fresh, np.diff(np.append(fresh, len(near)))) < k]
            kept.append(len(near))
            found.append(near)
            sums.append(s[near])
            read.append(scored)
        hit = pa.array(np.repeat(np.arange(len(kept)), np.array(kept, np.int64)))
        every = queries["query_id"].combine_chunks()
        hits = pa.table({"query_id": every.take(hit), "id": ids.take(pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))), "s": pa.array(np.concatenate([*sums, np.zeros(0)])), "n": pa.nulls(len(hit), pa.int64())})
        return pa.concat_tables([hits, pa.table({"query_id": every, "id": pa.nulls(len(every), ids.type), "s": pa.nulls(len(every), pa.float64()), "n": pa.array(read, pa.int64())})])

    return run


@dataclass
class BlockIndex:
    """``lists(shard, term, block, size, tops, ids, impacts)``: postings of a shard's word by falling impact
    and the greatest of each ``block`` of them; ``words(term, d, idf)``."""

    lists: DataFrame
    words: DataFrame

    @classmethod
    def of(cls, texts: DataFrame, block: int = BLOCK) -> BlockIndex:
        """Of ``texts(id, text)``.  Words are counted within their row, and only rows whose id occurs
        again are brought together."""
        rows = written(_rows(texts.select("id", "text"), lambda batch: counted(batch.column(0), batch.column(1))))
        total = rows.agg(F.sum("dl")).first()[0] or 0
        n = texts.count()
        known = rows.where("id IS NOT NULL")
        again = written(texts.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
        if again.take(1):
            again = _few(again)
            known = known.join(again, "id", "left_anti").unionByName(_united(known.join(again, "id", "left_semi")))
        return cls._of(known, n, total / n if n else 0.0, block)

    @classmethod
    def build(cls, index: Index, block: int = BLOCK) -> BlockIndex:
        """Of an index's postings, in whatever order they are."""
        return cls._of(_united(_rows(index.postings.select("id", "term", "f"), lambda batch: [batch])), index.n, index.mean, block)

    @classmethod
    def _of(cls, rows: DataFrame, n: int, mean: float, block: int) -> BlockIndex:
        lists, d = written(_lists(rows, mean or 1.0, block)), F.col("d")
        return cls(lists, written(lists.groupBy("term").agg(F.sum("size").alias("d")).withColumn("idf", F.log(1 + (n - d + 0.5) / (d + 0.5)))))

    def save(self, path: str) -> None:
        """By term, so that a search reads the row groups of its terms."""
        self.lists.repartition("term").sortWithinPartitions("term", "shard").write.mode("overwrite").parquet(f"{path}/lists")
        self.words.write.mode("overwrite").parquet(f"{path}/words")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/words"))

    def search(self, queries: DataFrame, k: int = 5) -> Search:
        """The best ``k`` texts of each of ``queries(query_id, q)``."""
        spark = queries.sparkSession
        asked = ask(spark, lambda d: t.term_counts(d, "queries", "query_id", "q"), queries=queries.select("query_id", "q"))
        groups = max(1, -(-queries.count() // QUERIES))
        group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")
        weights = _few(self.words.join(_few(asked), "term").select("query_id", "term", group, (F.col("f") * F.col("idf")).alias("w"), F.col("d").alias("n")))
        # Step 1: the block of greatest impact of each word.
        terms = _few(weights.select("term").distinct())
        own = self.lists.join(terms, "term")
        first = _few(own.groupBy("term").agg(F.max_by("shard", F.col("tops")[0]).alias("shard")))
        start = lambda c: F.slice(c, F.lit(1), F.col("block").cast("int"))
        seed = self.lists.join(first, ["term", "shard"]).select("term", F.inline(F.arrays_zip(start("ids"), start("impacts"))).alias("id", "impact")).join(weights, "term")
        best = Window.partitionBy("query_id").orderBy(F.desc("s"), "id")
        likely = seed.groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("s")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= SEEDS * k)
        likely = _few(likely.select("query_id", "id"))
        met = own.select("term", F.inline(F.arrays_zip("ids", "impacts")).alias("id", "impact")).join(_few(likely.select("id").distinct()), "id", "left_semi")
        tried = met.join(likely, "id").join(weights, ["query_id", "term"]).groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("s"), F.count("*").alias("n"))
        tried = written(tried)
        theta = tried.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query_id", (F.col("s") - _SLACK).alias("theta"))
        # Step 2: each group of queries meets each shard.
        said = weights.groupBy("g", "query_id").agg(F.collect_list(F.struct("term", "w")).alias("x")).join(theta, "query_id", "left")
        said = _few(said.select("g", "query_id", "theta", F.col("x.term").alias("terms"), F.col("x.w").alias("ws")))
        shards = written(self.lists.select("shard").distinct())
        cells = shards.crossJoin(said).groupBy("g", "shard")
        shape = f"query_id {_kind(queries, 'query_id')}, id {self.lists.schema['ids'].dataType.elementType.simpleString()}, s double, n long"
        dealt = self.lists.join(_few(weights.select("term", "g").distinct()), "term").groupBy("g", "shard")
        found = written(dealt.cogroup(cells).applyInArrow(_first(k, TIERS), shape))
        # Step 3: the first of all shards.
        scored = found.where("id IS NOT NULL").select("query_id", "id", F.round("s", 6).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        hits = scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0)).select("query_id", "rank", "id", "score")
        return Search(hits, weights, tried, found)


@dataclass
class Search:
    """Hits, and what was read for them."""

    hits: DataFrame
    words: DataFrame
    tried: DataFrame
    found: DataFrame

    def work(self) -> tuple[int, int]:
        """Postings scored and postings of all words asked for."""
        total = lambda df: df.agg(F.sum("n")).first()[0] or 0
        return total(self.found) + total(self.tried), total(self.words)


def _search(spark, sf_dir, k: int = 5) -> Search:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return BlockIndex.of(docs).search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), k)


@plan(f"{bm25(DUCK)} SELECT query_id, rank, doc_id, score FROM hits")
def blockmax_top5(spark, sf_dir):
    """The rows of ``bm25_top5``, without scoring every posting."""
    return _search(spark, sf_dir).hits.withColumnRenamed("id", "doc_id")
