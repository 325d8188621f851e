"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits a bounded sample (``SAMPLE`` distinct vectors of lowest hash) by
the plane half-way between two random points until a leaf has ``LEAF`` points; one
task builds one tree.  *Every* distinct vector is then placed in its leaf of every
tree.  A query walks all trees through one shared priority queue, ordered by the
least margin on the way, and takes leaves until they hold a ``SHARE`` of all sample
points (much, as the vectors at hand have no structure to speak of; recall is held
above 0.9; clustered vectors need far less).
Vectors and queries meet by leaf (hash-dealt buckets; leaves that outgrow the
sample are split by a salt on the vector side and the query copied to each part),
and candidates are ranked exactly, in double precision, on the original vectors.

Equal vectors are one class; of a class only its ``k`` + 1 smallest ids can be
among a query's ``k`` nearest, so hot vectors cost no more than others.

Edge cases: vectors that are null, zero, of another length than the most frequent
one or that hold null or non-finite components take no part, as query or as
candidate, and neither do rows without an id; repeated ids with equal vectors count
once; with ``k`` or fewer other vectors a query gets them all if they are found; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Settled

TREES, LEAF, SHARE, SAMPLE, K = 10, 16, 0.7, 65_536, 10
BUCKET_ROWS, PART_ROWS = 50_000, 4096


class Tree:
    """Planes of inner nodes; children >= 0 are nodes, below 0 leaf ``-1 - child``."""

    def __init__(self, points: np.ndarray, seed: int, leaf: int):
        rng = np.random.default_rng(seed)
        self.planes, self.offsets, self.children, self.sizes = [], [], [], []
        self.root = self._grow(points, np.arange(len(points)), rng, leaf, 0)
        self.planes = np.array(self.planes, np.float64).reshape(len(self.offsets), points.shape[1])
        self.offsets, self.children = np.array(self.offsets), np.array(self.children, np.int64).reshape(-1, 2)

    def _grow(self, points, rows, rng, leaf, depth) -> int:
        if len(rows) > leaf and depth < 60:
            for _ in range(5):
                a, b = points[rng.choice(rows, 2, replace=False)].astype(np.float64)
                plane = a - b
                if not (norm := np.linalg.norm(plane)):
                    continue
                plane /= norm
                offset = -plane @ (a + b) / 2
                right = points[rows] @ plane + offset > 0
                if 0.05 < right.mean() < 0.95:
                    at = len(self.offsets)
                    self.planes.append(plane)
                    self.offsets.append(offset)
                    self.children.append((0, 0))
                    self.children[at] = (self._grow(points, rows[~right], rng, leaf, depth + 1), self._grow(points, rows[right], rng, leaf, depth + 1))
                    return at
        self.sizes.append(len(rows))
        return -len(self.sizes)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        at = np.full(len(x), self.root)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            side = np.einsum("ij,ij->i", x[open_], self.planes[node]) + self.offsets[node] > 0
            at[open_] = self.children[node, side.astype(int)]
        return -1 - at


def leaves(trees: list[Tree], x: np.ndarray, search: int) -> list[tuple[int, int]]:
    """``(tree, leaf)`` pairs for one query: best margins first, over all trees."""
    margins = [t.planes @ x + t.offsets if len(t.offsets) else None for t in trees]
    queue = [(-np.inf, t, tree.root) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    out, held = [], 0
    while queue and held < search:
        worst, t, at = heapq.heappop(queue)
        while at >= 0:
            m = margins[t][at]
            near, far = (1, 0) if m > 0 else (0, 1)
            heapq.heappush(queue, (max(worst, abs(m)), t, int(trees[t].children[at, far])))
            at = int(trees[t].children[at, near])
        out.append((t, -1 - at))
        held += trees[t].sizes[-1 - at]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _usable(vectors: DataFrame) -> DataFrame:
    x = F.col("x")
    fine = vectors.where(F.col("id").isNotNull() & x.isNotNull() & F.exists(x, lambda v: v != 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)))
    length = fine.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("x") == length[0]["n"]) if length else fine


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``vectors(id, x)`` and ``queries(id)``, ids among them."""
    spark = vectors.sparkSession
    usable = _usable(vectors).withColumn("key", F.xxhash64("x"))
    # The k + 1 smallest ids of each distinct vector; the rank filter is applied before the shuffle, too.
    ranked = usable.distinct().withColumn("place", F.row_number().over(Window.partitionBy("key", "x").orderBy("id"))).where(F.col("place") <= k + 1)
    classes = Settled(ranked.groupBy("key", "x").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cls", F.col("ids")[0])).df
    n = classes.count()
    asked = Settled(usable.join(queries.select("id").distinct(), "id", "left_semi").select("id", "key", "x").distinct().join(classes.select("key", "x", "cls"), ["key", "x"]).select("id", "cls", "x")).df
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    points = _matrix(pa.chunked_array(classes.select("x").orderBy(F.xxhash64("key"), "cls").limit(sample).toArrow()["x"].chunks).combine_chunks())
    shared = spark.sparkContext.broadcast(points)

    def build(batches):
        import pickle

        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([pickle.dumps(Tree(shared.value, t, leaf))], pa.binary())], ["t", "tree"])

    import pickle

    made = spark.range(trees, numPartitions=trees).mapInArrow(build, "t long, tree binary").orderBy("t").collect()
    forest = spark.sparkContext.broadcast([pickle.loads(r["tree"]) for r in made])
    parts = max(1, -(-n * leaf // (len(points) * PART_ROWS)))
    buckets = max(8, n * trees // BUCKET_ROWS)

    def bucket(t, leaf_, part):
        return (np.asarray(t) * 1_000_003 + np.asarray(leaf_) * 7919 + np.asarray(part) * 104_729) % buckets

    search = max(share * len(points), min(len(points), 8 * (k + 1) * leaf))

    def code(t, leaf_, part):
        return (np.asarray(t, np.int64) << 48) | (np.asarray(leaf_, np.int64) << 20) | np.asarray(part, np.int64)

    def put(batches):
        for batch in batches:
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            part = ids % parts
            for t, tree in enumerate(forest.value):
                at = tree.place(x)
                yield pa.RecordBatch.from_arrays([pa.array(bucket(t, at, part)), pa.array(code(t, at, part)), batch.column(0), batch.column(1).cast(pa.list_(pa.float64()))], ["bucket", "spot", "cls", "x"])

    def ask(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            for i in range(len(x)):
                t, at = (np.array(c) for c in zip(*leaves(forest.value, x[i], search)))
                t, at, part = np.tile(t, parts), np.tile(at, parts), np.repeat(np.arange(parts), len(t))
                to, spots = bucket(t, at, part), code(t, at, part)
                here = np.unique(to)
                taken = batch.take(pa.array(np.full(len(here), i)))
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array([spots[to == b] for b in here], pa.list_(pa.int64())), taken.column(0), taken.column(1).cast(pa.list_(pa.float64()))], ["bucket", "spots", "cls", "x"])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        """Exact distances to all that is in a query's leaves here; its k + 1 nearest classes."""
        q, v, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            spots, ids, x = left["spot"].to_numpy(), left["cls"].to_numpy(), _matrix(left["x"].combine_chunks())
            order = np.argsort(spots, kind="stable")
            spots, ids, x = spots[order], ids[order], x[order]
            for cls, wanted, own in zip(right["cls"].to_pylist(), right["spots"], _matrix(right["x"].combine_chunks())):
                wanted = np.asarray(wanted.values)
                low, high = np.searchsorted(spots, wanted), np.searchsorted(spots, wanted, side="right")
                rows = np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())
                near, once = np.unique(ids[rows], return_index=True)
                rows = rows[once]
                apart = np.sqrt(((x[rows] - own) ** 2).sum(1))
                if len(apart) > k + 1:
                    keep = np.flatnonzero(apart <= np.partition(apart, k)[k])
                    keep = keep[np.lexsort((near[keep], apart[keep]))[: k + 1]]
                    near, apart = near[keep], apart[keep]
                q.append(np.full(len(near), cls)), v.append(near), d.append(apart)
        return pa.table([pa.array(np.concatenate(q)), pa.array(np.concatenate(v)), pa.array(np.concatenate(d))], ["q", "v", "score"])

    placed = classes.select("cls", "x").mapInArrow(put, "bucket long, spot long, cls long, x array<double>").groupBy("bucket")
    sought = asked.select("cls", "x").distinct().repartition(max(8, spark.sparkContext.defaultParallelism), "cls").mapInArrow(ask, "bucket long, spots array<long>, cls long, x array<double>").groupBy("bucket")
    found = placed.cogroup(sought).applyInArrow(rank, "q long, v long, score double").distinct()
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("score", "v"))).where(F.col("place") <= k + 1)
    # Classes back to ids; a query never gets its own row.
    near = near.join(classes.select(F.col("cls").alias("v"), "ids"), "v").groupBy("q").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct("score", i.alias("vec_id")))))).alias("all"))
    out = asked.select("id", F.col("cls").alias("q")).distinct().join(near, "q")
    out = out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("all", lambda h: h["vec_id"] != F.col("id")), 1, k)).alias("i", "h"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def report(embeddings: DataFrame) -> DataFrame:
    """Queries: ids divisible by 100; candidates: every other row."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("x"))
    return nearest(vectors, vectors.where("id % 100 = 0"))
