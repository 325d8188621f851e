"""Shared helpers of the training-data operators: durable intermediate tables,
Bloom filters of fixed size, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder and a cluster
    session a folder inside the SQL warehouse, which its executors share.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="rillstone-"))


class Settled:
    """A DataFrame written as Parquet in the shared folder and read back.

    It cuts lineage: a lost executor costs a re-read of the files, not a
    recomputation.  ``free()`` removes the files once nothing lazy needs them.
    ``group_bytes`` bounds a row group, and with it what a task buffers.
    """

    def __init__(self, df: DataFrame, group_bytes: int = 128 << 20, codec: str = "snappy"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/t-{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", group_bytes).option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def free(self) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` by way of a written table (see :class:`Settled`)."""
    return Settled(df).df


def give_back() -> None:
    """Hand freed memory to the system: a Python worker lives on after its task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def let_go(spark: SparkSession) -> None:
    """Have the driver notice which shuffles nothing refers to any more, so that their files go
    before the next step writes its own."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over single batches; ``step`` yields any number of batches."""

    def run(batches):
        for batch in batches:
            yield from step(batch)
        give_back()

    return df.mapInArrow(run, schema)


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.astype(np.uint64, copy=False)
    again = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    again ^= again >> np.uint64(33)
    return (keys >> np.uint64(7)) & np.uint64(size - 1), again & np.uint64(size - 1)


def bloom_size(n: int, most: int = 1 << 26) -> int:
    """Bits for ``n`` keys: a power of two, 16 a key, at most ``most`` (8 MB).

    Beyond the bound only the share of false positives grows; every use is
    followed by an exact join.
    """
    return min(most, 1 << max(16, int(16 * max(n, 1) - 1).bit_length()))


def merged(parts: DataFrame, merge: Callable, schema: str, fan: int = 16) -> DataFrame:
    """``parts`` (rows of equal, bounded size) brought down to one row by two shuffled
    rounds of ``merge``, a ``mapInArrow`` function that makes one row of a task's rows."""
    return parts.repartition(fan).mapInArrow(merge, schema).repartition(1).mapInArrow(merge, schema)


def bloom(keys: DataFrame, size: int, fan: int = 16) -> np.ndarray:
    """A Bloom filter (uint8 array of ``size`` / 8) of the one long column of ``keys``.

    The keys themselves are dealt to ``fan`` tasks, each of which fills a filter of its
    own; one task ORs those ``fan`` filters, so neither it nor the driver reads more than
    ``fan`` of them, however many tasks made the keys.
    """

    def local(batches):
        own = np.zeros(size, bool)
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            for place in _bits(values, size):
                own[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

    def joined(batches):
        own = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for value in batch.column(0):
                own |= np.frombuffer(value.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bits"])

    rows = keys.repartition(fan).mapInArrow(local, "bits binary").repartition(1).mapInArrow(joined, "bits binary").collect()
    return np.frombuffer(rows[0][0], np.uint8) if rows else np.zeros(size // 8, np.uint8)


def in_bloom(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of ``keys`` (uint64) that may be in the filter."""
    size, hit = len(filled) * 8, np.ones(len(keys), bool)
    for place in _bits(keys, size):
        hit &= (filled[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return hit


def fitted(sample: DataFrame, train: Callable[[pa.Table], object]) -> object:
    """``train`` of the whole of ``sample`` (rows of a stated bound), run in one task, so
    that the driver gets no more than what it returns (None for an empty sample)."""
    import pickle

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            made = pickle.dumps(train(pa.Table.from_batches(batches)))
            batches.clear()
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["made"])

    rows = sample.repartition(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(rows[0][0]) if rows else None


def binary_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values of ``width`` float32 numbers as the rows of a matrix."""
    parts = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, width))
    return np.concatenate(parts) if parts else np.zeros((0, width), np.float32)


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves ``rest`` modulo ``modulus``."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``links(a long, b long)`` as ``(node, root)``.

    ``root`` is the smallest node of the component.  Alternates the large-star and
    small-star steps: each takes a minimum per node with a partial aggregate and
    joins it back, so no neighbourhood is ever gathered.  Nodes without links
    don't appear.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    kept, before = Settled(edges.select("u", "v")), None
    for _ in range(limit):
        e = kept.df
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = Settled(small.where("u <> v").distinct())
        sign = after.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        kept.free()
        kept = after
        if tuple(sign) == before:
            break
        before = tuple(sign)
    else:
        raise RuntimeError("components did not settle")
    e = kept.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
