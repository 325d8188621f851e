"""What is kept up instead of recomputed: stored versions that are compared by hash trees, and
aggregates whose partial states are kept by input file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.jobs import latest_state as latest_state_sql
from ..plans.dialect import DUCK
from ..plans.registry import plan, table
from ..plans.tables import shared_dir, written
from .versioned import VersionedTable

LEAF, FAN, FEW = 4096, 16, 1000


class Snapshots:
    """Versions of ``(id long, text)`` in a folder, dealt into leaves of ``width`` ids in a row.

    Beside its rows a version has a tree of hashes: a leaf's is made of the hashes of its rows, a
    node's of those of its ``FAN`` children.  Two versions are compared from the top; equal
    subtrees are skipped, and only the leaves that differ are read.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = LEAF):
        self.spark, self.path, self.width = spark, path.rstrip("/"), width

    def write(self, rows: DataFrame, version: str) -> None:
        """A version; a row without an id takes no part, rows that share one are taken together."""
        dealt = rows.where("id IS NOT NULL").select("id", "text", F.floor(F.col("id") / self.width).alias("leaf"))
        dealt.repartition("leaf").sortWithinPartitions("leaf", "id").write.mode("overwrite").partitionBy("leaf").parquet(f"{self.path}/rows/{version}")
        stored = self.rows(version)
        row = [F.xxhash64("id", "text", F.col("text").isNull(), F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]
        node = stored.groupBy(F.col("leaf").alias("node")).agg(F.xxhash64(F.sum(row[0]), F.count("*")).alias("a"), F.xxhash64(F.sum(row[1]), F.count("*")).alias("b"))
        level, out = 0, f"{self.path}/trees/{version}"
        node.withColumn("level", F.lit(level)).write.mode("overwrite").partitionBy("level").parquet(out)
        while True:
            below = self.tree(version, level)
            ends = below.agg(F.min("node"), F.max("node")).first()
            if ends[0] is None or ends[1] - ends[0] < FAN // 2:
                break  # a handful of nodes is the top
            kids = F.sort_array(F.collect_list(F.struct("node", "a", "b")))  # at most FAN
            up = below.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(kids.alias("k")).select(F.col("up").alias("node"), F.xxhash64("k", F.lit(1)).alias("a"), F.xxhash64("k", F.lit(2)).alias("b"))
            level += 1
            up.withColumn("level", F.lit(level)).write.mode("append").partitionBy("level").parquet(out)

    def rows(self, version: str) -> DataFrame:
        return self.spark.read.schema("id long, text string, leaf long").parquet(f"{self.path}/rows/{version}")

    def tree(self, version: str, level: int | None = None) -> DataFrame:
        nodes = self.spark.read.schema("node long, a long, b long, level int").parquet(f"{self.path}/trees/{version}")
        return nodes if level is None else nodes.where(F.col("level") == level).select("node", "a", "b")

    def changed_leaves(self, old: str, new: str) -> DataFrame:
        """``leaf``: those that differ, or are in one version only."""
        tops = [self.tree(v).agg(F.max("level")).first()[0] for v in (old, new)]
        if None in tops:
            return self.tree(new if tops[0] is None else old, 0).select(F.col("node").alias("leaf"))
        level = min(tops)
        open_ = None
        while level >= 0:
            sides = [self.tree(v, level).toDF("node", f"a_{i}", f"b_{i}") for i, v in enumerate((old, new))]
            if open_ is not None:
                sides = [s.join(open_, F.floor(F.col("node") / FAN) == F.col("up"), "left_semi") for s in sides]
            both = sides[0].join(sides[1], "node", "full")
            open_ = written(both.where(~(F.col("a_0").eqNullSafe(F.col("a_1")) & F.col("b_0").eqNullSafe(F.col("b_1")))).select(F.col("node").alias("up")))
            level -= 1
        return open_.select(F.col("up").alias("leaf"))

    def reading(self, version: str, leaves: DataFrame) -> DataFrame:
        """The rows in ``leaves``: up to ``FEW`` of them as a filter of folders, more as a join."""
        some = [r["leaf"] for r in leaves.limit(FEW + 1).collect()]
        return self.rows(version).where(F.col("leaf").isin(some)) if len(some) <= FEW else self.rows(version).join(leaves, "leaf", "left_semi")

    def diff(self, old: str, new: str, deleted: bool = False) -> DataFrame:
        """``(id, change)``: new and changed, on request deleted ids of ``new`` against ``old``."""
        leaves = self.changed_leaves(old, new)
        sides = []
        for i, version in enumerate((old, new)):
            sides.append(self.reading(version, leaves).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("text", F.lit(1)), F.xxhash64("text", F.lit(2)), F.col("text").isNull()))).alias(f"t{i}")))
        met = sides[0].join(sides[1], "id", "full")
        change = F.when(F.col("t0").isNull(), "new").when(F.col("t1").isNull(), "deleted" if deleted else None).when(F.col("t0") != F.col("t1"), "changed")
        return met.select("id", change.alias("change")).where("change IS NOT NULL")


class KeptAggregate:
    """An aggregate over a folder of files that only grows: the partial state of each file is made
    once, and a refresh reads the files that are new or were written again.

    ``partial`` makes ``columns`` of some rows, ``merge`` brings rows of ``columns`` together.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, partial: Callable, merge: Callable):
        self.spark, self.partial, self.merge, self.columns = spark, partial, merge, columns
        self.table = VersionedTable(spark, path, f"{columns}, file string, at timestamp")

    def refresh(self, rows: DataFrame) -> int:
        """Take in what is new in ``rows`` (read from files); the number of files read for it."""
        known = self.table.read().select("file", "at").distinct()
        here = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at")).distinct()
        fresh = [r["file"] for r in here.join(known, ["file", "at"], "left_anti").select("file").collect()]  # names of new files
        if fresh:
            tagged = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at")).where(F.col("_metadata.file_path").isin(fresh))
            names = [c.split()[0].strip("`") for c in self.columns.split(", ")]
            self.table.commit(self.partial(tagged, ["file", "at"]).select(*names, "file", "at"), "files", self.table.version().n)
        return len(fresh)

    def result(self) -> DataFrame:
        """The newest state of each file, merged."""
        newest = Window.partitionBy("file").orderBy(F.desc("at"))
        states = self.table.read().withColumn("place", F.rank().over(newest)).where("place = 1")
        return self.merge(states.drop("file", "at", "place"))


def kept_latest(spark: SparkSession, path: str) -> KeptAggregate:
    """The latest event of each user."""
    best = lambda df, by: df.groupBy("user_id", *by).agg(F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", *by, "e.*")
    return KeptAggregate(spark, path, "user_id long, ts timestamp_ntz, event_id long, event_type string", best, lambda states: best(states, []))


def kept_lessons(spark: SparkSession, path: str) -> KeptAggregate:
    """How often each lesson (event type and its number) came."""
    lesson = F.concat("event_type", F.lit(" "), F.regexp_extract("props", '"k": *([0-9]+)', 1)).alias("lesson")
    return KeptAggregate(spark, path, "lesson string, n long", lambda df, by: df.groupBy(lesson, *by).agg(F.count("*").alias("n")), lambda states: states.groupBy("lesson").agg(F.sum("n").alias("n")))


def _grown(spark, sf_dir, make) -> DataFrame:
    """The aggregate after three portions of the events have come in, one after the other."""
    folder = f"{shared_dir(spark)}/i-{uuid.uuid4().hex}"
    events, kept = table(spark, sf_dir, "events"), make(spark, f"{folder}/states")
    for i in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == i).write.mode("append").parquet(f"{folder}/in")
        kept.refresh(spark.read.schema(events.schema).parquet(f"{folder}/in"))
    return kept.result()


@plan(latest_state_sql(DUCK))
def kept_latest_state(spark, sf_dir):
    """The rows of ``latest_state``, kept up file by file."""
    return _grown(spark, sf_dir, kept_latest).select("user_id", F.col("event_type").alias("state"), "event_id")


@plan("SELECT event_type || ' ' || regexp_extract(props, '\"k\": *([0-9]+)', 1) AS lesson, count(*) AS n FROM events GROUP BY 1")
def kept_lesson_counts(spark, sf_dir):
    """Lessons by frequency, kept up file by file."""
    return _grown(spark, sf_dir, kept_lessons)


@plan("SELECT doc_id, CASE WHEN doc_id % 64 = 5 AND doc_id < 500 THEN 'new' WHEN doc_id % 64 = 9 AND doc_id < 500 THEN 'changed' END AS change FROM documents WHERE doc_id % 64 IN (5, 9) AND doc_id < 500 AND (doc_id % 64 = 5 OR text IS NOT NULL)")
def snapshot_changes(spark, sf_dir):
    """Documents that are new or changed since a stored version that lacked some and had others with another end."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    low = F.col("id") < 500
    old = docs.where(~(low & (F.col("id") % 64 == 5))).withColumn("text", F.when(low & (F.col("id") % 64 == 9), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    store = Snapshots(spark, f"{shared_dir(spark)}/v-{uuid.uuid4().hex}", 256)
    store.write(old, "old")
    store.write(docs, "new")
    return store.diff("old", "new").withColumnRenamed("id", "doc_id")
