"""Stateful streams with event-time timers: reply time-outs and stuck signatures.

State is kept in the state store of the query's checkpoint, for ``BUCKETS`` buckets of keys, so
that a batch asks for it once a bucket, not once a key; rows wait in it until the
watermark says that none before them can come any more, so the order in which rows arrive
within the watermark's delay doesn't matter, and a restart goes on where the last batch ended.
Rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import plan, table
from ..plans.tables import shared_dir
from ..sources.versioned import VersionedTable

CAP, CHECK, FORGET = 240, 300, 86_400
BUCKETS, SLICE = 128, 500_000
STORE = "spark.sql.streaming.stateStore.providerClass"


_ROW = ["no_key", "key", "ms", "no_id", "id", "kind", "mark"]


class _Waiting(StatefulProcessor):
    """Rows that wait for the watermark, for all keys of a bucket; subclasses say what to do when it
    has passed.  Rows of ``mark`` carry what a subclass remembers of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [r[_ROW[:-1]].assign(mark=False) for r in rows]
        return self._go_on(parts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._go_on([], timerValues.getCurrentWatermarkInMs())

    def _go_on(self, parts, now) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            parts = [pa.ipc.open_stream(self.held.get()[0]).read_all().to_pandas(), *parts]
        rows = pd.concat([p for p in parts if len(p)], ignore_index=True) if any(map(len, parts)) else None
        out, left, due = (None, None, None) if rows is None else self.step(rows, now)
        if left is not None and len(left):
            table = pa.Table.from_pandas(left[_ROW].assign(kind=left["kind"].astype(object)), preserve_index=False, schema=pa.schema([("no_key", pa.bool_()), ("key", pa.int64()), ("ms", pa.int64()), ("no_id", pa.bool_()), ("id", pa.int64()), ("kind", pa.string()), ("mark", pa.bool_())]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            self.held.update((sink.getvalue().to_pybytes(),))
        elif self.held.exists():
            self.held.clear()
        if due is not None:
            self.handle.registerTimer(max(int(due), now + 1))
        return iter([out] if out is not None and len(out) else [])

    def close(self) -> None:
        pass


def _sorted(rows: pd.DataFrame, *then: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by key and time, then as given; and which begin a key."""
    rows = rows.iloc[np.lexsort((rows["id"], rows["no_id"], *then, rows["ms"], rows["key"], rows["no_key"]))].reset_index(drop=True)
    key, none = rows["key"].to_numpy(), rows["no_key"].to_numpy()
    return rows, np.append(True, (key[1:] != key[:-1]) | (none[1:] != none[:-1]))


def _maybe(values, none) -> pd.Series:
    return pd.Series(np.asarray(values), dtype="Int64").mask(np.asarray(none, bool))


class _Replies(_Waiting):
    """A message is told of once, when its time is up or a reply to it is certain to be the first."""

    def __init__(self, cap: int):
        self.cap = cap * 1000

    def step(self, rows, now):
        rows, opens = _sorted(rows, rows["kind"].to_numpy() == "reply")  # at one time a message before its reply
        ms, reply, group = rows["ms"].to_numpy(), (rows["kind"] == "reply").to_numpy(), np.cumsum(opens) - 1
        n = len(rows)
        after = np.minimum.accumulate(np.where(reply, np.arange(n), n)[::-1])[::-1]
        at = np.minimum(after, n - 1)
        met = (after < n) & (group[at] == group) & (ms[at] <= ms + self.cap)
        until, message = np.where(met, ms[at], ms + self.cap), (rows["kind"] == "message").to_numpy()
        told, waits = message & (until < now), message & (until >= now)
        some = rows[told]
        out = pd.DataFrame({"key": _maybe(some["key"], some["no_key"]), "id": _maybe(some["id"], some["no_id"]), "asked": ms[told], "answered": _maybe(ms[at][told], ~met[told]), "timed_out": ~met[told]})
        edge = np.full(group[-1] + 1, now)  # no older message of a key can come or is open
        np.minimum.at(edge, group[waits], ms[waits])
        old = reply & (ms >= edge[group])
        due = until[waits].min() + 1 if waits.any() else ms[old].max() + 1 if old.any() else None
        return out, rows[waits | old], due


class _Stuck(_Waiting):
    """The last row of each span of ``check`` seconds is what a check sees; the same sign twice
    in a row is a restart, which starts over, as does a sight without a sign."""

    def __init__(self, check: int, forget: int):
        self.check, self.forget = check * 1000, forget * 1000

    def step(self, rows, now):
        rows, opens = _sorted(rows, ~rows["mark"].to_numpy().astype(bool))
        ms, mark = rows["ms"].to_numpy(), rows["mark"].to_numpy().astype(bool)
        span = ms // self.check
        last = np.append(opens[1:] | (span[1:] != span[:-1]), True)
        waits = ~mark & ((span + 1) * self.check > now)
        left = rows[waits]
        sights = rows[mark | (last & ~waits)].reset_index(drop=True)
        marks, out = sights[:0], None
        if len(sights):
            sights, opens = _sorted(sights)
            ms, code = sights["ms"].to_numpy(), pd.factorize(sights["kind"])[0]
            start = opens | (code < 0)
            start[1:] |= (code[1:] != code[:-1]) | (ms[1:] - ms[:-1] > self.forget)
            place = np.arange(len(ms)) - np.maximum.accumulate(np.where(start, np.arange(len(ms)), 0))
            some = sights[(place % 2 == 1) & (code >= 0)]
            out = pd.DataFrame({"key": _maybe(some["key"], some["no_key"]), "id": _maybe(some["id"], some["no_id"]), "ms": some["ms"].to_numpy(), "sign": some["kind"].to_numpy()})
            # What is remembered of a key; a sight that still waits is younger than now - check.
            marks = sights[np.append(opens[1:], True) & (place % 2 == 0) & (code >= 0) & (ms + self.forget + self.check > now)].assign(mark=True)
        dues = [((left["ms"] // self.check + 1) * self.check).min()] if len(left) else [marks["ms"].min() + self.forget + self.check] if len(marks) else []
        return out, pd.concat([marks, left], ignore_index=True), min(dues, default=None)


def _keyed(rows: DataFrame, late: str):
    """``rows(key, id, ts, kind)`` with a watermark, by bucket of keys."""
    ts, id_, zero = F.col("ts").cast("timestamp"), F.col("id").cast("long"), F.lit(0).cast("long")
    key = F.col("key").cast("long")
    made = rows.where("ts IS NOT NULL").select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), key.isNull().alias("no_key"), F.coalesce(key, zero).alias("key"), ts.alias("ts"), F.unix_millis(ts).alias("ms"), id_.isNull().alias("no_id"), F.coalesce(id_, zero).alias("id"), "kind")
    return made.withWatermark("ts", late).groupBy("bucket")


def reply_timeouts(rows: DataFrame, cap: int = CAP, late: str = "1 minute") -> DataFrame:
    """``(key, id, asked, answered, timed_out)``, one row for each message of a stream of
    ``rows(key long, id, ts, kind)`` (kind: message or reply): the first reply of its key at or
    after it within ``cap`` seconds, or none.  Times are milliseconds."""
    return _keyed(rows, late).transformWithStateInPandas(_Replies(cap), "key long, id long, asked long, answered long, timed_out boolean", "append", "eventTime")


def stuck(rows: DataFrame, check: int = CHECK, forget: int = FORGET, late: str = "10 minutes") -> DataFrame:
    """``(key, id, ms, sign)``: the sights at which a restart is due, of a stream of
    ``rows(key long, id, ts, kind)`` whose kind is the sign seen (null: nothing asks)."""
    return _keyed(rows, late).transformWithStateInPandas(_Stuck(check, forget), "key long, id long, ms long, sign string", "append", "eventTime")


def stuck_rows(rows: DataFrame, check: int = CHECK, forget: int = FORGET) -> DataFrame:
    """``stuck`` over a table: of each run of equal signs every second sight."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    seen = rows.where("ts IS NOT NULL").withColumn("ms", ms).groupBy("key", F.floor(ms / (check * 1000)).alias("span"))
    sights = seen.agg(F.max_by(F.struct("ms", "id", "kind"), F.struct("ms", F.col("id").isNull(), "id")).alias("s")).select("key", "s.*")
    by = Window.partitionBy("key").orderBy("ms")
    starts = F.coalesce((F.lag("kind").over(by) != F.col("kind")) | (F.col("ms") - F.lag("ms").over(by) > forget * 1000), F.lit(True))
    runs = sights.withColumn("run", F.sum(starts.cast("int")).over(by))
    place = F.row_number().over(Window.partitionBy("key", "run").orderBy("ms"))
    return runs.where("kind IS NOT NULL").withColumn("place", place).where("place % 2 = 0").select("key", "id", "ms", F.col("kind").alias("sign"))


@contextmanager
def _stateful(spark: SparkSession):
    """The state store that timers need, while a query starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def run_all(made: DataFrame, out: VersionedTable, checkpoint: str) -> None:
    """Run a stateful query over all that is there; each batch is one version of ``out``."""
    with _stateful(out.spark):
        query = made.writeStream.foreachBatch(lambda batch, n: out.commit(batch, "stream", n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def in_slices(rows: DataFrame, path: str, slices: int | None = None, shift: int = 300) -> None:
    """Write ``rows(key, id, ts, kind)`` as files in about the order of time, one for each of
    ``slices`` (of about ``SLICE`` rows): up to ``shift`` seconds early or late, the last one
    with a row far ahead that closes all that is open.  A slice of several files could be split
    over batches, and its rows come behind the watermark of the first."""
    spark = rows.sparkSession
    rows = rows.where("ts IS NOT NULL")
    slices = slices or max(2, -(-rows.count() // SLICE))
    at = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("id"), F.lit(shift))
    cuts = sorted(set(rows.select(at.alias("at")).approxQuantile("at", [i / slices for i in range(1, slices)], 0.1 / slices)))
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < at)) if cuts else F.lit(0)
    rows.withColumn("slice", number).write.partitionBy("slice").parquet(f"{path}-dealt")
    dealt = spark.read.schema(f"{_ddl(rows)}, slice int").parquet(f"{path}-dealt")
    for i in range(len(cuts) + 1):
        dealt.where(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)
    last = rows.agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).select(F.lit(-1).cast("long").alias("key"), F.lit(None).cast("long").alias("id"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).cast(rows.schema["ts"].dataType).alias("ts"), F.lit(None).cast("string").alias("kind"))
    last.where("ts IS NOT NULL").coalesce(1).write.mode("append").parquet(path)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def _streamed(spark: SparkSession, rows: DataFrame, make, schema: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/s-{uuid.uuid4().hex}"
    in_slices(rows, f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = VersionedTable(spark, f"{folder}/out", schema)
    run_all(make(stream), out, f"{folder}/checkpoint")
    return out.read()


def _events(spark, sf_dir, kind) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", kind.alias("kind"))


_TIMEOUTS = """WITH m AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS asked FROM events WHERE event_type IN ('view', 'click')), r AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type NOT IN ('view', 'click'))
SELECT m.user_id, m.event_id, m.asked, min(r.ms) AS answered, min(r.ms) IS NULL AS timed_out FROM m LEFT JOIN r ON r.user_id = m.user_id AND r.ms >= m.asked AND r.ms <= m.asked + 14400000 GROUP BY m.user_id, m.event_id, m.asked"""


@plan(_TIMEOUTS)
def streamed_replies(spark, sf_dir):
    """Views and clicks as messages, anything else of the user within four hours as the reply."""
    kind = F.when(F.col("event_type").isin("view", "click"), "message").otherwise("reply")
    made = _streamed(spark, _events(spark, sf_dir, kind), lambda s: reply_timeouts(s, 14_400, "10 minutes"), "key long, id long, asked long, answered long, timed_out boolean")
    return made.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "asked", "answered", "timed_out")


_SIGHTS = """WITH s AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_type <> 'view' THEN event_type END AS sign, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 300000000 ORDER BY ts DESC, event_id DESC) AS back FROM events),
seen AS (SELECT * FROM s WHERE back = 1), cut AS (SELECT *, coalesce(lag(sign) OVER w <> sign OR ms - lag(ms) OVER w > 86400000, TRUE) AS fresh FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
runs AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms) AS run FROM cut),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ms) AS place FROM runs WHERE sign IS NOT NULL)
SELECT user_id, event_id, ms, sign FROM placed WHERE place % 2 = 0"""


def _signs():
    return F.when(F.col("event_type") != "view", F.col("event_type"))


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "ms", "sign")


@plan(_SIGHTS)
def streamed_stuck(spark, sf_dir):
    """Restarts due, found by the stream; a view is a sight at which nothing asks."""
    return _renamed(_streamed(spark, _events(spark, sf_dir, _signs()), stuck, "key long, id long, ms long, sign string"))


@plan(_SIGHTS)
def stuck_sights(spark, sf_dir):
    """The same rows from the table."""
    return _renamed(stuck_rows(_events(spark, sf_dir, _signs())))
