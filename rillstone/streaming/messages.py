"""Streaming forms: routed messages and the latest state by key (timers: ``timers.py``).

Sources are checkpointed, so a restart repeats at most the last micro-batch; sinks
that overwrite by key make that effectively once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import LatestByKey


def routed(updates: DataFrame, chat: int, inline: int = 300) -> DataFrame:
    """Messages of one chat with their route; updates without a message drop out."""
    text = F.coalesce("message.text", "message.caption", F.lit(""))
    single = (F.length(text) <= inline) & ~F.contains(text, F.lit("\n"))
    return updates.where(F.col("message").isNotNull() & (F.col("message.chat.id") == chat)).select(
        "update_id", F.when(text == "", "empty").when(single, "inline").otherwise("file").alias("route"), text.alias("text"))


def windowed(events: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: counts by event-time window, closed by a watermark."""
    events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return events.groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))


def latest_state(events: DataFrame, time: str = "ts") -> DataFrame:
    """The latest event type of each user; the state is one row a key."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct(time, "event_id")).alias("state"))


def dropped(updates: DataFrame, chat: int) -> DataFrame:
    """What ``routed`` leaves out, by reason: counts beside the stream."""
    reason = F.when(F.col("message").isNull(), "no message").when(F.coalesce(F.col("message.chat.id") == chat, F.lit(False)), None).otherwise("foreign chat")
    return updates.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").count()


def quarantined(raw: DataFrame, schema: str) -> DataFrame:
    """Parsed updates and a ``bad`` column: a malformed record is set aside and the stream goes on."""
    parsed = F.from_json("value", schema)
    return raw.select(parsed.alias("update"), F.when(F.try_parse_json("value").isNull(), F.col("value")).alias("bad"))


def upsert_latest(batch: DataFrame, number: int, path: str, key: str = "user_id", order: tuple = ("ts", "event_id")) -> None:
    """A sink for ``foreachBatch``: the newest row of each key, as delta files with versions
    (see :class:`LatestByKey`); a repeated batch changes nothing.  ``latest`` reads it."""
    latest_table(batch.sparkSession, path, batch.select(key, *order, "event_type").schema, key, order).put(batch, number)


def latest_table(spark: SparkSession, path: str, schema, key: str = "user_id", order: tuple = ("ts", "event_id")) -> LatestByKey:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) if not isinstance(schema, str) else schema
    return LatestByKey(spark, path, columns, [key], list(order))


def scheduled(stream: DataFrame, sink, checkpoint: str, seconds: int | None = None):
    """Start a query that hands its batches and their numbers to ``sink``: every ``seconds``, or once over all
    that is there.  One query a checkpoint; a second one fails to start."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
