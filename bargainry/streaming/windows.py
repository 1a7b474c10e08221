"""Windows over events in time, and pairs of two streams within an interval; on tables and on streams alike.

Events have user_id, event_type, ts and event_id.  On a stream, ``late`` is how far behind the
latest time an event may come and still count, and state older than that goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, events: a user's events with less than ``gap`` from one to the next; the end is a gap after the last."""
    grouped = _timed(events, late).where("user_id is not null").groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select("user_id", "w.start", "w.end", "events")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """event_type, start, end, events, value: each event counts in all windows of ``width`` that begin every ``step`` and hold it."""
    grouped = _timed(events, late).groupBy("event_type", F.window("ts", width, step).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("most")).select("event_type", "w.start", "w.end", "events", "most")


def followed(first: DataFrame, then: DataFrame, within_s: int = 3600, late: str = "1 hour") -> DataFrame:
    """user_id, first_id, then_id, first_ts, then_ts: events of ``then`` up to ``within_s`` seconds after one of ``first`` by the same user.

    Both ends count.  Pairs meet by user and stretch of time, so that a user with very many
    events isn't held against all of their own.  Two streams keep an event as long as one may
    come that it is paired with.
    """
    stretch = lambda c: F.floor(F.unix_micros(c) / (within_s * 1_000_000))
    a = _timed(first, late).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"), stretch("ts").alias("stretch"))
    b = _timed(then, late).select(F.col("user_id").alias("then_user"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts"), F.explode(F.array(stretch("ts"), stretch("ts") - 1)).alias("then_stretch"))
    pairs = a.join(b, F.expr(f"user_id = then_user AND stretch = then_stretch AND then_ts >= first_ts AND then_ts <= first_ts + INTERVAL {within_s} SECONDS"))
    return pairs.select("user_id", "first_id", "then_id", "first_ts", "then_ts")


def append(result: DataFrame, out: str) -> DataFrame:
    """What a stream has added to ``out`` when it has read all that is there, and what ``out`` had before."""
    result.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{out}/rows")
