"""Queries on event windows and pairs of events, from tables and from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import scratch
from ..streaming import windows
from . import mart
from .queries import query


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Times without a zone, as DuckDB has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_SESSIONS = """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS "end", count(*) AS events FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL 3 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, number"""


@query("q67b_sessions", _SESSIONS)
def _sessions(spark, sf_dir):
    return _plain(windows.sessions(mart.table(spark, sf_dir, "events"), "3 hours"), "start", "end")


@query(
    "q67c_sliding_windows",
    """SELECT event_type, start, start + INTERVAL 2 HOUR AS "end", count(*) AS events, max(value) AS most FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * unnest(range(4))) AS start FROM events) GROUP BY ALL""",
)
def _sliding(spark, sf_dir):
    return _plain(windows.sliding(mart.table(spark, sf_dir, "events"), "2 hours", "30 minutes"), "start", "end")


_FOLLOWED = """SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 5 HOUR"""


@query("q67d_followed", _FOLLOWED)
def _followed(spark, sf_dir):
    events = mart.table(spark, sf_dir, "events")
    return windows.followed(events.where("event_type = 'view'"), events.where("event_type = 'click'"), 5 * 3600).select("user_id", "first_id", "then_id")


_EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def _stream(spark, sf_dir) -> DataFrame:
    """All events as two files of any order, a batch each, and a last one of a later time."""
    folder = f"{scratch(spark)}/in"
    events = mart.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    for n in range(2):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == n).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(-1, None, -1, "end", 0.0)], _EVENT).withColumn("ts", F.lit("2100-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(_EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


@query("q67e_sessions_of_a_stream", _SESSIONS)
def _streamed_sessions(spark, sf_dir):
    found = windows.append(windows.sessions(_stream(spark, sf_dir), "3 hours", late="400 days"), scratch(spark))
    return _plain(found, "start", "end")


@query("q67f_followed_between_streams", _FOLLOWED)
def _streamed_pairs(spark, sf_dir):
    events = _stream(spark, sf_dir)
    pairs = windows.followed(events.where("event_type = 'view'"), events.where("event_type = 'click'"), 5 * 3600, late="400 days")
    return windows.append(pairs, scratch(spark)).select("user_id", "first_id", "then_id")
