"""Streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions.scratch import Workspace
from kinloom.plans.registry import query
from kinloom.streaming import ingest


def arrived(i):
    # event time needs a time zone
    return i.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, event_type, value FROM events")
def z01_streamed_once_each(i):
    work = Workspace(i.spark, "stream")
    events = arrived(i)
    events.union(events).write.parquet(work.path("in"))
    rows = ingest.arriving(i.spark, work.path("in"), events.schema)
    ingest.drained(ingest.once_each(rows, ["event_id"], "ts", "400 days").select("event_id", "event_type", "value"), work.path("out"), work.path("state"))
    return i.spark.read.parquet(work.path("out"))


@query("WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2) SELECT CAST(day AS DATE) AS day, event_type, n, total, low, high FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def z02_streamed_windows(i):
    work = Workspace(i.spark, "stream")
    events = arrived(i)
    events.write.parquet(work.path("in"))
    rows = ingest.arriving(i.spark, work.path("in"), events.schema)
    ingest.drained(ingest.counts(rows, "ts", ["event_type"], "value"), work.path("out"), work.path("state"))
    out = i.spark.read.parquet(work.path("out"))
    return out.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total", "low", "high")
