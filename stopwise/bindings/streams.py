"""Queries that run a stream: the table is laid down as files, the stream reads them, and its output is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..queries import query
from ..shared import shared_path
from ..streaming import realtime, tracker
from ..streaming.versions import VersionedTable
from . import Tables


def as_stream(t: Tables, df: DataFrame) -> DataFrame:
    """df as a stream of the files that it is written to."""
    path = shared_path(t.spark, "polls")
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


@query("str_01_02_current_snapshot", "SELECT event_id, ts, route_id, trip_id FROM rt_obs WHERE ts = (SELECT max(ts) FROM rt_obs)")
def _(t):
    out = shared_path(t.spark, "snapshot")
    realtime.current_snapshot(as_stream(t, t.rt_obs.select("event_id", "ts", "route_id", "trip_id")), out, shared_path(t.spark, "check")).awaitTermination()
    return VersionedTable(t.spark, out).read()


@query("str_03_minute_stream", "SELECT DISTINCT ts // 60 * 60 AS minute, route_id, trip_id, stop_sequence FROM rt_obs")
def _(t):
    out = shared_path(t.spark, "minutes")
    # one file, so that no row is later than the watermark of an earlier one
    stream = as_stream(t, t.rt_obs.select("ts", "route_id", "trip_id", "stop_sequence").coalesce(1))
    realtime.append_once(realtime.once_a_minute(stream), out, shared_path(t.spark, "check")).awaitTermination()
    return t.spark.read.parquet(out).select("minute", "route_id", "trip_id", "stop_sequence")


def _tracked(t: Tables, name: str) -> DataFrame:
    out = shared_path(t.spark, "tracker")
    polls = t.bike_polls.select(F.col("poll_ts").cast("long").alias("poll_ts"), F.col("bike_id").cast("string").alias("bike_id"), "station_id")
    stations = polls.select("station_id").distinct()
    tracker.track(as_stream(t, polls), out, shared_path(t.spark, "check"), stations).awaitTermination()
    return tracker.tracked(t.spark, out, name)


@query("str_06_08_tracked_minutes")
def _(t):
    counts = ["starts", "returns", "bulk_out", "bulk_in", "docked", "stations", "gap_sec"]
    return _tracked(t, "minutes").groupBy("ts").agg(*[F.sum(c).alias(c) for c in counts])


@query("str_07_09_tracked_hours")
def _(t):
    return tracker.hour_totals(_tracked(t, "stations"))
