"""Bike tracker: rides, bulk moves and docks from a stream of polls, with the state of each bike between batches.

A bike that one poll misses is pending; if the next poll misses it too, a start
counts, at that poll.  Back at its dock after one missing poll it has flickered;
at another dock it made a short ride.  Back at its dock later, its start is taken
back: a delta of -1 at the time when it was counted, which may be an hour that is
long written.  A bike that moves between two polls in a row made a ride if they
are two minutes apart.  A bike that is new, or was away for more than six hours,
only returns.  The first poll of all sets the docks and counts nothing.

Absence is the signal, so a bike's state is its last sighting and the times of
the polls since; both are a table that each batch reads and replaces as a whole.
A batch writes the polls that are new to it, once, to places numbered by batch: a
batch that is repeated after a failure writes the same rows to the same places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from ..functions.numbers import floor_to
from ..plans.bikes import BULK, LEAST_RIDE, MISSING_POLLS, MOST_FLIGHT
from ..shared import written
from .versions import VersionedTable

STATE = "seq long, poll_ts long, bike_id string, station_id string"
_KINDS = ("start", "return", "bulk_out", "bulk_in")


def advance(state: DataFrame, polls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, clock, next state) of new polls (poll_ts, bike_id, station_id) on a state of STATE.

    State rows without a bike are the polls of the last six hours; polls that are
    not later than all of them are left out.  Events: kind, seq, ts, bike_id,
    station_id, and from_station and departed_ts of returns that end a known ride;
    kind "retraction" has the time at which the start was counted.
    """
    old_clock = state.where("bike_id is null").select("seq", "poll_ts")
    last = old_clock.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"), F.max("poll_ts").alias("last_ts"))  # one row
    new = polls.crossJoin(F.broadcast(last)).where(F.col("last_ts").isNull() | (F.col("poll_ts") > F.col("last_ts")))
    # a row for each poll of the batch
    times = new.select("poll_ts", "last_seq").distinct()
    times = times.select((F.col("last_seq") + F.row_number().over(W.orderBy("poll_ts"))).alias("seq"), "poll_ts")
    fresh = times.withColumn("fresh", F.lit(True))
    clock = written(old_clock.withColumn("fresh", F.lit(False)).unionByName(fresh))
    end = clock.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("end_seq"), F.max("poll_ts").alias("end_ts"))  # one row
    seen = polls.select("poll_ts", F.col("bike_id").cast("string").alias("bike_id"), "station_id").dropDuplicates(["poll_ts", "bike_id"]).join(F.broadcast(clock.where("fresh").select("seq", "poll_ts")), "poll_ts")
    known = state.where("bike_id is not null")
    by_bike = W.partitionBy("bike_id").orderBy("seq")
    all_ = written(known.select("seq", "poll_ts", "bike_id", "station_id").unionByName(seen.select("seq", "poll_ts", "bike_id", "station_id")))
    lead = {f"next_{c}": F.lead(c).over(by_bike) for c in ("seq", "poll_ts", "station_id")}
    pairs = all_.withColumns(lead).withColumn("first", F.row_number().over(by_bike) == 1).crossJoin(F.broadcast(end))
    missing = F.coalesce(F.col("next_seq"), F.col("end_seq") + 1) - F.col("seq") - 1
    pairs = pairs.withColumns({"missing": missing, "moved": F.col("next_station_id") != F.col("station_id")})
    at = lambda name, seq: clock.select(F.col("seq").alias(seq), F.col("poll_ts").alias(name))
    # the poll that counts an absence, and the last one before the bike is back
    pairs = pairs.withColumns({"count_seq": F.col("seq") + MISSING_POLLS, "before_seq": F.col("next_seq") - 1}).join(F.broadcast(at("counted_ts", "count_seq")), "count_seq", "left").join(F.broadcast(at("before_ts", "before_seq")), "before_seq", "left")
    long_ = F.col("missing") >= MISSING_POLLS
    short = F.coalesce(F.col("moved"), F.lit(False)) & F.when(F.col("missing") == 0, F.col("next_poll_ts") - F.col("poll_ts") >= LEAST_RIDE).otherwise(F.col("missing") == 1)
    alive = F.coalesce(F.col("before_ts") - F.col("poll_ts") <= MOST_FLIGHT, F.lit(False))
    back = long_ & F.col("next_seq").isNotNull()
    none = F.lit(None).cast("string"), F.lit(None).cast("long")

    def event(kind: str, when, seq, ts, station, from_station=none[0], departed=none[1]):
        return F.when(when, F.struct(F.lit(kind).alias("kind"), seq.alias("seq"), ts.alias("ts"), station.alias("station_id"), from_station.cast("string").alias("from_station"), departed.cast("long").alias("departed_ts")))

    own, there = F.col("station_id"), F.col("next_station_id")
    came = F.col("next_seq"), F.col("next_poll_ts")
    made = F.array(
        event("start", long_ & F.col("counted_ts").isNotNull(), F.col("count_seq"), F.col("counted_ts"), own),
        event("start", short, *came, own),
        event("return", short | (back & alive & F.col("moved")), *came, there, own, F.col("poll_ts")),
        event("return", back & ~alive, *came, there),
        event("retraction", back & alive & ~F.col("moved"), F.col("next_seq"), F.col("counted_ts"), own),
        event("return", F.col("first") & (F.col("seq") > 1), F.col("seq"), F.col("poll_ts"), own),
    )
    events = pairs.select("bike_id", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("bike_id", "e.*")
    events = events.join(F.broadcast(clock.where("fresh").select("seq")), "seq", "left_semi")
    rest = pairs.where(F.col("next_seq").isNull() & (F.col("end_ts") - F.col("poll_ts") <= MOST_FLIGHT)).select("seq", "poll_ts", "bike_id", "station_id")
    recent = clock.crossJoin(F.broadcast(end)).where((F.col("end_ts") - F.col("poll_ts") <= MOST_FLIGHT) | (F.col("seq") >= F.col("end_seq") - MISSING_POLLS))
    recent = recent.select("seq", "poll_ts", *[F.lit(None).cast("string").alias(c) for c in ("bike_id", "station_id")])
    return events, clock, rest.unionByName(recent)


def with_bulk(events: DataFrame) -> DataFrame:
    """Four starts or returns at a station in one poll are a bulk move."""
    n = F.count("*").over(W.partitionBy("kind", "seq", "station_id"))
    kind = F.when((n < BULK) | (F.col("kind") == "retraction"), F.col("kind")).when(F.col("kind") == "start", "bulk_out").otherwise("bulk_in")
    return events.withColumn("kind", kind)


def _moves(events: DataFrame, *by) -> DataFrame:
    some = lambda k, sign=1: F.sum(F.when(F.col("kind") == k, sign).otherwise(0))
    return events.groupBy(*by).agg((some("start") - some("retraction")).alias("starts"), some("return").alias("returns"), some("bulk_out").alias("bulk_out"), some("bulk_in").alias("bulk_in"))


def minutes(events: DataFrame, clock: DataFrame, polls: DataFrame) -> DataFrame:
    """Deltas by poll (ts): moves, docked bikes, stations with bikes, seconds since the poll before; taken-back starts are rows of their own, of the time they were counted."""
    seen = polls.dropDuplicates(["poll_ts", "bike_id"]).groupBy("poll_ts").agg(F.count("*").alias("docked"), F.countDistinct("station_id").alias("stations"))
    before = clock.select((F.col("seq") + 1).alias("seq"), F.col("poll_ts").alias("before"))
    base = clock.where("fresh").join(before, "seq").join(seen, "poll_ts").select(F.col("poll_ts").alias("ts"), "docked", "stations", (F.col("poll_ts") - F.col("before")).alias("gap_sec"))
    moves = _moves(events.where("kind <> 'retraction'"), "ts")
    own = base.join(moves, "ts", "left").fillna(0, subset=["starts", "returns", "bulk_out", "bulk_in"])
    zero = [F.lit(0).cast("long").alias(c) for c in ("docked", "stations", "gap_sec")]
    taken = _moves(events.where("kind = 'retraction'"), "ts").select("ts", *zero, "starts", "returns", "bulk_out", "bulk_in")
    return own.unionByName(taken)


def station_hours(events: DataFrame, clock: DataFrame, polls: DataFrame, stations: DataFrame) -> DataFrame:
    """Deltas by hour and station: moves, sum, least and greatest bikes, samples, samples without a bike; known stations (station_id) count when empty."""
    times = clock.where("fresh").select("poll_ts")
    every = polls.select("station_id").unionByName(stations.select("station_id")).distinct()
    held = polls.dropDuplicates(["poll_ts", "bike_id"]).groupBy("poll_ts", "station_id").agg(F.count("*").alias("bikes"))
    # polls of a batch are few; a station that is only in the polls counts from its first one on
    met = every.join(F.broadcast(times), F.lit(True)).join(held, ["poll_ts", "station_id"], "left").join(stations.select("station_id", F.lit(True).alias("listed")).distinct(), "station_id", "left")
    met = met.where("bikes is not null or listed").fillna(0, subset=["bikes"]).withColumn("hour_ts", floor_to(F.col("poll_ts"), 3600))
    docks = met.groupBy("hour_ts", "station_id").agg(F.sum("bikes").alias("sum_bikes"), F.min("bikes").alias("min_bikes"), F.max("bikes").alias("max_bikes"), F.count("*").alias("samples"), F.sum((F.col("bikes") == 0).cast("long")).alias("empty_samples"))
    moves = _moves(events, floor_to(F.col("ts"), 3600).alias("hour_ts"), "station_id")
    return docks.join(moves, ["hour_ts", "station_id"], "full_outer").fillna(0, subset=["sum_bikes", "samples", "empty_samples", "starts", "returns", "bulk_out", "bulk_in"])


def run_batch(spark: SparkSession, polls: DataFrame, batch_id: int, path: str, stations: DataFrame) -> bool:
    """Track one batch; False where it has been tracked before."""
    table = VersionedTable(spark, f"{path}/state")
    now = table.current()
    if now is not None and batch_id <= now:
        return False
    state = table.read() if now is not None else spark.createDataFrame([], STATE)
    polls = polls.select("poll_ts", F.col("bike_id").cast("string").alias("bike_id"), "station_id")
    events, clock, after = advance(state, polls)
    events = written(with_bulk(events))
    polls = polls.join(F.broadcast(clock.where("fresh").select("poll_ts")), "poll_ts", "left_semi")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    put(minutes(events, clock, polls), "minutes")
    put(station_hours(events, clock, polls, stations), "stations")
    put(events.where("departed_ts is not null").select("departed_ts", F.col("ts").alias("arrived_ts"), "from_station", F.col("station_id").alias("to_station")), "rides")
    table.stage(after, batch_id)
    table.swap(batch_id)
    return True


def track(polls: DataFrame, path: str, checkpoint: str, stations: DataFrame) -> StreamingQuery:
    """Track a stream of polls (poll_ts, bike_id, station_id) into minutes, stations and rides under path."""
    step = lambda batch, batch_id: run_batch(batch.sparkSession, batch, batch_id, path, stations)
    return polls.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tracked(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of an output that complete batches have written."""
    now = VersionedTable(spark, f"{path}/state").current()
    rows = spark.read.parquet(f"{path}/{name}")
    return rows.where(F.col("batch") <= F.lit(-1 if now is None else now))


def hour_totals(rows: DataFrame) -> DataFrame:
    """Deltas of stations added up by hour and station; a counter is never read below 0."""
    own = rows.groupBy("hour_ts", "station_id").agg(*[F.sum(c).alias(c) for c in ("starts", "returns", "bulk_out", "bulk_in", "sum_bikes", "samples", "empty_samples")], F.min("min_bikes").alias("min_bikes"), F.max("max_bikes").alias("max_bikes"))
    return own.withColumn("starts", F.greatest(F.col("starts"), F.lit(0)))
