"""Bike share: flows between docks from polls, hourly totals, rankings, relocations, balance.

Polls have one row for each docked bike: (poll_ord, poll_ts, bike_id,
station_id).  A bike that is missing is a row that is not there, so runs of
presence come from the distance of a bike's sightings in numbers of polls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import floor_to, round_to

#: Missing polls that make a start, seconds of a ride, starts of one station and poll that are bulk, hours in flight, minutes of a usable hour and of a whole day, usable seconds between polls.
MISSING_POLLS = 2
LEAST_RIDE = 120
BULK = 4
MOST_FLIGHT = 6 * 3600
HOUR_MINUTES = 50
DAY_MINUTES = 1400
MOST_GAP = 180


def movements(polls: DataFrame) -> DataFrame:
    """Departures and arrivals: kind, ts, ord, bike_id, station_id, and for arrivals the departure's station and time.

    A bike that is missing for one poll and back at its dock has flickered; one
    back at its dock later is no ride either (its start is retracted).  A bike
    seen at another dock counts as a ride if two polls missed it, or if the time
    between the sightings is that of a ride.  After six hours it is forgotten.
    """
    clock = polls.select("poll_ord", "poll_ts").distinct()
    by_bike = W.partitionBy("bike_id").orderBy("poll_ord")
    seen = polls.select("*", *[F.lead(c).over(by_bike).alias(f"next_{c}") for c in ("poll_ord", "poll_ts", "station_id")])
    last = polls.agg(F.max("poll_ord").alias("end_ord"))
    # one row, the number of the last poll
    seen = seen.crossJoin(F.broadcast(last))
    missing = F.coalesce(F.col("next_poll_ord"), F.col("end_ord") + 1) - F.col("poll_ord") - 1
    away = F.col("next_station_id") != F.col("station_id")
    took = F.col("next_poll_ts") - F.col("poll_ts")
    ride = away & (took >= LEAST_RIDE) & (took <= MOST_FLIGHT)
    left = seen.where((missing >= MISSING_POLLS) | ride).withColumn("ord", F.col("poll_ord") + F.least(F.lit(MISSING_POLLS), F.greatest(missing, F.lit(1))))
    starts = left.join(clock.select(F.col("poll_ord").alias("ord"), F.col("poll_ts").alias("ts")), "ord")
    starts = starts.where(~F.coalesce(F.col("next_station_id") == F.col("station_id"), F.lit(False)) | (took > MOST_FLIGHT))
    out = starts.select(F.lit("start").alias("kind"), "ts", "ord", "bike_id", "station_id", F.lit(None).cast("string").alias("from_station"), F.lit(None).cast("long").alias("departed_ts"))
    ends = seen.where(ride).select(F.lit("return").alias("kind"), F.col("next_poll_ts").alias("ts"), F.col("next_poll_ord").alias("ord"), "bike_id", F.col("next_station_id").alias("station_id"), F.col("station_id").alias("from_station"), F.col("poll_ts").alias("departed_ts"))
    return out.unionByName(ends)


def with_bulk(moves: DataFrame) -> DataFrame:
    """kind becomes bulk_out or bulk_in where a station has four or more of a kind in one poll."""
    n = F.count("*").over(W.partitionBy("kind", "ord", "station_id"))
    return moves.withColumn("kind", F.when(n < BULK, F.col("kind")).when(F.col("kind") == "start", "bulk_out").otherwise("bulk_in"))


def rides(moves: DataFrame) -> DataFrame:
    """Rides from the arrivals: departed_ts, arrived_ts, from_station, to_station."""
    return moves.where("kind = 'return'").select("departed_ts", F.col("ts").alias("arrived_ts"), "from_station", F.col("station_id").alias("to_station"))


def minute_flow(polls: DataFrame, moves: DataFrame) -> DataFrame:
    """Per poll: starts, returns, bulk moves, docked bikes, stations and the seconds since the poll before."""
    base = polls.groupBy("poll_ord", "poll_ts").agg(F.count("*").alias("docked"), F.countDistinct("station_id").alias("stations"))
    some = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k)
    counts = moves.groupBy(F.col("ord").alias("poll_ord")).agg(*[some(k) for k in ("start", "return", "bulk_out", "bulk_in")])
    # the minutes of one system are one short series
    before = base.select((F.col("poll_ord") + 1).alias("poll_ord"), F.col("poll_ts").alias("_before"))
    met = base.join(before, "poll_ord", "left").join(counts, "poll_ord", "left").fillna(0, subset=["start", "return", "bulk_out", "bulk_in"])
    return met.select(F.col("poll_ts").alias("ts"), F.col("start").alias("starts"), F.col("return").alias("returns"), "bulk_out", "bulk_in", "docked", "stations", F.coalesce(F.col("poll_ts") - F.col("_before"), F.lit(0)).alias("gap_sec"))


def merged_flow(parts: DataFrame) -> DataFrame:
    """Deltas of the same minute added up: counters by sum, docked and stations from the last delta (ingest_seq), the greatest gap."""
    own = parts.groupBy("ts").agg(*[F.sum(c).alias(c) for c in ("starts", "returns", "bulk_out", "bulk_in")], F.max_by("docked", "ingest_seq").alias("docked"), F.max_by("stations", "ingest_seq").alias("stations"), F.max("gap_sec").alias("gap_sec"))
    # retractions are negative deltas; a counter is never read below 0
    return own.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("starts", "returns", "bulk_out", "bulk_in")})


def station_hours(polls: DataFrame, moves: DataFrame) -> DataFrame:
    """Per hour and station: moves, sum, least and greatest bikes, samples without a bike, samples; stations known in an hour count when empty."""
    clock = polls.select("poll_ord", "poll_ts", floor_to(F.col("poll_ts"), 3600).alias("hour_ts")).distinct()
    known = polls.select(floor_to(F.col("poll_ts"), 3600).alias("hour_ts"), "station_id").distinct()
    bikes = polls.groupBy("poll_ord", "station_id").agg(F.count("*").alias("bikes"))
    every = clock.join(known, "hour_ts").join(bikes, ["poll_ord", "station_id"], "left").fillna(0, subset=["bikes"])
    hours = every.groupBy("hour_ts", "station_id").agg(F.sum("bikes").alias("sum_bikes"), F.min("bikes").alias("min_bikes"), F.max("bikes").alias("max_bikes"), F.sum((F.col("bikes") == 0).cast("int")).alias("empty_samples"), F.count("*").alias("samples"))
    some = lambda k, name: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(name)
    counts = moves.groupBy(floor_to(F.col("ts"), 3600).alias("hour_ts"), "station_id").agg(some("start", "starts"), some("return", "returns"), some("bulk_out", "bulk_out"), some("bulk_in", "bulk_in"))
    return hours.join(counts, ["hour_ts", "station_id"], "left").fillna(0, subset=["starts", "returns", "bulk_out", "bulk_in"])


def hourly_totals(flow: DataFrame, most_gap: int = MOST_GAP) -> DataFrame:
    """Per hour over minutes with a usable gap: moves, mean, least and greatest docked, minutes, worst gap."""
    own = flow.where(F.col("gap_sec") <= most_gap).groupBy(floor_to(F.col("ts"), 3600).alias("hour_ts"))
    return own.agg(F.sum("starts").alias("starts"), F.sum("returns").alias("returns"), F.sum("bulk_out").alias("bulk_out"), F.sum("bulk_in").alias("bulk_in"), F.avg("docked").alias("avg_docked"), F.min("docked").alias("min_docked"), F.max("docked").alias("max_docked"), F.count("*").alias("minutes"), F.max("gap_sec").alias("worst_gap_sec"))


def station_ranking(hours: DataFrame, stations: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Per station with samples: moves, mean bikes, share of empty samples, starts a day; most starts first."""
    own = hours.groupBy("station_id").agg(F.sum("starts").alias("starts"), F.sum("returns").alias("returns"), F.sum("sum_bikes").alias("_bikes"), F.sum("empty_samples").alias("_empty"), F.sum("samples").alias("samples")).where("samples > 0")
    out = own.select("station_id", "starts", "returns", (F.col("_bikes") / F.col("samples")).alias("avg_bikes"), (F.col("_empty") / F.col("samples")).alias("empty_share"), "samples", (F.col("starts") / (F.col("samples") / 1440.0)).alias("starts_per_day"))
    if stations is not None:
        out = out.join(stations.select("station_id", "name", "capacity"), "station_id")
    out = out.orderBy(F.desc("starts"), "station_id")
    return out if limit is None else out.limit(max(1, min(limit, 500)))


def local_hours(hours: DataFrame, zone: str = "Europe/Zagreb") -> DataFrame:
    """hours with the local date and hour of hour_ts."""
    local = F.from_utc_timestamp(F.timestamp_seconds("hour_ts"), zone)
    return hours.withColumn("date", F.date_format(local, "yyyy-MM-dd")).withColumn("hour", F.hour(local))


def daily_rides(totals: DataFrame) -> DataFrame:
    """Per local day: moves, observed minutes."""
    return local_hours(totals).groupBy("date").agg(F.sum("starts").alias("starts"), F.sum("returns").alias("returns"), F.sum("minutes").alias("minutes"), F.max("worst_gap_sec").alias("worst_gap_sec"))


def hour_profile(totals: DataFrame) -> DataFrame:
    """Per local hour over hours that are observed well: mean starts and returns, days."""
    return local_hours(totals.where(F.col("minutes") >= HOUR_MINUTES)).groupBy("hour").agg(F.avg("starts").alias("avg_starts"), F.avg("returns").alias("avg_returns"), F.count("*").alias("days"))


def without_relocations(totals: DataFrame, moved: DataFrame) -> DataFrame:
    """Starts and returns less the moves of the operator (hour_ts, moves), never below 0, and how many starts that took away."""
    own = moved.groupBy("hour_ts").agg(F.sum("moves").alias("_m"))
    met = totals.join(own, "hour_ts", "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    less = lambda c: F.greatest(F.col(c) - F.col("_m"), F.lit(0)).alias(c)
    return met.select("hour_ts", less("starts"), less("returns"), F.least(F.col("starts"), F.col("_m")).alias("removed"), F.col("_m").alias("relocations"), "minutes")


def rides_summary(days: DataFrame, profile: DataFrame) -> DataFrame:
    """Whole days, their mean starts, the busiest day; the peak hour and that before noon (the earliest of equals)."""
    whole = days.where(F.col("minutes") >= DAY_MINUTES).agg(F.count("*").alias("days"), F.avg("starts").alias("avg_starts"), F.min(F.struct((-F.col("starts")).alias("s"), "date")).alias("b"))
    hours = profile.agg(F.min(F.struct((-F.col("avg_starts")).alias("s"), "hour")).alias("p"), F.min(F.when(F.col("hour") < 12, F.struct((-F.col("avg_starts")).alias("s"), "hour"))).alias("m"))
    # both sides are one row
    return whole.crossJoin(hours).select("days", "avg_starts", F.col("b.date").alias("busiest_date"), F.col("p.hour").alias("peak_hour"), F.col("m.hour").alias("morning_peak_hour"))


def station_flow(hours: DataFrame) -> DataFrame:
    """Per station and local hour (from hours observed well): moves and days."""
    own = local_hours(hours.where(F.col("samples") >= HOUR_MINUTES))
    return own.groupBy("station_id", "hour").agg(F.sum("starts").alias("starts"), F.sum("returns").alias("returns"), F.sum("bulk_out").alias("bulk_out"), F.sum("bulk_in").alias("bulk_in"), F.countDistinct("date").alias("days"))


def corridors(trips: DataFrame, limit: int = 10) -> DataFrame:
    """The most ridden pairs of stations with the mean whole minutes of a ride."""
    minutes = F.floor((F.col("arrived_ts") - F.col("departed_ts")) / 60)
    own = trips.groupBy("from_station", "to_station").agg(F.count("*").alias("trips"), F.avg(minutes).alias("avg_minutes"))
    return own.orderBy(F.desc("trips"), "from_station", "to_station").limit(limit)


def utilisation(stations: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Active stations, capacity, bikes, empty and full stations, share of capacity in percent."""
    active = stations.where("is_installed and is_renting").withColumn("_c", F.coalesce("capacity", F.col("num_bikes") + F.col("num_docks")))
    out = active.agg(F.count("*").alias("active"), F.sum("_c").alias("capacity"), F.sum("num_bikes").alias("bikes"), F.sum((F.col("num_bikes") == 0).cast("int")).alias("empty"), F.sum((F.col("num_docks") == 0).cast("int")).alias("full"))
    return out.withColumn("pct", round_to(F.when(F.col("capacity") > 0, F.col("bikes") / F.col("capacity") * 100.0), 1))


def balance(stations: DataFrame, ranking: DataFrame, limit: int = 5) -> DataFrame:
    """Stations with more bikes than places (surplus) and those most often empty (shortage); temporary ones are left out."""
    lasting = ~F.lower("name").contains("temporary")
    over = stations.where(lasting & (F.col("num_bikes") > F.col("capacity"))).select(F.lit("surplus").alias("kind"), "station_id", (F.col("num_bikes") - F.col("capacity")).cast("double").alias("value"))
    short = ranking.where(F.col("empty_share") > 0).select(F.lit("shortage").alias("kind"), "station_id", F.col("empty_share").alias("value"))
    top = lambda df: df.orderBy(F.desc("value"), "station_id").limit(limit)
    return top(over).unionByName(top(short))


def area_terrain(placed: DataFrame, value: str) -> DataFrame:
    """Sum of a value per area, its share of all areas and its percentage of the greatest; placed rows have area."""
    own = placed.where("area is not null").groupBy("area").agg(F.sum(value).alias("rate"))
    whole = W.partitionBy()  # a row for each area
    return own.select("area", "rate", (F.col("rate") / F.sum("rate").over(whole)).alias("share"), (F.col("rate") / F.max("rate").over(whole) * 100.0).alias("height"))


def commute_flow(flow: DataFrame, placed: DataFrame) -> DataFrame:
    """Per area: net riders a day in the morning (7 to 9) and evening (16 to 18), and whether the direction turns (3 or more both ways)."""
    net = (F.col("returns") - F.col("bulk_in")) - (F.col("starts") - F.col("bulk_out"))
    own = flow.join(placed.select("station_id", "area"), "station_id").where("area is not null and days > 0").withColumn("_net", net / F.col("days"))
    some = lambda lo, hi: F.sum(F.when(F.col("hour").between(lo, hi), F.col("_net")).otherwise(0.0))
    out = own.groupBy("area").agg(some(7, 9).alias("morning"), some(16, 18).alias("evening"))
    return out.withColumn("turns", (F.col("morning") * F.col("evening") < 0) & (F.abs("morning") >= 3) & (F.abs("evening") >= 3))


def dock_table(info: DataFrame, status: DataFrame) -> DataFrame:
    """Station information met with status; virtual stations are left out, a missing capacity is bikes and docks."""
    own = info.where(~F.coalesce(F.col("is_virtual"), F.lit(False)))
    return own.join(status, "station_id").withColumn("capacity", F.coalesce("capacity", F.col("num_bikes") + F.col("num_docks")))


def in_use(usage: DataFrame) -> DataFrame:
    """Bikes in use: the greatest number available within 24 hours less that of now, never below 0."""
    w = W.orderBy("ts").rangeBetween(-86400, 0)
    return usage.withColumn("in_use", F.greatest(F.max("available").over(w) - F.col("available"), F.lit(0)))
