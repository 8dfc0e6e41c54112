"""Timetable statistics: headways, histograms, spans, fleets, spacing, transfers.

Tables: departures (pattern_idx, mode, route, dep_sec), pattern_stops
(pattern_idx, stop_pos, stop_idx, offset_sec), stops (stop_idx, name, lat, lon),
trips (trip_id, route_id, dow, direction, block_id, headsign, day, mode).
Seconds count from the service day's begin and may exceed 24 hours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import bearing, flat_km
from ..functions.numbers import js_round, round_to
from ..operators.ordered import dense, first_by, gaps_of
from ..operators.spatial import range_join

H = 3600
#: km/h by mode where no times are known, and for all other modes.
SPEEDS = {"BUS": 16.0, "TRAM": 18.0, "RAIL": 40.0, "SUBWAY": 35.0, "FERRY": 15.0}
OTHER_SPEED = 16.0


def mode_order(mode: Column) -> Column:
    return F.when(mode == "TRAM", 0).when(mode == "BUS", 1).when(mode == "RAIL", 2).otherwise(3)


def name_order(name: Column) -> Column:
    """Numbers before other names; sort by this and then by the name."""
    return F.coalesce(name.try_cast("int"), F.lit(2147483647))


def sorted_routes(routes: DataFrame) -> DataFrame:
    """Routes by mode, then by number, then by name."""
    return routes.orderBy(mode_order(F.col("mode")), name_order(F.col("route")), "route")


def busiest_patterns(departures: DataFrame) -> DataFrame:
    """The pattern with the most departures of each mode and route; of equals the first."""
    n = departures.groupBy("mode", "route", "pattern_idx").agg(F.count("*").alias("n"))
    return first_by(n, ["mode", "route"], F.desc("n"), "pattern_idx")


def pattern_km(pattern_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Per pattern: stops, length from stop to stop, length as the crow flies, travel time."""
    w = W.partitionBy("pattern_idx").orderBy("stop_pos")
    at = pattern_stops.join(stops.select("stop_idx", "lat", "lon"), "stop_idx")
    leg = at.withColumn("_km", flat_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    ends = leg.groupBy("pattern_idx").agg(
        F.count("*").alias("n_stops"), F.coalesce(F.sum("_km"), F.lit(0.0)).alias("km"), F.max("offset_sec").alias("travel_sec"),
        F.min_by(F.struct("lat", "lon"), "stop_pos").alias("a"), F.max_by(F.struct("lat", "lon"), "stop_pos").alias("b"),
    )
    return ends.select("pattern_idx", "n_stops", "km", "travel_sec", flat_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("straight_km"))


def mean_headway(departures: DataFrame, by: list[str], start: int, end: int) -> DataFrame:
    """Mean minutes between departures in a closed window, for keys with two or more."""
    own = departures.where(F.col("dep_sec").between(start, end)).groupBy(*by).agg(F.count("*").alias("n"), F.min("dep_sec").alias("_lo"), F.max("dep_sec").alias("_hi"))
    return own.where("n > 1").select(*by, "n", ((F.col("_hi") - F.col("_lo")) / (F.col("n") - 1) / 60.0).alias("headway_min"))


def headway_variation(departures: DataFrame, start: int = 7 * H, end: int = 9 * H) -> DataFrame:
    """Population deviation over mean of the gaps in a closed window, on the busiest pattern of each route with three departures or more."""
    own = departures.join(busiest_patterns(departures).select("pattern_idx"), "pattern_idx", "left_semi").where(F.col("dep_sec").between(start, end))
    g = gaps_of(own, ["pattern_idx"], "dep_sec").groupBy("mode", "route").agg(F.count("*").alias("_n"), F.avg("gap").alias("_m"), F.stddev_pop("gap").alias("_s"))
    return g.where("_n >= 2 and _m >= 1").select("mode", "route", (F.col("_s") / F.col("_m")).alias("cv"))


def route_stats(departures: DataFrame, pattern_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Per mode and route: longest length, most stops, longest time, departures and window of the busiest pattern, patterns, speed."""
    by_pattern = departures.groupBy("mode", "route", "pattern_idx").agg(F.count("*").alias("n"), F.min("dep_sec").alias("first"), F.max("dep_sec").alias("last")).join(pattern_km(pattern_stops, stops), "pattern_idx")
    own = by_pattern.groupBy("mode", "route").agg(
        F.max("km").alias("_km"), F.max("n_stops").alias("stops"), F.max("travel_sec").alias("travel_sec"), F.count("*").alias("patterns"),
        F.max_by(F.struct("n", "first", "last"), F.struct("n", (-F.col("pattern_idx")).alias("o"))).alias("b"),
    )
    speed = F.when(F.col("travel_sec") > 0, round_to(F.col("_km") / (F.col("travel_sec") / 3600.0), 1))
    return own.select("mode", "route", round_to(F.col("_km"), 2).alias("km"), "stops", "travel_sec", "patterns", F.col("b.n").alias("departures"), F.col("b.first").alias("first_sec"), F.col("b.last").alias("last_sec"), speed.alias("speed_kmh"))


def counts_by_mode(stats: DataFrame) -> DataFrame:
    """Routes and departures by mode and in total."""
    return stats.agg(F.count("*").alias("routes"), *[F.sum((F.col("mode") == m).cast("int")).alias(m.lower()) for m in ("TRAM", "BUS", "RAIL")], F.sum("departures").alias("departures"))


def hourly(departures: DataFrame, days: int = 1) -> DataFrame:
    """Departures of each route in 24 hours (later ones in the last), divided by days, halves up."""
    hour = F.least(F.floor(F.col("dep_sec") / H), F.lit(23)).cast("int")
    n = departures.groupBy("mode", "route", hour.alias("hour")).agg(F.count("*").alias("n"))
    return dense(n, ["mode", "route"], "hour", 24, ["n"]).withColumn("n", F.floor(F.col("n") / float(days) + 0.5).cast("long"))


def peak_to_base(hours: DataFrame) -> DataFrame:
    """The greater of hours 7 and 8 against the mean of 10 to 14, where that is above a half."""
    own = hours.groupBy("mode", "route").agg(F.max(F.when(F.col("hour").isin(7, 8), F.col("n"))).alias("peak"), F.avg(F.when(F.col("hour").between(10, 14), F.col("n"))).alias("_base"))
    return own.where("_base > 0.5").select("mode", "route", "peak", round_to(F.col("_base"), 1).alias("base"), round_to(F.col("peak") / F.col("_base"), 2).alias("ratio"))


def vehicle_km(departures: DataFrame, lengths: DataFrame, days: int = 1) -> DataFrame:
    """Departures times length per mode; unknown modes count as buses."""
    mode = F.when(F.col("mode").isin("TRAM", "RAIL"), F.col("mode")).otherwise("BUS")
    n = departures.groupBy(mode.alias("mode"), "pattern_idx").agg(F.count("*").alias("n"))
    return n.join(lengths, "pattern_idx").groupBy("mode").agg(F.sum(F.col("n") / float(days) * F.col("km")).alias("vehicle_km"))


def tortuosity(departures: DataFrame, lengths: DataFrame) -> DataFrame:
    """Length over straight distance of each route's longest pattern, where the distance is 100 m or more."""
    own = departures.select("mode", "route", "pattern_idx").distinct().join(lengths, "pattern_idx")
    longest = first_by(own, ["mode", "route"], F.desc("km"), "pattern_idx")
    return longest.where("straight_km >= 0.1").select("mode", "route", round_to(F.col("km") / F.col("straight_km"), 2).alias("tortuosity"))


def stop_spacing(departures: DataFrame, pattern_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Mean, least and greatest metres between stops of each route's longest pattern, their variation and the number of stops."""
    lengths = pattern_km(pattern_stops, stops)
    own = departures.select("mode", "route", "pattern_idx").distinct().join(lengths, "pattern_idx")
    longest = first_by(own, ["mode", "route"], F.desc("km"), "pattern_idx").select("mode", "route", "pattern_idx", "n_stops")
    w = W.partitionBy("pattern_idx").orderBy("stop_pos")
    at = pattern_stops.join(stops.select("stop_idx", "lat", "lon"), "stop_idx")
    legs = at.withColumn("m", flat_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) * 1000.0).where("m is not null")
    met = legs.join(longest, "pattern_idx").groupBy("mode", "route", "n_stops")
    whole = lambda c: F.round(c).cast("long")
    return met.agg(whole(F.avg("m")).alias("avg_m"), whole(F.min("m")).alias("min_m"), whole(F.max("m")).alias("max_m"), round_to(F.stddev_pop("m") / F.avg("m"), 2).alias("cv"))


def dead_ends(departures: DataFrame, pattern_stops: DataFrame) -> DataFrame:
    """Stops that one line alone serves."""
    lines = departures.select("pattern_idx", "mode", "route").distinct()
    own = pattern_stops.select("pattern_idx", "stop_idx").distinct().join(lines, "pattern_idx").select("stop_idx", "mode", "route").distinct()
    return own.groupBy("stop_idx").agg(F.count("*").alias("_n"), F.min("mode").alias("mode"), F.min("route").alias("route")).where("_n = 1").drop("_n")


def fleet(trips: DataFrame) -> DataFrame:
    """Weekday blocks: their routes, the mode of the first trip, whether they serve more than one route."""
    own = trips.where("block_id is not null and dow between 1 and 5").groupBy("block_id")
    out = own.agg(F.countDistinct("route_id").alias("routes"), F.min_by("mode", "trip_id").alias("mode"), F.array_join(F.sort_array(F.collect_set("route_id")), ",").alias("route_list"))
    return out.withColumn("interlined", F.col("routes") > 1)


def weekend_service(trips: DataFrame) -> DataFrame:
    """Trips of each route on weekdays, Saturdays and Sundays, and whether it runs on weekdays only (known if the feed has weekends)."""
    some = lambda c: F.sum(F.when(c, 1).otherwise(0))
    own = trips.groupBy("route_id").agg(some(F.col("dow").between(1, 5)).alias("weekday"), some(F.col("dow") == 6).alias("saturday"), some(F.col("dow") == 0).alias("sunday"))
    covers = trips.agg(F.coalesce(F.max(F.col("dow").isin(0, 6)), F.lit(False)).alias("_w"))  # one row
    return own.crossJoin(F.broadcast(covers)).withColumn("weekday_only", F.col("_w") & (F.col("weekday") > 0) & (F.col("saturday") + F.col("sunday") == 0)).drop("_w")


def asymmetry(trips: DataFrame) -> DataFrame:
    """Routes of four or more weekday trips both of whose directions run, one under 0.8 times as often as the other; the worst first."""
    own = trips.where("dow between 1 and 5").groupBy("route_id").agg(F.sum((F.col("direction") == 0).cast("int")).alias("out"), F.sum((F.col("direction") == 1).cast("int")).alias("back"))
    ratio = F.least("out", "back") / F.greatest("out", "back")
    return own.where((F.col("out") + F.col("back") >= 4) & (F.col("out") > 0) & (F.col("back") > 0)).withColumn("ratio", round_to(ratio, 2)).where(ratio < 0.8).orderBy("ratio", "route_id")


def service_span(departures: DataFrame, pattern_stops: DataFrame) -> DataFrame:
    """First and last time at each stop and the modes that serve it."""
    ends = departures.groupBy("pattern_idx", "mode").agg(F.min("dep_sec").alias("a"), F.max("dep_sec").alias("b"))
    own = pattern_stops.join(ends, "pattern_idx").groupBy("stop_idx")
    return own.agg(F.min(F.col("a") + F.col("offset_sec")).alias("first_sec"), F.max(F.col("b") + F.col("offset_sec")).alias("last_sec"), *[F.max(F.col("mode") == m).alias(m.lower()) for m in ("TRAM", "BUS", "RAIL")])


def span_histogram(span: DataFrame) -> DataFrame:
    """Stops by the half hour of their first (3 to 8 h) and last (19 to 26 h) time; times outside go to the edges."""
    slot = lambda c, lo, hi: F.least(F.greatest(F.floor(F.col(c) / 1800.0), F.lit(lo * 2)), F.lit(hi * 2 - 1)).cast("int")
    first = span.select(F.lit("first").alias("kind"), slot("first_sec", 3, 8).alias("half_hour"), "tram")
    last = span.select(F.lit("last").alias("kind"), slot("last_sec", 19, 26).alias("half_hour"), "tram")
    return first.unionByName(last).groupBy("kind", "half_hour").agg(F.count("*").alias("n"), F.sum(F.col("tram").cast("int")).alias("tram"))


def mode_span(departures: DataFrame) -> DataFrame:
    """Per mode: earliest departure of the morning (3 to 10 h) and latest of the evening (18 to 25 h); null without one."""
    pick = lambda lo, hi: F.when(F.col("dep_sec").between(lo * H, hi * H), F.col("dep_sec"))
    return departures.groupBy("mode").agg(F.min(pick(3, 10)).alias("morning_sec"), F.max(pick(18, 25)).alias("evening_sec"), F.countDistinct(F.when(F.col("dep_sec") < 5 * H, F.col("route"))).alias("early_routes"), F.countDistinct(F.when(F.col("dep_sec") > 24 * H, F.col("route"))).alias("late_routes"))


def night_gap(span: DataFrame) -> DataFrame:
    """Stops whose last service is before 22 and before 23 h, and their shares in percent."""
    dark = lambda h: F.sum((F.col("last_sec") < h * H).cast("int"))
    return span.agg(F.count("*").alias("stops"), dark(22).alias("dark_22"), dark(23).alias("dark_23"), round_to(dark(22) / F.count("*") * 100.0, 1).alias("pct_22"), round_to(dark(23) / F.count("*") * 100.0, 1).alias("pct_23"))


def district_headway(departures: DataFrame, pattern_stops: DataFrame, stops: DataFrame, area: str = "kvart", around: int = 8 * H, reach: int = 1800) -> DataFrame:
    """Median over an area's stops and patterns of the mean gap near a time of day, in minutes; a pattern's first visit to a stop counts."""
    first = first_by(pattern_stops, ["pattern_idx", "stop_idx"], "stop_pos").select("pattern_idx", "stop_idx", "offset_sec")
    at = departures.join(first, "pattern_idx").withColumn("t", F.col("dep_sec") + F.col("offset_sec")).where(F.col("t").between(around - reach, around + reach))
    own = at.groupBy("stop_idx", "pattern_idx").agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) / (F.count("*") - 1)).alias("gap")).where("n >= 2")
    return own.join(stops.select("stop_idx", area), "stop_idx").groupBy(area).agg(js_round(F.percentile("gap", 0.5) / 60.0).cast("long").alias("headway_min"), F.count("*").alias("samples"))


def median_offsets(stop_times: DataFrame) -> DataFrame:
    """Median seconds from the first stop per pattern and position; positions without times go on from the last one at the mode's speed.

    stop_times has pattern_idx, stop_pos, mode, leg_km and offset_sec (null where unknown).
    """
    own = stop_times.groupBy("pattern_idx", "stop_pos").agg(F.percentile(F.when(F.col("offset_sec") >= 0, F.col("offset_sec")), 0.5).alias("m"), F.max("leg_km").alias("km"), F.max("mode").alias("mode"))
    speed = F.lit(OTHER_SPEED)
    for mode, kmh in SPEEDS.items():
        speed = F.when(F.col("mode") == mode, kmh).otherwise(speed)
    w = W.partitionBy("pattern_idx").orderBy("stop_pos")
    run = own.withColumn("s", F.col("km") / speed * 3600.0).withColumn("g", F.count("m").over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy("pattern_idx", "g").orderBy("stop_pos").rowsBetween(W.unboundedPreceding, 0)
    base = F.coalesce(F.last("m", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    return run.select("pattern_idx", "stop_pos", (base + F.sum(F.when(F.col("m").isNull(), F.col("s")).otherwise(0.0)).over(inside)).alias("offset_sec"))


def gap_range(departures: DataFrame, by: list[str], start: int, end: int) -> DataFrame:
    """Quartiles of the gaps of a closed window in whole minutes, 1 at least, for keys of three departures or more."""
    g = gaps_of(departures.where(F.col("dep_sec").between(start, end)), by, "dep_sec").groupBy(*by).agg(F.count("*").alias("_n"), F.percentile("gap", [0.25, 0.75]).alias("q")).where("_n >= 2")
    lo = F.greatest(F.round(F.col("q")[0] / 60.0), F.lit(1.0))
    return g.select(*by, lo.cast("long").alias("lo"), F.greatest(F.round(F.col("q")[1] / 60.0), lo).cast("long").alias("hi"))


def peak_range(departures: DataFrame, by: list[str], start: int = 6 * H + 1800, end: int = 9 * H + 1800) -> DataFrame:
    """The gaps at the 20th and 80th percentile by floor index, in minutes, for keys of four departures or more."""
    g = gaps_of(departures.where(F.col("dep_sec").between(start, end)), by, "dep_sec")
    w = W.partitionBy(*by)
    placed = g.withColumn("_i", F.row_number().over(w.orderBy("gap")) - 1).withColumn("_n", F.count("*").over(w)).where("_n >= 3")
    at = lambda share: F.max(F.when(F.col("_i") == F.floor(F.col("_n") * F.lit(share)), F.col("gap")))
    return placed.groupBy(*by).agg((at(0.2) / 60.0).alias("lo"), (at(0.8) / 60.0).alias("hi"))


def dominant_patterns(trips: DataFrame) -> DataFrame:
    """The headsign of each route and direction with the most weekday trips, then trips; of equals the last by name."""
    n = trips.groupBy("route_id", "direction", "headsign").agg(F.sum(F.when(F.col("dow").between(1, 5), 1).otherwise(0)).alias("weekday"), F.count("*").alias("trips"))
    return first_by(n, ["route_id", "direction"], F.desc("weekday"), F.desc("trips"), F.desc("headsign"))


def night_lines(departures: DataFrame) -> DataFrame:
    """Whether a line has more departures at night (before 4, from 23 h) than by day."""
    hour = F.floor(F.col("dep_sec") / H) % 24
    night = F.sum(((hour < 4) | (hour >= 23)).cast("int"))
    return departures.groupBy("mode", "route").agg(night.alias("night"), (F.count("*") - night).alias("day")).withColumn("is_night", F.col("night") > F.col("day"))


def terminal_departures(departures: DataFrame, pattern_stops: DataFrame, stops: DataFrame, km: float = 0.15) -> DataFrame:
    """Departures of each route from near its busiest pattern's first stop, all variants together."""
    start = first_by(pattern_stops, ["pattern_idx"], "stop_pos").join(stops.select("stop_idx", "lat", "lon"), "stop_idx")
    main = busiest_patterns(departures).join(start.select("pattern_idx", F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "pattern_idx").select("mode", "route", "lat0", "lon0")
    near = departures.join(start.select("pattern_idx", "lat", "lon"), "pattern_idx").join(main, ["mode", "route"]).where(flat_km(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")) <= km)
    return near.select("mode", "route", "dep_sec")


def timetable_rows(departures: DataFrame, by: list[str]) -> DataFrame:
    """Minutes of each hour (24 and on after midnight), sorted and comma-joined."""
    own = departures.select(*by, F.floor(F.col("dep_sec") / H).cast("int").alias("hour"), F.floor(F.col("dep_sec") % H / 60).cast("int").alias("m"))
    return own.groupBy(*by, "hour").agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x.cast("string")), ",").alias("minutes"))


def folded_hours(departures: DataFrame, by: list[str]) -> DataFrame:
    """Departures by hour of the clock (25 h is 1 h)."""
    return departures.groupBy(*by, (F.floor(F.col("dep_sec") / H) % 24).cast("int").alias("hour")).agg(F.count("*").alias("n"))


def hub_lines(departures: DataFrame, pattern_stops: DataFrame, stops: DataFrame, km: float = 0.15) -> DataFrame:
    """For each line and stop, how many other lines have a stop within km."""
    lines = departures.select("pattern_idx", "route").distinct()
    at = pattern_stops.join(lines, "pattern_idx").select("route", "stop_idx").distinct().join(stops.select("stop_idx", "lat", "lon"), "stop_idx")
    met = range_join(at, at, km).where(F.col("route") != F.col("r_route"))
    return met.groupBy("route", "stop_idx").agg(F.countDistinct("r_route").alias("others"))


def shared_terminals(departures: DataFrame, pattern_stops: DataFrame, stops: DataFrame, km: float = 0.2) -> DataFrame:
    """Pairs of lines whose first stops lie within km, once for each pair of lines."""
    first = first_by(pattern_stops, ["pattern_idx"], "stop_pos").select("pattern_idx", "stop_idx")
    at = departures.select("pattern_idx", "route").distinct().join(first, "pattern_idx").select("route", "stop_idx").distinct().join(stops.select("stop_idx", "lat", "lon"), "stop_idx")
    met = range_join(at, at, km).where(F.col("route") < F.col("r_route"))
    return met.groupBy("route", F.col("r_route").alias("other")).agg(F.min("dist_km").alias("dist_km"))


def transfer_waits(departures: DataFrame, pattern_stops: DataFrame, hours: tuple[int, int] = (5, 23)) -> DataFrame:
    """Per stop, hour and pair of routes: mean wait of each arrival of the one for the next departure of the other (0 if at once), both ways.

    A stop and hour is one row of its routes' times, counted first: at most one entry
    for each route and second, however many departures there are.
    """
    first = first_by(pattern_stops, ["pattern_idx", "stop_idx"], "stop_pos").select("pattern_idx", "stop_idx", "offset_sec")
    served = first.join(departures.where("route is not null").select("pattern_idx", "route").distinct(), "pattern_idx")
    shared = served.groupBy("stop_idx").agg(F.countDistinct("route").alias("routes")).where("routes > 1")  # other stops have no pairs
    at = departures.join(first.join(shared, "stop_idx", "left_semi"), "pattern_idx").select("stop_idx", "route", (F.col("dep_sec") + F.col("offset_sec")).cast("long").alias("t"))
    at = at.withColumn("hour", F.floor(F.col("t") / H).cast("int")).where(F.col("hour").between(*hours) & F.col("route").isNotNull())
    counted = at.groupBy("stop_idx", "hour", "route", "t").agg(F.count("*").alias("n"))
    hubs = counted.groupBy("stop_idx", "hour").agg(F.collect_list("route").alias("route"), F.collect_list("t").alias("t"), F.collect_list("n").alias("n"))

    def waits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, t, n = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("route", "t", "n"))
                order = np.lexsort((t, names.astype(str)))
                names, t, n = names[order], t[order], n[order]
                cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
                lines = [(names[lo], t[lo:hi], n[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
                found = []
                for a, one in enumerate(lines):
                    for two in lines[a + 1 :]:
                        total = count = 0
                        for (_, come, many), (_, leave, _) in ((one, two), (two, one)):
                            nxt = np.searchsorted(leave, come)
                            ok = nxt < len(leave)
                            total += int((many[ok] * (leave[nxt[ok]] - come[ok])).sum())
                            count += int(many[ok].sum())
                        if count:
                            found.append((one[0], two[0], total / count, count))
                if found:
                    own = [pa.array([batch.column(c)[i].as_py()] * len(found), batch.schema.field(c).type) for c in ("stop_idx", "hour")]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, zip(*found))], names=["stop_idx", "hour", "route", "other", "wait_sec", "n"])

    return hubs.where(F.size("t") > 1).mapInArrow(waits, f"stop_idx {dict(at.dtypes)['stop_idx']}, hour int, route string, other string, wait_sec double, n long")


def pulse_hubs(waits: DataFrame, limit: int = 20, least_routes: int = 3) -> DataFrame:
    """Stops of three or more routes by number of routes and mean wait."""
    routes = waits.select("stop_idx", "route").unionByName(waits.select("stop_idx", F.col("other").alias("route"))).distinct().groupBy("stop_idx").agg(F.count("*").alias("routes"))
    mean = waits.groupBy("stop_idx").agg(F.avg("wait_sec").alias("wait_sec"))
    return routes.where(F.col("routes") >= least_routes).join(mean, "stop_idx").orderBy(F.desc("routes"), "wait_sec", "stop_idx").limit(limit)


def outbound_directions(pattern_stops: DataFrame, stops: DataFrame, apart: float = 45.0) -> DataFrame:
    """Per stop: how many groups its departures' bearings form, by gaps of over 45 degrees on the circle; 1 at least."""
    w = W.partitionBy("pattern_idx").orderBy("stop_pos")
    at = pattern_stops.join(stops.select("stop_idx", "lat", "lon"), "stop_idx")
    to = at.withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null and (lat2 <> lat or lon2 <> lon)")
    b = to.select("stop_idx", bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("b"))
    s = W.partitionBy("stop_idx").orderBy("b")
    nxt = F.coalesce(F.lead("b").over(s), F.first("b").over(s) + 360.0)
    return b.withColumn("g", nxt - F.col("b")).groupBy("stop_idx").agg(F.greatest(F.sum((F.col("g") > apart).cast("int")), F.lit(1)).cast("long").alias("directions"))


def frequency(departures: DataFrame) -> DataFrame:
    """The line with the least mean gap between 7 and 9 h, or else over the day; the first by name of equals."""
    peak = mean_headway(departures, ["mode", "route"], 7 * H, 9 * H).select("mode", "route", F.col("headway_min").alias("peak"))
    day = mean_headway(departures, ["mode", "route"], 0, 26 * H).select("mode", "route", F.col("headway_min").alias("day"))
    return day.join(peak, ["mode", "route"], "left").withColumn("headway_min", F.coalesce("peak", "day")).orderBy("headway_min", "mode", "route").limit(1)
