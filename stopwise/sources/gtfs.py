"""Timetable feeds as folders of CSV files: tables by header name, service days, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ROUTE_TYPES
from ..operators.ordered import first_by

DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")

#: Columns of the feed's files that are read.
FILES = {
    "routes": "route_id string, route_short_name string, route_long_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, direction_id int, block_id string, shape_id string",
    "calendar": "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type string",
    "stop_times": "trip_id string, stop_id string, stop_sequence int, departure_time string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file by header name: other columns are ignored, missing ones null, bad values null, quotes doubled within quotes."""
    wanted = T.StructType.fromDDL(FILES[name])
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.txt")
    have = {c.strip().lstrip("﻿"): c for c in raw.columns}
    cell = lambda f: F.nullif(F.trim(F.col(f"`{have[f.name]}`")), F.lit("")).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    return raw.select(*[cell(f).alias(f.name) for f in wanted])


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """route_id, route (short, else long name) and mode; a type that is missing is a bus."""
    kind = F.coalesce("route_type", F.lit(3))
    mode = F.lit("BUS")
    for code, name in ROUTE_TYPES.items():
        mode = F.when(kind == code, name).otherwise(mode)
    return read_table(spark, folder, "routes").where("route_id is not null").select("route_id", F.coalesce("route_short_name", "route_long_name", "route_id").alias("route"), mode.alias("mode"))


def service_days(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """(service_id, dow; 0 is Sunday): from the calendar, or from added dates alone if no calendar row has a day."""
    days = F.array(*[F.struct(F.lit(i).alias("dow"), F.col(d).alias("on")) for i, d in enumerate(DAYS)])
    regular = calendar.select("service_id", F.explode(days).alias("d")).where("d.on = '1'").select("service_id", "d.dow")
    added = dates.where("coalesce(exception_type, '1') = '1'").select("service_id", (F.dayofweek(F.to_date("date", "yyyyMMdd")) - 1).alias("dow")).where("dow is not null")
    any_day = regular.agg((F.count("*") > 0).alias("_any"))  # one row
    return regular.unionByName(added.crossJoin(F.broadcast(any_day)).where("not _any").drop("_any")).distinct()


def seconds(clock: Column) -> Column:
    """Seconds of an H:MM:SS text, over 24 hours too."""
    part = F.split(clock, ":")
    return part.getItem(0).try_cast("long") * 3600 + part.getItem(1).try_cast("long") * 60 + part.getItem(2).try_cast("long")


def trips_with_routes(trips: DataFrame, routes_: DataFrame) -> DataFrame:
    """trips with route and mode; a route that is missing has its id as name and is a bus."""
    return trips.join(routes_, "route_id", "left").withColumns({"route": F.coalesce("route", "route_id"), "mode": F.coalesce("mode", F.lit("BUS"))})


def patterns(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Trips of a route and direction with the same stops, two or more, are a pattern: pattern_idx (a hash), route_id, direction_id, stops, trips, first trip."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id"))), lambda x: x["stop_id"])
    own = stop_times.groupBy("trip_id").agg(order.alias("stops"), F.min(seconds(F.col("departure_time"))).alias("start_sec")).where(F.size("stops") >= 2)
    met = trips.join(own, "trip_id").withColumn("pattern_idx", F.xxhash64("route_id", "direction_id", "stops"))
    return met.groupBy("pattern_idx").agg(F.first("route_id").alias("route_id"), F.first("direction_id").alias("direction_id"), F.first("stops").alias("stops"), F.count("*").alias("n_trips"), F.sort_array(F.collect_list("start_sec")).alias("departures"), F.min("trip_id").alias("first_trip"))


def wanted_feed(spark: SparkSession, folder: str, route_names: list[str] | None = None) -> dict[str, DataFrame]:
    """Routes, trips, stop times, shapes and stops of the named routes; big files are cut by semi joins."""
    r = routes(spark, folder)
    if route_names is not None:
        r = r.where(F.col("route").isin(route_names))
    t = read_table(spark, folder, "trips").join(r, "route_id", "left_semi")
    times = read_table(spark, folder, "stop_times").join(t, "trip_id", "left_semi")
    stops_ = read_table(spark, folder, "stops").join(times, "stop_id", "left_semi")
    return {"routes": r, "trips": t, "stop_times": times, "stops": stops_, "shapes": read_table(spark, folder, "shapes").join(t.where("shape_id is not null"), "shape_id", "left_semi")}


def united(feeds: list[DataFrame], key: str | None = None) -> DataFrame:
    """Rows of several feeds; with a key, the row of the last feed that has it."""
    out = None
    for i, f in enumerate(feeds):
        own = f.withColumn("_feed", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return (out if key is None else first_by(out, [key], F.desc("_feed"))).drop("_feed")


def near_centre(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, lat: float, lon: float, km: float = 40.0) -> DataFrame:
    """All trips of routes that touch a stop near the centre, one for each route and sequence of stops and times (the first by id)."""
    from ..functions.geometry import haversine_km

    near = stops.where(haversine_km(F.lit(lat), F.lit(lon), F.col("stop_lat"), F.col("stop_lon")) <= km)
    touching = trips.join(stop_times.join(near, "stop_id", "left_semi"), "trip_id", "left_semi").select("route_id").distinct()
    own = trips.join(touching, "route_id", "left_semi")
    sig = stop_times.groupBy("trip_id").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id", "departure_time")))).alias("_sig"))
    return first_by(own.join(sig, "trip_id"), ["route_id", "_sig"], "trip_id").drop("_sig")


def busiest_date(counts: DataFrame) -> DataFrame:
    """Of candidate dates in order (ord, date, trips): the first with trips, or its successor if that has strictly more."""
    some = counts.where("trips > 0").agg(F.min("ord").alias("_first"))  # one row
    near = counts.crossJoin(F.broadcast(some)).where("ord = _first or ord = _first + 1")
    return near.orderBy(F.desc("trips"), "ord").limit(1).select("date", "trips")


def write_feed(tables: dict[str, DataFrame], folder: str) -> None:
    """Write tables as the feed's files, each with a header; columns that the feed does not know are left out."""
    for name, table in tables.items():
        known = [f.name for f in T.StructType.fromDDL(FILES[name]) if f.name in table.columns]
        table.select(*known).write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.txt")
