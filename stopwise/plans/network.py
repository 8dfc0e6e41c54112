"""Service days, stop and line pages, coverage, address and place registers, line geometry, network insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import REACH_CELL, flat_km, in_ring, segment_km
from ..operators.ordered import first_by
from ..operators.spatial import _around, _cells

H = 3600
#: Weekdays in the order in which they stand for a working day (0 is Sunday).
WORKDAYS = (2, 3, 4, 1, 5)


def day_of_week(date: Column) -> Column:
    """Weekday of a yyyymmdd text, 0 for Sunday; null for texts of another length or no date."""
    return F.when(F.length(date) == 8, F.dayofweek(F.try_to_date(date, "yyyyMMdd")) - 1)


def next_weekday(day: Column, weekday: int) -> Column:
    """The next date after day that falls on the weekday (0 is Sunday)."""
    return F.date_add(day, F.pmod(F.lit(weekday + 6) - (F.dayofweek(day) - 1), F.lit(7)) + 1)


def candidate_dates(days: DataFrame, day: str = "day", within: int = 14) -> DataFrame:
    """For each day the workdays of the next two weeks in the order of preference: ord, date."""
    dates = F.explode(F.sequence(F.date_add(F.col(day), 1), F.date_add(F.col(day), within)))
    all_ = days.select(day, dates.alias("date")).withColumn("_p", F.array_position(F.array(*[F.lit(x) for x in WORKDAYS]), F.dayofweek("date") - 1)).where("_p > 0")
    rank = F.row_number().over(W.partitionBy(day).orderBy("_p", "date"))
    return all_.select(day, rank.alias("ord"), "date")


def service_day(wanted: DataFrame, counts: DataFrame, weeks: int = 8) -> DataFrame:
    """For each wanted day (a number) the day itself or the nearest one whole weeks back with departures (day, n)."""
    back = wanted.select("day", F.explode(F.sequence(F.lit(0), F.lit(weeks))).alias("_w")).withColumn("served", F.col("day") - 7 * F.col("_w"))
    met = back.join(counts.where("n > 0").select(F.col("day").alias("served"), "n"), "served")
    return met.groupBy("day").agg(F.max("served").alias("served"))


def without_modes(patterns: DataFrame, excluded: list[str]) -> DataFrame:
    """Patterns of the modes that are not excluded."""
    return patterns.where(~F.col("mode").isin(excluded))


def near_box(points: DataFrame, lat: float, lon: float, half: float = 0.3) -> DataFrame:
    """Points within half a degree count of a box about a place."""
    return points.where(F.col("lat").between(lat - half, lat + half) & F.col("lon").between(lon - half, lon + half))


def sampled_offsets(times: DataFrame, most: int = 5) -> DataFrame:
    """Median offset of each stop of a pattern over at most five trips, evenly taken from those that serve every stop.

    times: pattern_idx, trip_id, stop_pos, offset_sec.
    """
    size = times.groupBy("pattern_idx", "trip_id").agg(F.count("*").alias("_n"), F.min("offset_sec").alias("_lo"))
    whole = size.groupBy("pattern_idx").agg(F.max("_n").alias("_n"))
    full = size.where("_lo >= 0").join(whole, ["pattern_idx", "_n"])
    by = W.partitionBy("pattern_idx")
    numbered = full.withColumn("_i", F.row_number().over(by.orderBy("trip_id")) - 1).withColumn("_of", F.count("*").over(by))
    taken = F.exists(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * F.col("_of") / most) == F.col("_i"))
    trips = numbered.where(taken).select("pattern_idx", "trip_id")
    return times.join(trips, ["pattern_idx", "trip_id"]).groupBy("pattern_idx", "stop_pos").agg(F.percentile("offset_sec", F.lit(0.5)).alias("offset_sec"))


def stop_page(departures: DataFrame, pattern_stops: DataFrame, night: DataFrame) -> DataFrame:
    """Per stop: lines, departures, first and last, mean headway from 7 to 9.

    A pattern boards at its first visit.  First and last leave out night lines and
    what runs from 26 h on, unless nothing else is left.
    """
    visit = pattern_stops.groupBy("pattern_idx", "stop_idx").agg(F.min("offset_sec").alias("_o"))
    at = departures.join(visit, "pattern_idx").withColumn("t", F.col("dep_sec") + F.col("_o"))
    at = at.join(night.select("mode", "route", F.lit(True).alias("_night")), ["mode", "route"], "left")
    by_day = F.col("_night").isNull() & (F.col("t") < 26 * H)
    peak = F.col("t").between(7 * H, 9 * H)
    own = at.groupBy("stop_idx").agg(
        F.countDistinct("route").alias("lines"), F.count("*").alias("departures"),
        F.coalesce(F.min(F.when(by_day, F.col("t"))), F.min("t")).alias("first_sec"),
        F.coalesce(F.max(F.when(by_day, F.col("t"))), F.max("t")).alias("last_sec"),
        F.count(F.when(peak, 1)).alias("_n"), F.min(F.when(peak, F.col("t"))).alias("_lo"), F.max(F.when(peak, F.col("t"))).alias("_hi"),
    )
    headway = F.when(F.col("_n") > 1, (F.col("_hi") - F.col("_lo")) / (F.col("_n") - 1) / 60.0)
    return own.withColumn("headway_min", headway).drop("_n", "_lo", "_hi")


def line_statistics(departures: DataFrame, lengths: DataFrame, dominant: DataFrame) -> DataFrame:
    """Per line: departures of all directions, first and last, and travel time and length of its dominant pattern."""
    own = departures.groupBy("mode", "route").agg(F.count("*").alias("daily"), F.min("dep_sec").alias("first_sec"), F.max("dep_sec").alias("last_sec"))
    shape = dominant.select("mode", "route", "pattern_idx").join(lengths.select("pattern_idx", "km", "travel_sec"), "pattern_idx")
    return own.join(shape, ["mode", "route"]).drop("pattern_idx")


def line_coverage(served: DataFrame) -> DataFrame:
    """Per line (mode, route, area): how many areas it touches; null areas do not count."""
    return served.groupBy("mode", "route").agg(F.countDistinct("area").alias("areas"))


def coverage_by_mode(coverage: DataFrame) -> DataFrame:
    """Lines and mean number of areas by mode."""
    return coverage.groupBy("mode").agg(F.count("*").alias("lines"), F.avg("areas").alias("avg_areas"))


def network_insights(departures: DataFrame) -> DataFrame:
    """One row: the hour with most departures, the busiest tram line, departures by day and at night."""
    hour = F.floor(F.col("dep_sec") / H) % 24
    by_hour = departures.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    peak = by_hour.agg(F.min(F.struct((-F.col("n")).alias("m"), "hour")).alias("p"))
    trams = departures.where("mode = 'TRAM'").groupBy("route").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), "route")).alias("b"))
    night = (hour < 4) | (hour >= 23)
    split = departures.agg(F.count(F.when(~night, 1)).alias("by_day"), F.count(F.when(night, 1)).alias("at_night"))
    # three one-row frames
    met = peak.crossJoin(trams).crossJoin(split)
    return met.select(F.col("p.hour").cast("long").alias("peak_hour"), (-F.col("p.m")).alias("peak_departures"), F.col("b.route").alias("busiest_tram"), "by_day", "at_night")


def relocation_summary(hours: DataFrame, least_minutes: int = 1400) -> DataFrame:
    """Relocations a day over complete days (day, hour, minutes, moves), and the busiest hour of the day."""
    days = hours.groupBy("day").agg(F.sum("minutes").alias("_m")).where(F.col("_m") >= least_minutes).select("day")
    own = hours.join(days, "day", "left_semi")
    busiest = own.groupBy("hour").agg(F.sum("moves").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("m"), "hour")).alias("b"))
    total = own.agg(F.countDistinct("day").alias("days"), F.sum("moves").alias("moves"))
    return total.crossJoin(busiest).select("days", "moves", (F.col("moves") / F.col("days")).alias("per_day"), F.col("b.hour").alias("busiest_hour"))


def runs_of_days(rows: DataFrame, day: str, *values: Column) -> DataFrame:
    """Rows folded into one for each day."""
    return rows.groupBy(day).agg(*values)


def stop_names(rows: DataFrame, patterns: DataFrame, pattern_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """rows (route, stop_pos) with the stop's name on the route's first pattern, "Stop n" where it has none."""
    first = patterns.groupBy("route").agg(F.min("pattern_idx").alias("pattern_idx"))
    named = first.join(pattern_stops, "pattern_idx").join(stops.select("stop_idx", "name"), "stop_idx").select("route", "stop_pos", "name")
    return rows.join(named, ["route", "stop_pos"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Stop "), (F.col("stop_pos") + 1).cast("string"))))


def touching_areas(left: DataFrame, right: DataFrame, km: float = 1.0, per_side: int = 4) -> DataFrame:
    """Pairs of areas (ord, ring) with a sampled border point of the one inside the other.

    Points meet rings by grid cell, so areas far apart are never compared.
    """

    def border(areas: DataFrame, key: str) -> DataFrame:
        n = F.size("ring")
        side = areas.select(F.col("ord").alias(key), "ring", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
        a, b = F.element_at("ring", F.col("_i") + 1), F.element_at("ring", F.when(F.col("_i") + 1 == n, 1).otherwise(F.col("_i") + 2))
        ends = side.select(key, a.alias("p"), b.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(per_side - 1))).alias("_k"))
        t = F.col("_k") / float(per_side)
        return ends.select(key, (F.col("p.lat") + (F.col("q.lat") - F.col("p.lat")) * t).alias("lat"), (F.col("p.lon") + (F.col("q.lon") - F.col("p.lon")) * t).alias("lon"))

    def inside(points: DataFrame, areas: DataFrame, key: str) -> DataFrame:
        lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
        (y0, x0), (y1, x1) = _cells(F.array_min(lats), F.array_min(lons), km), _cells(F.array_max(lats), F.array_max(lons), km)
        boxed = areas.select(F.col("ord").alias(key), "ring", F.explode(F.sequence(y0, y1)).alias("_cy"), F.sequence(x0, x1).alias("_xs")).withColumn("_cx", F.explode("_xs"))
        placed = points.withColumns(dict(zip(("_cy", "_cx"), _cells(F.col("lat"), F.col("lon"), km), strict=True)))
        return placed.join(boxed, ["_cy", "_cx"]).where(in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).select("a", "b")

    return inside(border(left, "a"), right, "b").unionByName(inside(border(right, "b"), left, "a")).distinct()


def address_register(pages: DataFrame) -> DataFrame:
    """Streets with their houses: the first entrance (by ord) of each street, settlement and number; numbers before suffixes.

    Houses are lower case without blanks; a missing street has its settlement's name.
    """
    house = F.lower(F.regexp_replace("house", r"\s+", ""))
    clean = pages.select(F.coalesce("street", "settlement").alias("street"), "settlement", house.alias("house"), "ord", "lat", "lon").where("house <> ''")
    first = first_by(clean, ["street", "settlement", "house"], "ord")
    number = F.coalesce(F.regexp_extract("house", r"^(\d+)", 1).try_cast("int"), F.lit(0))
    listed = F.sort_array(F.collect_list(F.struct(number.alias("n"), "house")))
    return first.groupBy("street", "settlement").agg(F.count("*").alias("houses"), F.array_join(F.transform(listed, lambda x: x["house"]), ",").alias("numbers"))


def place_category(tags: Column, wanted: list[tuple[str, str, list[str]]]) -> Column:
    """The first category (name, tag, values) in the requested order whose tag has one of the values."""
    out = F.lit(None).cast("string")
    for name, tag, values in reversed(wanted):
        out = F.when(tags[tag].isin(values), F.lit(name)).otherwise(out)
    return out


def elevation(points: DataFrame, tiles: DataFrame, side: int) -> DataFrame:
    """points (lat, lon) with the nearest sample of their one-degree tile (lat0, lon0, content: side x side big-endian int16 from the north-west); voids are 0."""
    keyed = points.withColumns({"lat0": F.floor("lat").cast("int"), "lon0": F.floor("lon").cast("int")})
    met = keyed.join(tiles, ["lat0", "lon0"], "left")
    row = F.round((1 - (F.col("lat") - F.col("lat0"))) * (side - 1)).cast("int")
    col = F.round((F.col("lon") - F.col("lon0")) * (side - 1)).cast("int")
    raw = F.conv(F.hex(F.substring(F.col("content"), 2 * (row * side + col) + 1, F.lit(2))), 16, 10).cast("int")
    metres = F.when(raw >= 32768, raw - 65536).otherwise(raw)
    return met.withColumn("elevation", F.when(metres == -32768, 0).otherwise(F.coalesce(metres, F.lit(0)))).drop("content", "lat0", "lon0")


def running_total(rows: DataFrame, key: str, value: str, width: int, out: str = "before") -> DataFrame:
    """rows with the sum of value over smaller keys (whole numbers); sums of runs of width keys come first, so no task holds all rows."""
    cut = rows.withColumn("_run", F.floor(F.col(key) / width))
    runs = cut.groupBy("_run").agg(F.sum(value).alias("_s"))
    before = runs.select("_run", (F.sum("_s").over(W.orderBy("_run")) - F.col("_s")).alias("_b"))  # a row for each run
    own = F.sum(value).over(W.partitionBy("_run").orderBy(key)) - F.col(value)
    return cut.withColumn("_o", own).join(before, "_run").withColumn(out, F.col("_o") + F.col("_b")).drop("_run", "_o", "_b")


def compressed_rows(edges: DataFrame, nodes: DataFrame, width: int = 4_096) -> DataFrame:
    """Per node: where its edges begin in the order of sources, how many there are, and their ends in order."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("targets"))
    whole = nodes.join(out, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("targets", F.lit("")).alias("targets"))
    return running_total(whole, "node", "degree", width, "first")


def cells_on_line(legs: DataFrame, key: list[str], cell: float = REACH_CELL) -> DataFrame:
    """Cells that a leg crosses (from lat1, lon1, sec1 to lat2, lon2, sec2), with the least time of each by key; times grow evenly along a leg."""
    at = lambda c: F.floor(F.col(c) / cell)
    placed = legs.withColumns({"_y": at("lat1"), "_x": at("lon1"), "_dy": at("lat2") - at("lat1"), "_dx": at("lon2") - at("lon1")})
    n = F.greatest(F.abs("_dy"), F.abs("_dx"), F.lit(1))
    steps = placed.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    part = F.col("_i") / F.col("_n")
    near = lambda start, d: F.col(start) + F.floor(F.col(d) * part + 0.5)
    return steps.groupBy(*key, near("_y", "_dy").alias("cy"), near("_x", "_dx").alias("cx")).agg(F.min(F.col("sec1") + (F.col("sec2") - F.col("sec1")) * part).alias("sec"))


def line_difference(points: DataFrame, legs: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """Per key: the p90 (by floor index) of the distances from points to the nearest leg of the key, in km."""
    met = points.join(legs, key).withColumn("d", segment_km(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    nearest = met.groupBy(key, "point_id").agg(F.min("d").alias("d"))
    by = W.partitionBy(key)
    placed = nearest.withColumn("_i", F.row_number().over(by.orderBy("d", "point_id")) - 1).withColumn("_n", F.count("*").over(by))
    return placed.where(F.col("_i") == F.floor(F.col("_n") * share).cast("int")).select(key, F.col("d").alias("p90_km"))


def symmetric_difference(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """The greater of the two one-sided differences of each key."""
    both = one.withColumnRenamed("p90_km", "_a").join(two.withColumnRenamed("p90_km", "_b"), key)
    return both.select(key, F.greatest("_a", "_b").alias("p90_km"))


def simplified(points: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Points of lines (key, pos, lat, lon) that Douglas and Peucker's rule keeps, in degrees; a task holds one line at a time."""
    import numpy as np
    import pyarrow as pa

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        x, y = table.column("lon").to_numpy(), table.column("lat").to_numpy()
        keep = np.zeros(len(x), bool)
        keep[[0, -1]] = True
        todo = [(0, len(x) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            dx, dy = x[b] - x[a], y[b] - y[a]
            size = dx * dx + dy * dy
            px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
            t = np.clip((px * dx + py * dy) / size, 0, 1) if size > 0 else np.zeros(len(px))
            d = np.hypot(px - t * dx, py - t * dy)
            if d.max() > tolerance:
                m = a + 1 + int(d.argmax())
                keep[m] = True
                todo += [(a, m), (m, b)]
        return table.filter(pa.array(keep))

    return points.groupBy(key).applyInArrow(cut, points.schema)


def clipped(points: DataFrame, centres: DataFrame, key: str, km: float) -> DataFrame:
    """The run of a line's points (key, pos, lat, lon) around the one nearest to the key's centre (clat, clon) that stays within km of it."""
    met = points.join(centres, key).withColumn("d", flat_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")))
    by = W.partitionBy(key).orderBy("pos")
    nearest = first_by(met, [key], "d", "pos").select(key, F.col("pos").alias("_at"))
    run = met.withColumn("_g", F.sum((F.col("d") > km).cast("int")).over(by)).where(F.col("d") <= km)
    home = run.join(nearest, key).where("pos = _at").select(key, F.col("_g").alias("_home"))
    return run.join(home, key).where("_g = _home").select(key, "pos", "lat", "lon")


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator metres (x, y)."""
    radius = 6378137.0
    return F.radians(lon) * radius, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * radius


def travel_matrix(arrivals: DataFrame, placed: DataFrame, origins: DataFrame) -> DataFrame:
    """Minutes between areas: from each area's origin (area, source) the least arrival at a node of another area (node, area), rounded up."""
    to = arrivals.join(placed.select("node", F.col("area").alias("dest")), "node")
    met = to.join(origins.select("source", F.col("area").alias("origin")), "source").where("origin <> dest")
    return met.groupBy("origin", "dest").agg(F.ceil(F.min("cost") / 60).alias("minutes"))


def bands_of_cells(cells: DataFrame, bands: tuple[int, ...] = (300, 600, 900, 1200, 1800)) -> DataFrame:
    """Per source: how many cells (source, cy, cx, sec) are reached first within each band, and not before."""
    band = F.lit(None).cast("int")
    for b in reversed(bands):
        band = F.when(F.col("sec") <= b, F.lit(b)).otherwise(band)
    return cells.select("source", band.alias("band")).where("band is not null").groupBy("source", "band").agg(F.count("*").alias("cells"))


def line_features(arrivals: DataFrame, segments: DataFrame, cap: float = 1800.0) -> DataFrame:
    """Segments of lines (mode, src, dst) whose both ends a source reaches within the cap, by the minute of the earlier one; rail is left out."""
    a = arrivals.select("source", F.col("node").alias("src"), F.col("cost").alias("t1"))
    b = arrivals.select("source", F.col("node").alias("dst"), F.col("cost").alias("t2"))
    met = a.join(segments.where("mode <> 'RAIL'"), "src").join(b, ["source", "dst"]).where((F.col("t1") <= cap) & (F.col("t2") <= cap))
    return met.groupBy("source", F.floor(F.least("t1", "t2") / 60).alias("minute")).agg(F.count("*").alias("segments"))


def routing_payload(best: DataFrame, patterns: DataFrame) -> DataFrame:
    """Nodes (source, node, pattern_idx or null) with their pattern's place among the patterns that the source uses, from 0."""
    used = best.where("pattern_idx is not null").select("source", "pattern_idx").distinct()
    numbered = used.withColumn("pattern_ref", F.row_number().over(W.partitionBy("source").orderBy("pattern_idx")) - 1)
    named = numbered.join(patterns.select("pattern_idx", "route"), "pattern_idx", "left")
    return best.join(named, ["source", "pattern_idx"], "left").select("source", "node", "pattern_ref", "route")


def without_near_doubles(hits: DataFrame, by: str, order: str, degrees: float = 0.0005) -> DataFrame:
    """Hits of each query in order, without those within a box of a kept one, or with its folded title and no number.

    hits: by, order, title, lat, lon; a query has few hits.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.lower("title").alias("t"), "title", "lat", "lon")))
    near = lambda a, x: (F.abs(a["lat"] - x["lat"]) < degrees) & (F.abs(a["lon"] - x["lon"]) < degrees)
    same = lambda a, x: (a["t"] == x["t"]) & ~x["t"].rlike(r"\d")
    step = lambda acc, x: F.when(F.exists(acc, lambda a: near(a, x) | same(a, x)), acc).otherwise(F.array_append(acc, x))
    empty = F.array().cast("array<struct<o:bigint,t:string,title:string,lat:double,lon:double>>")
    kept = hits.withColumn(order, F.col(order).cast("long")).groupBy(by).agg(listed.alias("all")).select(by, F.explode(F.aggregate("all", empty, step)).alias("k"))
    return kept.select(by, F.col("k.o").alias(order), "k.title", "k.lat", "k.lon")


def route_difference(old: DataFrame, new: DataFrame, stops: DataFrame, moved_km: float = 0.3) -> DataFrame:
    """Per route and direction (route, direction, stop_pos, stop_idx): stops added and removed, how far the last stop moved, and what changed."""
    ids = lambda df, name: df.groupBy("route", "direction").agg(F.collect_set("stop_idx").alias(name), F.max_by("stop_idx", "stop_pos").alias(f"{name}_last"))
    place = lambda c, name: stops.select(F.col("stop_idx").alias(c), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    met = ids(old, "a").join(ids(new, "b"), ["route", "direction"]).join(place("a_last", "x"), "a_last").join(place("b_last", "y"), "b_last")
    added, removed = F.size(F.array_except("b", "a")), F.size(F.array_except("a", "b"))
    out = met.select("route", "direction", added.alias("added"), removed.alias("removed"), flat_km(F.col("x_lat"), F.col("x_lon"), F.col("y_lat"), F.col("y_lon")).alias("moved_km"))
    change = F.when(F.col("moved_km") > moved_km, "terminus").when(F.col("added") + F.col("removed") > 0, "stops").otherwise("same")
    scored = out.withColumn("change", change).withColumn("_s", F.col("moved_km") * 1000 + 200 * (F.col("added") + F.col("removed")))
    return first_by(scored, ["route"], F.desc("_s"), "direction").drop("_s")


def spread_cells(points: DataFrame, cell: float = 0.003) -> DataFrame:
    """The cells of points and the eight around each."""
    at = points.select(F.floor(F.col("lat") / cell).alias("_cy"), F.floor(F.col("lon") / cell).alias("_cx"))
    return _around(at).select(F.col("_cy").alias("cy"), F.col("_cx").alias("cx")).distinct()
