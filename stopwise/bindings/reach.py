"""Queries of reach, itineraries and readouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..operators import ordered
from ..plans import bikes, isochrone, reach, schedule
from ..queries import query, r6
from ..shared import written
from . import Tables
from .realtime import MOVES, hours
from .schedule import BUSIEST, KM
from .space import AREAS, PIP, areas
from .town import arrivals, origins, place_nodes, place_stops, streets

POINTS = ", points AS (SELECT stop_idx AS point_id, lat + 0.0007::DOUBLE AS lat, lon + 0.0009::DOUBLE AS lon FROM stops)\n"


def points(stops: DataFrame) -> DataFrame:
    return stops.select(F.col("stop_idx").alias("point_id"), (F.col("lat") + 0.0007).alias("lat"), (F.col("lon") + 0.0009).alias("lon"))


def reached_cells(t: Tables, departs: list[float], cap: float = 1800.0) -> DataFrame:
    """point_id, departure, cells: the cells that each bike station reaches by the timetable and through the streets, for each departure time."""
    at, nodes = written(place_stops(t)), written(place_nodes(t))
    ways, passes = written(streets(nodes)), []
    for depart in departs:
        cells = isochrone.walked_cells(arrivals(t, at, depart, cap), origins(t), at, nodes, ways, cap)
        passes.append(cells.select(F.col("source").alias("point_id"), F.lit(depart).alias("departure"), "cells"))
    return reduce(DataFrame.unionByName, passes)


@query("graph_04_mean_reach")
def _(t):
    return reach.mean_reach(reached_cells(t, [7.5 * 3600, 8 * 3600.0, 8.5 * 3600, 18 * 3600.0]))


@query("graph_04_mean_of_passes", "SELECT pattern_idx AS point_id, floor(avg(n) + 0.5)::BIGINT AS cells FROM (SELECT pattern_idx, floor(dep_sec / 3600.0), count(*) AS n FROM departures GROUP BY 1, 2) GROUP BY 1")
def _(t):
    passes = t.departures.groupBy(F.col("pattern_idx").alias("point_id"), F.floor(F.col("dep_sec") / 3600).alias("departure")).agg(F.count("*").alias("cells"))
    return reach.mean_reach(passes)


@query("agg_46_reach_profile")
def _(t):
    by_hour = reached_cells(t, [h * 3600.0 for h in (6, 8, 12, 17, 22)], 1200.0)
    return reach.day_profile(by_hour.select(F.col("point_id").alias("area"), (F.col("departure") / 3600).cast("int").alias("hour"), F.col("cells").alias("value")))


HOURS = ", hv AS (SELECT mode || route AS area, least(floor(dep_sec / 3600.0), 23)::INT AS hour, count(*) AS value FROM departures GROUP BY 1, 2)\n"


def hour_values(t: Tables) -> DataFrame:
    return t.departures.groupBy(F.concat("mode", "route").alias("area"), F.least(F.floor(F.col("dep_sec") / 3600), F.lit(23)).cast("int").alias("hour")).agg(F.count("*").alias("value"))


@query("agg_46_day_profile", HOURS + "SELECT area, first(hour ORDER BY value DESC, hour) AS peak_hour, first(hour ORDER BY value, hour) AS trough_hour, round((max(value) - min(value)) / max(value) * 100 * 10) / 10 AS drop_pct FROM hv GROUP BY 1")
def _(t):
    return reach.day_profile(hour_values(t))


@query("agg_47_city_profile", HOURS + "SELECT hour, round(avg(value), 6) AS value FROM hv GROUP BY 1")
def _(t):
    return reach.city_profile(hour_values(t)).withColumns(r6("value"))


@query("agg_96_leg_summary", """SELECT l_orderkey AS id, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS walk_m, sum(CASE WHEN l_linenumber = 2 THEN l_quantity ELSE 0 END) AS bike_m, greatest(count(*) FILTER (l_linenumber > 2) - 1, 0) AS transfers FROM lineitem GROUP BY 1""")
def _(t):
    kind = F.when(F.col("l_linenumber") == 1, "walk").when(F.col("l_linenumber") == 2, "bike").otherwise("bus")
    return reach.leg_summary(t.lineitem.select(F.col("l_orderkey").alias("id"), kind.alias("kind"), F.col("l_quantity").alias("metres")))


STOPS_AROUND = POINTS + f""", n AS (SELECT p.point_id, s.name, s.stop_idx, {KM('p', 's')} AS d FROM points p JOIN stops s ON {KM('p', 's')} <= 0.8), o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY point_id, name ORDER BY d, stop_idx) = 1)
SELECT point_id, row_number() OVER (PARTITION BY point_id ORDER BY d, stop_idx)::INT AS rank, name, stop_idx, round(d, 6) AS dist_km FROM o QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, stop_idx) <= 3"""


@query("agg_82_stops_around", STOPS_AROUND)
def _(t):
    return reach.stops_around(points(t.stops), t.stops).withColumns(r6("dist_km"))


LINES_AROUND = POINTS + f""", hw AS (SELECT mode, route, (max(dep_sec) - min(dep_sec)) / (count(*) - 1) / 60 AS h FROM departures WHERE dep_sec BETWEEN 25200 AND 32400 GROUP BY 1, 2 HAVING count(*) > 1), sv AS (SELECT DISTINCT p.stop_idx, d.route, hw.h FROM pattern_stops p JOIN (SELECT DISTINCT pattern_idx, mode, route FROM departures) d USING (pattern_idx) JOIN hw ON hw.mode = d.mode AND hw.route = d.route)
SELECT p.point_id, sv.route, round(min(sv.h), 6) AS headway_min FROM points p JOIN stops s ON {KM('p', 's')} <= 0.45 JOIN sv ON sv.stop_idx = s.stop_idx GROUP BY 1, 2"""


@query("agg_82_lines_around", LINES_AROUND)
def _(t):
    return reach.lines_around(points(t.stops), t.stops, served_lines(t)).withColumns(r6("headway_min"))


def served_lines(t: Tables) -> DataFrame:
    lines = t.departures.select("pattern_idx", "mode", "route").distinct()
    headway = schedule.mean_headway(t.departures, ["mode", "route"], 25200, 32400)
    return t.pattern_stops.join(lines, "pattern_idx").join(headway, ["mode", "route"]).select("stop_idx", "route", "headway_min").distinct()


NEAREST_PLACES = POINTS + f""", pl AS (SELECT *, 'c' || station_id % 3 AS category FROM stations) SELECT point_id, category, name, round(d, 6) AS dist_km FROM (SELECT p.point_id, pl.category, pl.name, {KM('p', 'pl')} AS d FROM points p JOIN pl ON {KM('p', 'pl')} <= 1.2) QUALIFY row_number() OVER (PARTITION BY point_id, category ORDER BY d, name) = 1"""


@query("agg_83_nearest_places", NEAREST_PLACES)
def _(t):
    return reach.nearest_places(points(t.stops), places(t)).withColumns(r6("dist_km"))


def places(t: Tables) -> DataFrame:
    return t.stations.select("name", "lat", "lon", F.concat(F.lit("c"), (F.col("station_id") % 3).cast("string")).alias("category"))


@query("win_08_neighbours", "SELECT mode, slug, lag(slug) OVER w AS previous, lead(slug) OVER w AS next FROM (SELECT DISTINCT mode, lower(route) AS slug FROM departures) WINDOW w AS (PARTITION BY mode ORDER BY slug)")
def _(t):
    return reach.neighbours_in_order(t.departures.select("mode", F.lower("route").alias("slug")).distinct())


@query("agg_95_line_edges", """, e AS (SELECT pattern_idx, stop_idx, lead(stop_idx) OVER (PARTITION BY pattern_idx ORDER BY stop_pos) AS nxt FROM pattern_stops) SELECT least(stop_idx, nxt) AS a, greatest(stop_idx, nxt) AS b, array_to_string(list_sort(list(DISTINCT route)), ',') AS lines FROM e JOIN (SELECT DISTINCT pattern_idx, route FROM departures) USING (pattern_idx) WHERE nxt IS NOT NULL AND nxt <> stop_idx GROUP BY 1, 2""")
def _(t):
    return reach.line_edges(t.pattern_stops, t.departures.select("pattern_idx", "route").distinct())


@query("agg_95_interchanges", "SELECT stop_idx, count(DISTINCT route) AS lines FROM pattern_stops JOIN (SELECT DISTINCT pattern_idx, route FROM departures) USING (pattern_idx) GROUP BY 1 HAVING count(DISTINCT route) >= 2")
def _(t):
    return reach.interchanges(t.pattern_stops, t.departures.select("pattern_idx", "route").distinct())


@query("agg_98_bounding_box", "SELECT round(min(lat) - (max(lat) - min(lat)) * 0.06, 6) AS south, round(max(lat) + (max(lat) - min(lat)) * 0.06, 6) AS north, round(min(lon) - (max(lon) - min(lon)) * 0.06, 6) AS west, round(max(lon) + (max(lon) - min(lon)) * 0.06, 6) AS east FROM stops")
def _(t):
    return reach.bounding_box(t.stops).withColumns(r6("south", "north", "west", "east"))


@query("agg_97_line_board", """, n AS (SELECT mode, route, count(*) AS departures, count(*) FILTER (floor(dep_sec / 3600.0)::INT % 24 < 4 OR floor(dep_sec / 3600.0)::INT % 24 >= 23) AS night FROM departures GROUP BY 1, 2)
SELECT mode, route, departures, row_number() OVER (PARTITION BY mode ORDER BY departures DESC, route)::INT AS place FROM n WHERE night <= departures - night""")
def _(t):
    return reach.line_board(t.departures, schedule.night_lines(t.departures).where("is_night").select("mode", "route"))


@query("graph_07_best_by_name", ", s AS (SELECT stop_idx, 'N' || stop_idx % 50 AS name, (stop_idx * 7919 % 997)::DOUBLE AS score FROM stops) SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, stop_idx) = 1) ORDER BY score DESC, name LIMIT 20")
def _(t):
    i = F.col("stop_idx")
    return reach.best_by_name(t.stops.select("stop_idx", F.concat(F.lit("N"), (i % 50).cast("string")).alias("name"), (i * 7919 % 997).cast("double").alias("score")))


@query("agg_87_feed_health", "SELECT count(*) AS trips, max(day) AS last_day, max(day) - 2000 AS runway_days FROM trips")
def _(t):
    return reach.feed_health(t.trips, 2000)


@query("geo_08_line_distance", f""", lg AS (SELECT p.pattern_idx, s.lat AS lat1, s.lon AS lon1, lead(s.lat) OVER w AS lat2, lead(s.lon) OVER w AS lon2 FROM pattern_stops p JOIN stops s USING (stop_idx) WINDOW w AS (PARTITION BY pattern_idx ORDER BY stop_pos)), pt AS (SELECT stop_idx % 40 AS pattern_idx, stop_idx AS point_id, lat, lon FROM stops),
m AS (SELECT pt.*, lat - lat1 AS y, (lon - lon1) * {G.LON_SHARE}::DOUBLE AS x, lat2 - lat1 AS dy, (lon2 - lon1) * {G.LON_SHARE}::DOUBLE AS dx FROM pt JOIN lg USING (pattern_idx) WHERE lat2 IS NOT NULL), k AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest((x * dx + y * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS u FROM m)
SELECT pattern_idx, point_id, round(min(sqrt(pow(x - u * dx, 2) + pow(y - u * dy, 2)) * {G.KM_PER_DEGREE}::DOUBLE), 6) AS dist_km FROM k GROUP BY 1, 2""")
def _(t):
    w = W.partitionBy("pattern_idx").orderBy("stop_pos")
    at = t.pattern_stops.join(t.stops.select("stop_idx", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "stop_idx")
    legs = at.withColumns({"lat2": F.lead("lat1").over(w), "lon2": F.lead("lon1").over(w)}).where("lat2 is not null").select("pattern_idx", "lat1", "lon1", "lat2", "lon2")
    return reach.line_distance(t.stops.select((F.col("stop_idx") % 40).alias("pattern_idx"), F.col("stop_idx").alias("point_id"), "lat", "lon"), legs, "pattern_idx").withColumns(r6("dist_km"))


@query("win_14_quantised", ", q AS (SELECT pattern_idx, stop_pos AS pos, round(s.lat * 100) / 100 AS lat, round(s.lon * 100) / 100 AS lon FROM pattern_stops JOIN stops s USING (stop_idx)) SELECT * FROM q QUALIFY coalesce(lag(lat) OVER (PARTITION BY pattern_idx ORDER BY pos) <> lat OR lag(lon) OVER (PARTITION BY pattern_idx ORDER BY pos) <> lon, TRUE)")
def _(t):
    at = t.pattern_stops.join(t.stops.select("stop_idx", "lat", "lon"), "stop_idx").select("pattern_idx", F.col("stop_pos").alias("pos"), "lat", "lon")
    return reach.quantised(at, "pattern_idx", 2)


@query("agg_73_commute_flow", MOVES + AREAS + f""", fl AS (SELECT station_id, hour(l)::INT AS hour, sum(starts) AS s, sum(returns) AS r, sum(bulk_out) AS o, sum(bulk_in) AS i, count(DISTINCT strftime(l, '%Y-%m-%d')) AS days FROM (SELECT *, timezone('Europe/Zagreb', to_timestamp(hour_ts)) AS l FROM hours WHERE samples >= 50) GROUP BY 1, 2), pl AS (SELECT 'S' || e AS station_id, length(e) % 3 AS area FROM (SELECT DISTINCT event_type AS e FROM events)), x AS (SELECT area, sum(CASE WHEN hour BETWEEN 7 AND 9 THEN ((r - i) - (s - o)) / days ELSE 0 END) AS m, sum(CASE WHEN hour BETWEEN 16 AND 18 THEN ((r - i) - (s - o)) / days ELSE 0 END) AS v FROM fl JOIN pl USING (station_id) GROUP BY 1)
SELECT area, round(m, 6) AS morning, round(v, 6) AS evening, m * v < 0 AND abs(m) >= 3 AND abs(v) >= 3 AS turns FROM x""")
def _(t):
    placed = t.events.select(F.concat(F.lit("S"), "event_type").alias("station_id"), (F.length("event_type") % 3).alias("area")).distinct()
    return bikes.commute_flow(bikes.station_flow(hours(t)), placed).withColumns(r6("morning", "evening"))


@query("agg_94_reach_statistics", AREAS + f""", b AS (SELECT stop_idx % 4 AS band, {PIP('s')} AS area_ord FROM stops s) SELECT band, count(*) AS points, count(DISTINCT area_ord) AS districts FROM b GROUP BY 1""")
def _(t):
    from ..operators.spatial import containing

    return containing(t.stops, areas(t), "stop_idx").groupBy((F.col("stop_idx") % 4).alias("band")).agg(F.count("*").alias("points"), F.countDistinct("area_ord").alias("districts"))


@query("join_02_busiest_first_stop", BUSIEST + "SELECT b.mode, b.route, s.name FROM busiest b JOIN pattern_stops p ON p.pattern_idx = b.pattern_idx AND p.stop_pos = 0 JOIN stops s USING (stop_idx)")
def _(t):
    first = t.pattern_stops.where("stop_pos = 0")
    return schedule.busiest_patterns(t.departures).join(first, "pattern_idx").join(t.stops, "stop_idx").select("mode", "route", "name")


@query("join_14_running_trips", "SELECT pattern_idx, count(*) AS running FROM departures JOIN (SELECT pattern_idx, max(offset_sec) AS o FROM pattern_stops GROUP BY 1) USING (pattern_idx) WHERE dep_sec <= 30000 AND dep_sec + o >= 30000 GROUP BY 1")
def _(t):
    last = t.pattern_stops.groupBy("pattern_idx").agg(F.max("offset_sec").alias("o"))
    return t.departures.join(last, "pattern_idx").where((F.col("dep_sec") <= 30000) & (F.col("dep_sec") + F.col("o") >= 30000)).groupBy("pattern_idx").agg(F.count("*").alias("running"))


@query("join_10_transfer_both_ways", """SELECT d.pattern_idx, d.dep_sec, (SELECT min(e.dep_sec) FROM departures e WHERE e.mode = 'TRAM' AND e.dep_sec >= d.dep_sec) AS after, (SELECT max(e.dep_sec) FROM departures e WHERE e.mode = 'TRAM' AND e.dep_sec <= d.dep_sec) AS before FROM departures d  WHERE d.mode = 'RAIL'""")
def _(t):
    rail = t.departures.where("mode = 'RAIL'").select("pattern_idx", "dep_sec", F.lit("TRAM").alias("mode"))
    tram = t.departures.where("mode = 'TRAM'").select("mode", F.col("dep_sec").alias("u"))
    both = ordered.last_at_or_before(ordered.next_at_or_after(rail, tram, ["mode"], "dep_sec", "u", "after", width=60), tram, ["mode"], "dep_sec", "u", "before", width=60)
    return both.drop("mode")
