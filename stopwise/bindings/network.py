"""Queries of service days, stop and line pages, registers, line geometry and reach on maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import numbers as N
from ..functions import text as T
from ..operators import ordered, spatial
from ..plans import changes, districts, network, schedule
from ..queries import query, r6
from . import Tables
from .schedule import KM, LENGTHS
from .space import AREAS, PIP, areas

# --- dates -------------------------------------------------------------------

DATES = ", d AS (SELECT trip_id, day, DATE '1995-01-01' + day AS date FROM trips)\n"


def dates(t: Tables) -> DataFrame:
    return t.trips.select("trip_id", "day", F.date_add(F.lit("1995-01-01").cast("date"), F.col("day")).alias("date"))


@query("flt_06_day_of_week", DATES + """SELECT trip_id, CASE WHEN trip_id % 7 = 0 THEN NULL ELSE dayofweek(date)::INT END AS dow FROM d""")
def _(t):
    text = F.concat(F.date_format("date", "yyyyMMdd"), F.when(F.col("trip_id") % 7 == 0, F.lit("x")).otherwise(F.lit("")))
    return dates(t).select("trip_id", network.day_of_week(text).cast("int").alias("dow"))


@query("flt_07_next_weekday", DATES + """SELECT trip_id, strftime(date + (((3 + 6 - dayofweek(date)) % 7) + 1)::INT, '%Y-%m-%d') AS next FROM d""")
def _(t):
    return dates(t).select("trip_id", network.next_weekday(F.col("date"), 3).cast("string").alias("next"))


@query("flt_07_candidate_dates", DATES + """, c AS (SELECT day, date + k::INT AS c FROM (SELECT DISTINCT day, date FROM d), range(1, 15) r(k)), p AS (SELECT *, list_position([2, 3, 4, 1, 5], dayofweek(c)) AS p FROM c)
SELECT day, row_number() OVER (PARTITION BY day ORDER BY p, c)::INT AS ord, strftime(c, '%Y-%m-%d') AS date FROM p WHERE p > 0""")
def _(t):
    days = dates(t).select(F.col("day").alias("n"), F.col("date").alias("day")).distinct()
    out = network.candidate_dates(days.select("day")).join(days, "day")
    return out.select(F.col("n").alias("day"), "ord", F.col("date").cast("string").alias("date"))


@query("flt_09_service_day", """, n AS (SELECT day, count(*) AS n FROM trips WHERE mode = 'TRAM' AND day % 11 > 4 GROUP BY 1), w AS (SELECT DISTINCT day FROM trips)
SELECT w.day, max(n.day) AS served FROM w JOIN n ON (w.day - n.day) % 7 = 0 AND w.day - n.day BETWEEN 0 AND 56 GROUP BY 1""")
def _(t):
    n = t.trips.where("mode = 'TRAM' and day % 11 > 4").groupBy("day").agg(F.count("*").alias("n"))
    return network.service_day(t.trips.select("day").distinct(), n)


@query("flt_10_modes_left_out", "SELECT mode, count(*) AS n FROM departures WHERE mode NOT IN ('RAIL', 'FERRY') GROUP BY 1")
def _(t):
    return network.without_modes(t.departures, ["RAIL", "FERRY"]).groupBy("mode").agg(F.count("*").alias("n"))


@query("flt_11_near_box", "SELECT stop_idx FROM stops WHERE lat BETWEEN 45.7703 AND 45.7905 AND lon BETWEEN 15.8702 AND 15.8904")
def _(t):
    return network.near_box(t.stops, 45.7804, 15.8803, 0.0101).select("stop_idx")


@query("flt_05_weekday_services", "SELECT route_id, bool_or(dow BETWEEN 1 AND 5) AS weekday, bool_or(dow = 6) AS saturday, bool_or(dow = 0) AS sunday FROM trips GROUP BY 1")
def _(t):
    own = t.trips.groupBy("route_id")
    return own.agg(F.bool_or(F.col("dow").between(1, 5)).alias("weekday"), F.bool_or(F.col("dow") == 6).alias("saturday"), F.bool_or(F.col("dow") == 0).alias("sunday"))


@query("win_10_folded_days", "SELECT day, count(*) AS trips, count(DISTINCT route_id) AS routes FROM trips GROUP BY 1")
def _(t):
    return network.runs_of_days(t.trips, "day", F.count("*").alias("trips"), F.countDistinct("route_id").alias("routes"))


@query("sort_05_dates_last", "SELECT trip_id, row_number() OVER (PARTITION BY route_id ORDER BY block_id DESC NULLS LAST, trip_id)::INT AS place FROM trips")
def _(t):
    return ordered.ranked(t.trips, F.desc_nulls_last("block_id"), "trip_id", out="place", by=["route_id"]).select("trip_id", "place")


# --- pages -------------------------------------------------------------------

SEVENTH = ", times AS (SELECT l_orderkey % 11 AS pattern_idx, l_orderkey AS trip_id, l_linenumber - 1 AS stop_pos, (l_linenumber * 60 + l_partkey % 50 - 70)::BIGINT AS offset_sec FROM lineitem)\n"


@query("agg_01_sampled_offsets", SEVENTH + """, s AS (SELECT pattern_idx, trip_id, count(*) AS n, min(offset_sec) AS lo FROM times GROUP BY 1, 2), f AS (
  SELECT *, row_number() OVER (PARTITION BY pattern_idx ORDER BY trip_id) - 1 AS i, count(*) OVER (PARTITION BY pattern_idx) AS m FROM (SELECT *, max(n) OVER (PARTITION BY pattern_idx) AS most FROM s) WHERE n = most AND lo >= 0
), k AS (SELECT pattern_idx, trip_id FROM f WHERE i IN (0, m // 5, 2 * m // 5, 3 * m // 5, 4 * m // 5))
SELECT pattern_idx, stop_pos, round(quantile_cont(offset_sec, 0.5), 6) AS offset_sec FROM times JOIN k USING (pattern_idx, trip_id) GROUP BY 1, 2""")
def _(t):
    line = F.col("l_linenumber")
    times = t.lineitem.select(
        (F.col("l_orderkey") % 11).alias("pattern_idx"), F.col("l_orderkey").alias("trip_id"), (line - 1).alias("stop_pos"), (line * 60 + F.col("l_partkey") % 50 - 70).cast("long").alias("offset_sec")
    )
    return network.sampled_offsets(times).withColumns(r6("offset_sec"))


NIGHT = """, night AS (SELECT mode, route FROM departures GROUP BY 1, 2 HAVING count(*) FILTER (floor(dep_sec / 3600.0)::INT % 24 < 4 OR floor(dep_sec / 3600.0)::INT % 24 >= 23) * 2 > count(*))
, visit AS (SELECT pattern_idx, stop_idx, min(offset_sec) AS o FROM pattern_stops GROUP BY 1, 2)
"""


@query("agg_39_stop_page", NIGHT + """, a AS (SELECT stop_idx, d.route, dep_sec + o AS t, n.mode IS NULL AND dep_sec + o < 93600 AS by_day FROM departures d JOIN visit USING (pattern_idx) LEFT JOIN night n ON n.mode = d.mode AND n.route = d.route)
SELECT stop_idx, count(DISTINCT route) AS lines, count(*) AS departures, coalesce(min(t) FILTER (by_day), min(t)) AS first_sec, coalesce(max(t) FILTER (by_day), max(t)) AS last_sec,
  round(CASE WHEN count(*) FILTER (t BETWEEN 25200 AND 32400) > 1 THEN (max(t) FILTER (t BETWEEN 25200 AND 32400) - min(t) FILTER (t BETWEEN 25200 AND 32400)) / (count(*) FILTER (t BETWEEN 25200 AND 32400) - 1) / 60 END, 6) AS headway_min FROM a GROUP BY 1""")
def _(t):
    night = schedule.night_lines(t.departures).where("is_night")
    return network.stop_page(t.departures, t.pattern_stops, night).withColumns(r6("headway_min"))


@query("agg_91_line_statistics", LENGTHS + """, o AS (SELECT mode, route, count(*) AS daily, min(dep_sec) AS first_sec, max(dep_sec) AS last_sec FROM departures GROUP BY 1, 2), b AS (
  SELECT mode, route, pattern_idx FROM (SELECT mode, route, pattern_idx, count(*) AS n FROM departures GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY mode, route ORDER BY n DESC, pattern_idx) = 1
)
SELECT mode, route, daily, first_sec, last_sec, round(km, 6) AS km, travel_sec FROM o JOIN b USING (mode, route) JOIN lengths USING (pattern_idx)""")
def _(t):
    shape = schedule.pattern_km(t.pattern_stops, t.stops)
    return network.line_statistics(t.departures, shape, schedule.busiest_patterns(t.departures)).withColumns(r6("km"))


SERVED = AREAS + f""", lines AS (SELECT DISTINCT pattern_idx, mode, route FROM departures), v AS (SELECT mode, route, count(DISTINCT {PIP('s')}) AS areas FROM lines JOIN pattern_stops USING (pattern_idx) JOIN stops s USING (stop_idx) GROUP BY 1, 2)
"""


def coverage(t: Tables) -> DataFrame:
    lines = t.departures.select("pattern_idx", "mode", "route").distinct()
    placed = spatial.containing(t.stops, areas(t), "stop_idx").select("stop_idx", "area")
    return network.line_coverage(t.pattern_stops.join(lines, "pattern_idx").join(placed, "stop_idx"))


@query("agg_53_line_coverage", SERVED + "SELECT * FROM v")
def _(t):
    return coverage(t)


@query("agg_53_coverage_by_mode", SERVED + "SELECT mode, count(*) AS lines, round(avg(areas), 6) AS avg_areas FROM v GROUP BY 1")
def _(t):
    return network.coverage_by_mode(coverage(t)).withColumns(r6("avg_areas"))


@query("agg_59_network_insights", """, h AS (SELECT floor(dep_sec / 3600.0)::BIGINT % 24 AS hour, route, mode FROM departures)
SELECT (SELECT hour FROM h GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour, (SELECT count(*) FROM h GROUP BY hour ORDER BY 1 DESC LIMIT 1) AS peak_departures,
  (SELECT route FROM h WHERE mode = 'TRAM' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS busiest_tram, count(*) FILTER (hour BETWEEN 4 AND 22) AS by_day, count(*) FILTER (hour < 4 OR hour >= 23) AS at_night FROM h""")
def _(t):
    return network.network_insights(t.departures)


MOVED = ", hours AS (SELECT o_custkey % 60 AS day, (o_orderkey % 24)::INT AS hour, 100 AS minutes, sum(o_orderkey % 4)::BIGINT AS moves FROM orders GROUP BY 1, 2)\n"


@query("agg_74_relocations", MOVED + """, g AS (SELECT day FROM hours GROUP BY 1 HAVING sum(minutes) >= 600), own AS (SELECT * FROM hours WHERE day IN (SELECT day FROM g))
SELECT count(DISTINCT day) AS days, sum(moves)::BIGINT AS moves, round(sum(moves) / count(DISTINCT day), 6) AS per_day, (SELECT hour FROM own GROUP BY 1 ORDER BY sum(moves) DESC, 1 LIMIT 1) AS busiest_hour FROM own""")
def _(t):
    key = F.col("o_orderkey")
    hours = t.orders.groupBy((F.col("o_custkey") % 60).alias("day"), (key % 24).cast("int").alias("hour")).agg(F.lit(100).alias("minutes"), F.sum(key % 4).alias("moves"))
    return network.relocation_summary(hours, 600).withColumns(r6("per_day"))


# --- joins and sets ----------------------------------------------------------


@query("join_12_left_and_inner", """, l AS (SELECT route_id, count(*) AS n FROM rt_obs GROUP BY 1), i AS (SELECT DISTINCT route_id, 'known' AS info FROM rt_obs WHERE route_id < 'p')
SELECT route_id, n, coalesce(info, 'unknown') AS info, info IS NOT NULL AS ranked FROM l LEFT JOIN i USING (route_id)""")
def _(t):
    live = t.rt_obs.groupBy("route_id").agg(F.count("*").alias("n"))
    info = t.rt_obs.where("route_id < 'p'").select("route_id", F.lit("known").alias("info")).distinct()
    return live.join(info, "route_id", "left").select("route_id", "n", F.coalesce("info", F.lit("unknown")).alias("info"), F.col("info").isNotNull().alias("ranked"))


@query("join_19_stop_names", """, f AS (SELECT route, min(pattern_idx) AS pattern_idx FROM departures GROUP BY 1), r AS (SELECT route, k AS stop_pos FROM (SELECT DISTINCT route FROM departures), range(10) x(k))
SELECT r.route, r.stop_pos, coalesce(s.name, 'Stop ' || (r.stop_pos + 1)) AS name FROM r JOIN f USING (route) LEFT JOIN pattern_stops p ON p.pattern_idx = f.pattern_idx AND p.stop_pos = r.stop_pos LEFT JOIN stops s USING (stop_idx)""")
def _(t):
    patterns = t.departures.select("route", "pattern_idx").distinct()
    rows = patterns.select("route").distinct().withColumn("stop_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return network.stop_names(rows, patterns, t.pattern_stops, t.stops).select("route", "stop_pos", "name")


@query("join_20_touching_areas", AREAS + """, m AS (SELECT ord, lat0 + 0.005 AS y0, lat1 + 0.005 AS y1, lon0 + 0.007 AS x0, lon1 + 0.007 AS x1 FROM areas)
SELECT a.ord AS a, m.ord AS b FROM areas a JOIN m ON a.lat0 < m.y1 AND m.y0 < a.lat1 AND a.lon0 < m.x1 AND m.x0 < a.lon1""")
def _(t):
    lat, lon = F.col("lat0") + 0.005, F.col("lon0") + 0.007
    moved = t.districts.select("ord", spatial.rectangle(lat, lon, lat + 0.0122, lon + 0.0166).alias("ring"))
    return network.touching_areas(areas(t), moved)


@query("join_11_pairs_of_departures", """, a AS (SELECT pattern_idx, route, count(*) AS n FROM departures GROUP BY 1, 2) SELECT x.pattern_idx AS one, y.pattern_idx AS two FROM a x JOIN a y ON x.route = y.route AND x.pattern_idx < y.pattern_idx""")
def _(t):
    one = t.departures.select("route", F.col("pattern_idx").alias("one")).distinct()
    return one.join(one.withColumnRenamed("one", "two"), "route").where("one < two").select("one", "two")


@query("set_04_united_sets", "SELECT route, array_to_string(list_sort(list(DISTINCT stop_idx)), ',') AS stops FROM (SELECT DISTINCT route, pattern_idx FROM departures) JOIN pattern_stops USING (pattern_idx) GROUP BY 1")
def _(t):
    own = t.pattern_stops.groupBy("pattern_idx").agg(F.collect_set("stop_idx").alias("s"))
    lines = t.departures.select("route", "pattern_idx").distinct().join(own, "pattern_idx")
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_list("s"))))
    return lines.groupBy("route").agg(F.array_join(united, ",").alias("stops"))


@query("set_05_without_near_doubles")
def _(t):
    hits = t.stations.select((F.col("station_id") % 5).alias("query"), "station_id", F.col("name").alias("title"), "lat", "lon")
    return network.without_near_doubles(hits, "query", "station_id", 0.01)


@query("set_06_lines_in_both", "SELECT route FROM departures WHERE dep_sec < 30000 INTERSECT SELECT route FROM departures WHERE dep_sec > 60000")
def _(t):
    return t.departures.where("dep_sec < 30000").select("route").intersect(t.departures.where("dep_sec > 60000").select("route"))


# --- registers and sources ---------------------------------------------------

PAGES = """, pages_ AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS street, p_type AS settlement, concat(p_size, CASE WHEN p_partkey % 4 = 0 THEN ' A' ELSE '' END) AS house, p_partkey AS ord FROM part)
"""


@query("src_15_address_register", PAGES + """, c AS (SELECT coalesce(street, settlement) AS street, settlement, lower(replace(house, ' ', '')) AS house, ord FROM pages_), f AS (SELECT DISTINCT street, settlement, house FROM c)
SELECT street, settlement, count(*) AS houses, array_to_string(list(house ORDER BY regexp_extract(house, '^[0-9]+')::INT, house), ',') AS numbers FROM f GROUP BY 1, 2""")
def _(t):
    key = F.col("p_partkey")
    house = F.concat(F.col("p_size").cast("string"), F.when(key % 4 == 0, F.lit(" A")).otherwise(F.lit("")))
    street = F.when(key % 9 != 0, F.col("p_brand"))
    pages = t.part.select(street.alias("street"), F.col("p_type").alias("settlement"), house.alias("house"), key.alias("ord"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return network.address_register(pages)


PLACES = [("school", "amenity", ["school", "kindergarten"]), ("health", "amenity", ["clinic", "pharmacy"]), ("shop", "shop", ["supermarket"]), ("sight", "tourism", ["museum"])]


@query("src_16_place_categories", """, k AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'school' WHEN 1 THEN 'clinic' WHEN 2 THEN 'bench' END AS amenity, CASE WHEN p_partkey % 3 = 0 THEN 'supermarket' END AS shop, CASE WHEN p_partkey % 7 = 0 THEN 'museum' END AS tourism FROM part)
SELECT id, CASE WHEN amenity = 'school' THEN 'school' WHEN amenity = 'clinic' THEN 'health' WHEN shop = 'supermarket' THEN 'shop' WHEN tourism = 'museum' THEN 'sight' END AS category FROM k""")
def _(t):
    i = F.col("p_partkey")
    amenity = F.when(i % 5 == 0, "school").when(i % 5 == 1, "clinic").when(i % 5 == 2, "bench")
    tags = F.create_map(F.lit("amenity"), amenity, F.lit("shop"), F.when(i % 3 == 0, "supermarket"), F.lit("tourism"), F.when(i % 7 == 0, "museum"))
    return t.part.select(i.alias("id"), tags.alias("tags")).select("id", network.place_category(F.col("tags"), PLACES).alias("category"))


@query("src_10_elevation", """, e AS (SELECT stop_idx, round((46 - lat) * 1200)::INT AS r, round((lon - 15) * 1200)::INT AS c FROM stops)
SELECT stop_idx, (CASE WHEN (r * 1201 + c) % 50 = 0 THEN 0 ELSE (r * 37 + c * 11) % 900 - 90 END)::INT AS elevation FROM e""")
def _(t):
    import numpy as np

    r, c = np.meshgrid(np.arange(1201), np.arange(1201), indexing="ij")
    metres = np.where((r * 1201 + c) % 50 == 0, -32768, (r * 37 + c * 11) % 900 - 90).astype(">i2")
    tiles = t.spark.createDataFrame([(45, 15, bytearray(metres.tobytes()))], "lat0 int, lon0 int, content binary")
    return network.elevation(t.stops.select("stop_idx", "lat", "lon"), tiles, 1201).select("stop_idx", F.col("elevation").cast("int").alias("elevation"))


@query("src_09_populated_cells", """, c AS (SELECT DISTINCT floor(lat / 0.003) AS y, floor(lon / 0.003) AS x FROM stations) SELECT DISTINCT (y + dy)::BIGINT AS cy, (x + dx)::BIGINT AS cx FROM c, range(-1, 2) a(dy), range(-1, 2) b(dx)""")
def _(t):
    return network.spread_cells(t.stations)


@query("snk_11_compressed_rows", """, e AS (SELECT pattern_idx AS src, stop_idx AS dst FROM pattern_stops), d AS (SELECT s.station_id AS node, count(e.dst) AS degree, coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '') AS targets FROM stations s LEFT JOIN e ON e.src = s.station_id GROUP BY 1)
SELECT node, degree, targets, (sum(degree) OVER (ORDER BY node) - degree)::BIGINT AS first FROM d""")
def _(t):
    edges = t.pattern_stops.select(F.col("pattern_idx").alias("src"), F.col("stop_idx").alias("dst"))
    return network.compressed_rows(edges, t.stations.select(F.col("station_id").alias("node")), 16)


@query("win_02_running_totals", "SELECT o_orderkey AS id, (sum(o_custkey) OVER (ORDER BY o_orderkey) - o_custkey)::BIGINT AS before FROM orders")
def _(t):
    return network.running_total(t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey"), "id", "o_custkey", 512).select("id", "before")


# --- geometry ----------------------------------------------------------------

LINES = f""", pts AS (SELECT p.pattern_idx, p.stop_pos AS pos, s.lat, s.lon FROM pattern_stops p JOIN stops s USING (stop_idx)), lg AS (
  SELECT pattern_idx, pos, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pts WINDOW w AS (PARTITION BY pattern_idx ORDER BY pos)
), legs AS (SELECT * FROM lg WHERE lat2 IS NOT NULL)
"""
TO_LEG = f"""sqrt(pow((p.lon - l.lon1) * {G.LON_SHARE}::DOUBLE - u * (l.lon2 - l.lon1) * {G.LON_SHARE}::DOUBLE, 2) + pow(p.lat - l.lat1 - u * (l.lat2 - l.lat1), 2)) * {G.KM_PER_DEGREE}::DOUBLE"""


def line_points(t: Tables) -> DataFrame:
    return t.pattern_stops.join(t.stops.select("stop_idx", "lat", "lon"), "stop_idx").select("pattern_idx", F.col("stop_pos").alias("pos"), "lat", "lon")


def line_legs(t: Tables) -> DataFrame:
    w = W.partitionBy("pattern_idx").orderBy("pos")
    own = line_points(t).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")
    return own.select("pattern_idx", "pos", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2")


@query("geo_07_simplified")
def _(t):
    return network.simplified(line_points(t), "pattern_idx", 0.01)


@query("geo_09_clipped", LINES + f""", c AS (SELECT DISTINCT pattern_idx, 45.78::DOUBLE AS lat, 15.88::DOUBLE AS lon FROM pts), m AS (SELECT pts.*, {KM('pts', 'c')} AS d FROM pts JOIN c USING (pattern_idx)),
g AS (SELECT *, sum(CASE WHEN d > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY pattern_idx ORDER BY pos) AS g FROM m), n AS (SELECT pattern_idx, g AS home FROM g QUALIFY row_number() OVER (PARTITION BY pattern_idx ORDER BY d, pos) = 1)
SELECT pattern_idx, pos, lat, lon FROM g JOIN n USING (pattern_idx) WHERE d <= 2.5 AND g = home AND (SELECT min(d) FROM m WHERE m.pattern_idx = g.pattern_idx) <= 2.5""")
def _(t):
    centres = t.pattern_stops.select("pattern_idx", F.lit(45.78).alias("clat"), F.lit(15.88).alias("clon")).distinct()
    return network.clipped(line_points(t), centres, "pattern_idx", 2.5)


@query("geo_10_line_difference", LINES + f""", p AS (SELECT stop_idx % 40 AS pattern_idx, stop_idx AS point_id, lat, lon FROM stops),
x AS (SELECT p.pattern_idx, point_id, p.lat, p.lon, l.lat1, l.lon1, l.lat2, l.lon2, pow((lon2 - lon1) * {G.LON_SHARE}::DOUBLE, 2) + pow(lat2 - lat1, 2) AS size,
  (p.lon - lon1) * {G.LON_SHARE}::DOUBLE * (lon2 - lon1) * {G.LON_SHARE}::DOUBLE + (p.lat - lat1) * (lat2 - lat1) AS along FROM p JOIN legs l USING (pattern_idx)),
y AS (SELECT *, CASE WHEN size > 0 THEN least(greatest(along / size, 0), 1) ELSE 0 END AS u FROM x),
d AS (SELECT p.pattern_idx, p.point_id, min({TO_LEG.replace("l.", "p.")}) AS d FROM y p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern_idx ORDER BY d, point_id) - 1 AS i, count(*) OVER (PARTITION BY pattern_idx) AS n FROM d)
SELECT pattern_idx, round(d, 6) AS p90_km FROM r WHERE i = floor(n * 0.9::DOUBLE)::INT""")
def _(t):
    points = t.stops.select((F.col("stop_idx") % 40).alias("pattern_idx"), F.col("stop_idx").alias("point_id"), "lat", "lon")
    return network.line_difference(points, line_legs(t), "pattern_idx").withColumns(r6("p90_km"))


@query("geo_11_cells_on_lines", LINES + """, q AS (SELECT pattern_idx, pos * 100.0::DOUBLE AS s1, pos * 100.0::DOUBLE + 100 AS s2, floor(lat1 / 0.002::DOUBLE) AS y, floor(lon1 / 0.002::DOUBLE) AS x, floor(lat2 / 0.002::DOUBLE) - floor(lat1 / 0.002::DOUBLE) AS dy, floor(lon2 / 0.002::DOUBLE) - floor(lon1 / 0.002::DOUBLE) AS dx FROM legs),
n AS (SELECT *, greatest(abs(dy), abs(dx), 1)::BIGINT AS n FROM q), i AS (SELECT *, unnest(range(n + 1)) AS i FROM n)
SELECT pattern_idx, (y + floor(dy * (i / n) + 0.5))::BIGINT AS cy, (x + floor(dx * (i / n) + 0.5))::BIGINT AS cx, round(min(s1 + (s2 - s1) * (i / n)), 6) AS sec FROM i GROUP BY 1, 2, 3""")
def _(t):
    start = F.col("pos").cast("double") * 100
    return network.cells_on_line(line_legs(t).withColumns({"sec1": start, "sec2": start + 100}), ["pattern_idx"]).withColumns(r6("sec"))


@query("geo_15_mercator", "SELECT stop_idx, round(radians(lon) * 6378137.0::DOUBLE, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE, 3) AS y, round(lat * 1e6) / 1e6 AS lat, round(lon * 1e6) / 1e6 AS lon FROM stops")
def _(t):
    x, y = network.mercator(F.col("lat"), F.col("lon"))
    return t.stops.select("stop_idx", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), N.round_to(F.col("lat"), 6).alias("lat"), N.round_to(F.col("lon"), 6).alias("lon"))


TWO_FEEDS = ", l AS (SELECT DISTINCT pattern_idx, route FROM departures), old AS (SELECT route, pattern_idx % 2 AS direction, stop_pos, stop_idx FROM pattern_stops JOIN l USING (pattern_idx)), new AS (SELECT route, direction, stop_pos, stop_idx FROM old WHERE stop_pos < 6)\n"


@query("geo_17_route_difference", TWO_FEEDS + f""", a AS (SELECT route, direction, list(DISTINCT stop_idx) AS s, arg_max(stop_idx, stop_pos) AS last FROM old GROUP BY 1, 2), b AS (SELECT route, direction, list(DISTINCT stop_idx) AS s, arg_max(stop_idx, stop_pos) AS last FROM new GROUP BY 1, 2),
m AS (SELECT route, direction, len(list_filter(b.s, lambda x: NOT list_contains(a.s, x)))::INT AS added, len(list_filter(a.s, lambda x: NOT list_contains(b.s, x)))::INT AS removed, {KM('x', 'y')} AS km FROM a JOIN b USING (route, direction) JOIN stops x ON x.stop_idx = a.last JOIN stops y ON y.stop_idx = b.last)
SELECT route, direction, added, removed, round(km, 6) AS moved_km, CASE WHEN km > 0.3 THEN 'terminus' WHEN added + removed > 0 THEN 'stops' ELSE 'same' END AS change FROM m QUALIFY row_number() OVER (PARTITION BY route ORDER BY km * 1000 + 200 * (added + removed) DESC, direction) = 1""")
def _(t):
    lines = t.departures.select("pattern_idx", "route").distinct()
    # one pattern for each route and direction, so that a position has one stop
    old = t.pattern_stops.join(lines, "pattern_idx").select("route", (F.col("pattern_idx") % 2).alias("direction"), "stop_pos", "stop_idx")
    return network.route_difference(old, old.where("stop_pos < 6"), t.stops).withColumns(r6("moved_km"))


@query("flt_12_worth_a_map", """, d AS (SELECT trip_id AS id, CASE WHEN trip_id % 5 = 0 THEN 'terminus' ELSE 'stops' END AS change, (trip_id % 4)::INT AS added, (trip_id % 3)::INT AS removed, (trip_id % 11) / 10.0::DOUBLE AS len_old_km, (trip_id % 7) / 10.0::DOUBLE AS len_new_km, (trip_id % 300)::INT AS span_days FROM trips)
SELECT id FROM d WHERE (change = 'terminus' OR added + removed >= 3 OR abs(len_new_km - len_old_km) >= 0.6::DOUBLE) AND NOT (span_days > 150 AND added > 0 AND removed > 0)""")
def _(t):
    i = F.col("trip_id")
    diffs = t.trips.select(
        i.alias("id"), F.when(i % 5 == 0, "terminus").otherwise("stops").alias("change"), (i % 4).alias("added"), (i % 3).alias("removed"),
        ((i % 11) / 10.0).alias("len_old_km"), ((i % 7) / 10.0).alias("len_new_km"), (i % 300).alias("span_days"),
    )
    return changes.worth_a_map(diffs).select("id")


@query("flt_16_bands", "SELECT CASE WHEN score >= 70 THEN 'excellent' WHEN score >= 50 THEN 'good' WHEN score >= 25 THEN 'fair' ELSE 'poor' END AS band, count(*) AS districts, sum(population)::BIGINT AS population FROM scores GROUP BY 1")
def _(t):
    return districts.bands(t.scores)


@query("geo_02_haversine", "SELECT stop_idx, round(12742 * asin(sqrt(pow(sin(radians(lat - 45.8) / 2), 2) + cos(radians(45.8)) * cos(radians(lat)) * pow(sin(radians(lon - 15.9) / 2), 2))), 6) AS km FROM stops")
def _(t):
    return t.stops.select("stop_idx", F.round(G.haversine_km(F.lit(45.8), F.lit(15.9), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("geo_05_points_in_rings", AREAS + f"SELECT count(*) AS points, count({PIP('s')}) AS inside FROM stops s")
def _(t):
    placed = spatial.containing(t.stops, areas(t), "stop_idx")
    return placed.agg(F.count("*").alias("points"), F.count("area_ord").alias("inside"))


@query("geo_16_reach_km2", "SELECT n_nationkey AS id, round(n_nationkey * 0.0346::DOUBLE, 6) AS km2 FROM nation")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("id"), F.round(G.reach_km2(F.col("n_nationkey")), 6).alias("km2"))


# --- reach on maps -----------------------------------------------------------


# --- texts and small rules ---------------------------------------------------


@query("fn_07_snapped", "SELECT stop_idx, round(lat * 1000) / 1000 AS lat, round(lon * 1000) / 1000 AS lon FROM stops")
def _(t):
    return t.stops.select("stop_idx", N.round_to(F.col("lat"), 3).alias("lat"), N.round_to(F.col("lon"), 3).alias("lon"))


@query("fn_21_station_names")
def _(t):
    raw = F.concat_ws(" ", F.upper("p_brand"), F.lit("TRG KRALJA - ULICA KBC"), F.upper("p_type"))
    return t.part.select("p_partkey", T.station_name(raw).alias("name"))


@query("fn_25_preferred_route", "SELECT stop_idx, arg_min(route, CASE mode WHEN 'TRAM' THEN 0 WHEN 'BUS' THEN 1 ELSE 2 END * 1000 + substr(route, 2)::INT) AS route FROM pattern_stops JOIN (SELECT DISTINCT pattern_idx, mode, route FROM departures) USING (pattern_idx) GROUP BY 1")
def _(t):
    lines = t.departures.select("pattern_idx", "mode", "route").distinct()
    place = F.array_position(F.array(F.lit("TRAM"), F.lit("BUS"), F.lit("RAIL")), F.col("mode"))
    return t.pattern_stops.join(lines, "pattern_idx").groupBy("stop_idx").agg(F.min_by("route", place * 1000 + F.substring("route", 2, 9).cast("int")).alias("route"))


@query("fn_28_place_kinds", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'stop' WHEN p_size % 3 = 0 THEN 'street' ELSE 'place' END AS kind FROM part""")
def _(t):
    tags = F.create_map(F.lit("railway"), F.when(F.col("p_size") % 4 == 0, "tram_stop"), F.lit("highway"), F.when(F.col("p_size") % 3 == 0, "residential"))
    return t.part.select(F.col("p_partkey").alias("id"), T.place_kind(tags).alias("kind"))


@query("fn_29_walk_minutes", "SELECT p_partkey AS id, greatest(1, floor(p_size * 31 / 75.0::DOUBLE + 0.5))::BIGINT AS minutes FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.greatest(F.lit(1), N.js_round(F.col("p_size") * 31 / 75.0)).cast("long").alias("minutes"))


@query("fn_32_json", "SELECT n_nationkey AS id, n_name AS name, n_nationkey * 2 AS value FROM nation")
def _(t):
    text = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 2).alias("value")))
    kind = t.nation.schema["n_nationkey"].dataType.simpleString()
    return t.nation.select(F.from_json(text, f"id {kind}, name string, value {kind}").alias("x")).select("x.*")


@query("sort_06_croatian_order", "SELECT name, row_number() OVER (ORDER BY translate(name, 'abcčćdđefghijklmnopqrsštuvwxyzž', '0123456789:;<=>?@ABCDEFGHIJKLMN'), name)::INT AS place FROM (SELECT DISTINCT translate(lower(p_name), 'sz', 'šž') AS name FROM part)")
def _(t):
    names = t.part.select(F.translate(F.lower("p_name"), "sz", "šž").alias("name")).distinct()
    return ordered.ranked(names, T.croatian_order(F.col("name")), "name", out="place")


@query("sort_02_numbers_first", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 999 ELSE o_orderkey % 100 END, o_orderkey)::INT AS place FROM orders")
def _(t):
    name = F.when(F.col("o_orderkey") % 3 == 0, F.lit("N")).otherwise((F.col("o_orderkey") % 100).cast("string"))
    return ordered.ranked(t.orders, F.coalesce(name.try_cast("int"), F.lit(999)), "o_orderkey", out="place", by=["o_custkey"]).select(F.col("o_orderkey").alias("id"), "place")


@query("fn_03_folded", "SELECT p_partkey AS id, translate(lower(p_name || ' ČĆŠŽĐ'), 'čćšžđ', 'ccszd') AS folded FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), T.fold(F.concat("p_name", F.lit(" ČĆŠŽĐ"))).alias("folded"))


@query("fn_06_clock_seconds", "SELECT p_partkey AS id, (CASE WHEN p_size % 26 < 24 THEN round((p_size % 26 * 3600 + p_partkey % 60 * 60) / 300.0::DOUBLE) * 300 ELSE 28800 END)::BIGINT AS sec FROM part")
def _(t):
    clock = F.concat_ws(":", (F.col("p_size") % 26).cast("string"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"))
    return t.part.select(F.col("p_partkey").alias("id"), N.clock_seconds(clock).alias("sec"))


@query("fn_09_spread", "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1")
def _(t):
    own = t.events.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return own.withColumns(r6("mean", "deviation"))


@query("fn_11_time_buckets", "SELECT event_id, (floor((event_id - 500) / 300.0::DOUBLE) * 300)::BIGINT AS bucket FROM events")
def _(t):
    return t.events.select("event_id", N.floor_to(F.col("event_id") - 500, 300).cast("long").alias("bucket"))


@query("fn_13_modes", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'TRAM' WHEN 2 THEN 'RAIL' ELSE 'BUS' END AS mode FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), T.code_name(F.col("p_partkey") % 5, T.ROUTE_TYPES, "BUS").alias("mode"))


@query("fn_14_without_prefix", "SELECT p_partkey AS id, p_name || ':x' AS name FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), T.without_prefix(F.concat(F.lit("feed:"), "p_name", F.lit(":x"))).alias("name"))


@query("fn_31_headlines", "SELECT p_partkey AS id, 'Promjena trase ' || p_size AS title FROM part")
def _(t):
    raw = F.concat(F.lit("  OBAVIJEST: privremena PROMJENA   TRASE "), F.col("p_size").cast("string"), F.lit(" ."))
    return t.part.select(F.col("p_partkey").alias("id"), T.headline(raw).alias("title"))


# --- windows and streams -----------------------------------------------------


@query("win_03_ranked", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders")
def _(t):
    return ordered.ranked(t.orders, F.desc("o_totalprice"), "o_orderkey", by=["o_custkey"]).select(F.col("o_orderkey").alias("id"), "rank")


@query("win_07_filled_offsets", "SELECT pattern_idx, stop_pos, last_value(CASE WHEN stop_pos % 3 <> 1 THEN offset_sec END IGNORE NULLS) OVER (PARTITION BY pattern_idx ORDER BY stop_pos) AS offset_sec FROM pattern_stops")
def _(t):
    w = W.partitionBy("pattern_idx").orderBy("stop_pos")
    some = F.when(F.col("stop_pos") % 3 != 1, F.col("offset_sec"))
    return t.pattern_stops.select("pattern_idx", "stop_pos", F.last(some, ignorenulls=True).over(w).alias("offset_sec"))


@query("win_11_line_length", LINES + f"SELECT pattern_idx, pos, round(sum(sqrt(pow((lat2 - lat1) * {G.KM_PER_DEGREE}::DOUBLE, 2) + pow((lon2 - lon1) * {G.KM_PER_DEGREE * G.LON_SHARE}::DOUBLE, 2))) OVER (PARTITION BY pattern_idx ORDER BY pos), 6) AS km FROM legs")
def _(t):
    w = W.partitionBy("pattern_idx").orderBy("pos")
    return line_legs(t).select("pattern_idx", "pos", F.round(F.sum(G.flat_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).over(w), 6).alias("km"))


@query("win_13_feed_pairs", ", f AS (SELECT DISTINCT day - day % 90 AS feed_day FROM trips) SELECT feed_day, lead(feed_day) OVER (ORDER BY feed_day) AS next_day FROM f QUALIFY next_day IS NOT NULL")
def _(t):
    feeds = t.trips.select((F.col("day") - F.col("day") % 90).alias("feed_day"), F.lit(0).alias("one")).distinct()
    return ordered.gaps_of(feeds, ["one"], "feed_day").select("feed_day", (F.col("feed_day") + F.col("gap")).alias("next_day"))


@query("str_04_five_minute_branch", "SELECT ts, route_id, count(*) AS n FROM rt_obs WHERE ts % 300 = 0 GROUP BY 1, 2")
def _(t):
    return t.rt_obs.where("ts % 300 = 0").groupBy("ts", "route_id").agg(F.count("*").alias("n"))


@query("str_11_feed_age", "SELECT route_id, (SELECT max(ts) FROM rt_obs) - max(ts) AS age_sec, (SELECT max(ts) FROM rt_obs) - max(ts) > 120 AS stale FROM rt_obs GROUP BY 1")
def _(t):
    newest = t.rt_obs.agg(F.max("ts").alias("now"))  # one row
    own = t.rt_obs.groupBy("route_id").agg(F.max("ts").alias("last")).crossJoin(newest)
    return own.select("route_id", (F.col("now") - F.col("last")).alias("age_sec"), (F.col("now") - F.col("last") > 120).alias("stale"))
