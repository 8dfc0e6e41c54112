"""Queries of the timetable statistics and of feed comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import KM_PER_DEGREE, LON_SHARE
from ..operators import ordered
from ..plans import changes, schedule
from ..queries import query, r6
from ..sources import gtfs
from . import Tables

KM = lambda a, b: f"sqrt(pow(({b}.lat - {a}.lat) * {KM_PER_DEGREE}::DOUBLE, 2) + pow(({b}.lon - {a}.lon) * {KM_PER_DEGREE * LON_SHARE}::DOUBLE, 2))"

BUSIEST = """, counted AS (SELECT mode, route, pattern_idx, count(*) AS n, min(dep_sec) AS first_sec, max(dep_sec) AS last_sec FROM departures GROUP BY ALL), busiest AS (
  SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY mode, route ORDER BY n DESC, pattern_idx) = 1)
"""
LENGTHS = f""", legs AS (SELECT p.pattern_idx, p.stop_pos, p.offset_sec, s.lat, s.lon, lag(s.lat) OVER w AS lat0, lag(s.lon) OVER w AS lon0 FROM pattern_stops p JOIN stops s USING (stop_idx) WINDOW w AS (PARTITION BY pattern_idx ORDER BY stop_pos)), lengths AS (
  SELECT pattern_idx, count(*) AS n_stops, coalesce(sum(sqrt(pow((lat - lat0) * {KM_PER_DEGREE}::DOUBLE, 2) + pow((lon - lon0) * {KM_PER_DEGREE * LON_SHARE}::DOUBLE, 2))), 0) AS km, max(offset_sec) AS travel_sec,
    sqrt(pow((arg_max(lat, stop_pos) - arg_min(lat, stop_pos)) * {KM_PER_DEGREE}::DOUBLE, 2) + pow((arg_max(lon, stop_pos) - arg_min(lon, stop_pos)) * {KM_PER_DEGREE * LON_SHARE}::DOUBLE, 2)) AS straight_km FROM legs GROUP BY 1)
"""
LONGEST = ", longest AS (SELECT c.mode, c.route, l.* FROM counted c JOIN lengths l USING (pattern_idx) QUALIFY row_number() OVER (PARTITION BY c.mode, c.route ORDER BY l.km DESC, pattern_idx) = 1)\n"


def lengths(t: Tables) -> DataFrame:
    return schedule.pattern_km(t.pattern_stops, t.stops)


@query("agg_03_route_stats", BUSIEST + LENGTHS + """SELECT c.mode, c.route, round(max(km) * 100) / 100 AS km, max(n_stops) AS stops, max(travel_sec) AS travel_sec, count(*) AS patterns, any_value(b.n) AS departures, any_value(b.first_sec) AS first_sec, any_value(b.last_sec) AS last_sec,
  CASE WHEN max(travel_sec) > 0 THEN round(max(km) / (max(travel_sec) / 3600) * 10) / 10 END AS speed_kmh FROM counted c JOIN lengths l USING (pattern_idx) JOIN busiest b ON b.mode = c.mode AND b.route = c.route GROUP BY 1, 2""")
def _(t):
    return schedule.route_stats(t.departures, t.pattern_stops, t.stops)


@query("agg_04_counts_by_mode", """SELECT count(*) AS routes, count(*) FILTER (mode = 'TRAM') AS tram, count(*) FILTER (mode = 'BUS') AS bus, count(*) FILTER (mode = 'RAIL') AS rail, sum(n)::BIGINT AS departures FROM (SELECT mode, route, count(*) AS n FROM departures GROUP BY 1, 2)""")
def _(t):
    return schedule.counts_by_mode(t.departures.groupBy("mode", "route").agg(F.count("*").alias("departures")))


@query("agg_06_hourly", """, r AS (SELECT DISTINCT mode, route FROM departures), n AS (SELECT mode, route, least(floor(dep_sec / 3600.0), 23)::INT AS hour, count(*) AS n FROM departures GROUP BY 1, 2, 3)
SELECT r.mode, r.route, h.hour, floor(coalesce(n.n, 0) / 7.0::DOUBLE + 0.5)::BIGINT AS n FROM r CROSS JOIN (SELECT unnest(range(24))::INT AS hour) h LEFT JOIN n ON n.mode = r.mode AND n.route = r.route AND n.hour = h.hour""")
def _(t):
    return schedule.hourly(t.departures, 7)


@query("agg_07_peak_to_base", """, n AS (SELECT mode, route, least(floor(dep_sec / 3600.0), 23)::INT AS hour, count(*) AS n FROM departures GROUP BY 1, 2, 3), r AS (SELECT DISTINCT mode, route FROM departures),
d AS (SELECT r.mode, r.route, h.hour, coalesce(n.n, 0) AS n FROM r CROSS JOIN (SELECT unnest(range(24))::INT AS hour) h LEFT JOIN n ON n.mode = r.mode AND n.route = r.route AND n.hour = h.hour)
SELECT mode, route, max(n) FILTER (hour IN (7, 8)) AS peak, round(avg(n) FILTER (hour BETWEEN 10 AND 14) * 10) / 10 AS base, round(max(n) FILTER (hour IN (7, 8)) / avg(n) FILTER (hour BETWEEN 10 AND 14) * 100) / 100 AS ratio FROM d GROUP BY 1, 2 HAVING avg(n) FILTER (hour BETWEEN 10 AND 14) > 0.5""")
def _(t):
    return schedule.peak_to_base(schedule.hourly(t.departures))


@query("agg_08_vehicle_km", BUSIEST + LENGTHS + "SELECT CASE WHEN mode IN ('TRAM', 'RAIL') THEN mode ELSE 'BUS' END AS mode, round(sum(n / 7.0::DOUBLE * km), 4) AS vehicle_km FROM counted JOIN lengths USING (pattern_idx) GROUP BY 1")
def _(t):
    return schedule.vehicle_km(t.departures, lengths(t), 7).withColumn("vehicle_km", F.round("vehicle_km", 4))


@query("agg_09_pattern_length", LENGTHS + "SELECT pattern_idx, n_stops, round(km, 6) AS km, travel_sec, round(straight_km, 6) AS straight_km FROM lengths")
def _(t):
    return lengths(t).withColumns(r6("km", "straight_km"))


@query("agg_10_tortuosity", BUSIEST + LENGTHS + LONGEST + "SELECT mode, route, round(km / straight_km * 100) / 100 AS tortuosity FROM longest WHERE straight_km >= 0.1")
def _(t):
    return schedule.tortuosity(t.departures, lengths(t))


@query("agg_11_stop_spacing", BUSIEST + LENGTHS + LONGEST + f"""SELECT mode, route, n_stops, round(avg(m))::BIGINT AS avg_m, round(min(m))::BIGINT AS min_m, round(max(m))::BIGINT AS max_m, round(stddev_pop(m) / avg(m) * 100) / 100 AS cv FROM (
  SELECT g.mode, g.route, g.n_stops, sqrt(pow((l.lat - lat0) * {KM_PER_DEGREE}::DOUBLE, 2) + pow((l.lon - lon0) * {KM_PER_DEGREE * LON_SHARE}::DOUBLE, 2)) * 1000 AS m FROM longest g JOIN legs l USING (pattern_idx) WHERE lat0 IS NOT NULL) GROUP BY 1, 2, 3""")
def _(t):
    return schedule.stop_spacing(t.departures, t.pattern_stops, t.stops)


@query("agg_12_dead_ends", ", l AS (SELECT DISTINCT p.stop_idx, d.mode, d.route FROM pattern_stops p JOIN (SELECT DISTINCT pattern_idx, mode, route FROM departures) d USING (pattern_idx)) SELECT stop_idx, min(mode) AS mode, min(route) AS route FROM l GROUP BY 1 HAVING count(*) = 1")
def _(t):
    return schedule.dead_ends(t.departures, t.pattern_stops)


@query("agg_13_fleet", """SELECT block_id, count(DISTINCT route_id) AS routes, arg_min(mode, trip_id) AS mode, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS route_list, count(DISTINCT route_id) > 1 AS interlined FROM trips WHERE block_id IS NOT NULL AND dow BETWEEN 1 AND 5 GROUP BY 1""")
def _(t):
    return schedule.fleet(t.trips)


@query("agg_14_weekend_service", """, n AS (SELECT route_id, count(*) FILTER (dow BETWEEN 1 AND 5) AS weekday, count(*) FILTER (dow = 6) AS saturday, count(*) FILTER (dow = 0) AS sunday FROM trips WHERE route_id <> 'R3' OR dow BETWEEN 1 AND 5 GROUP BY 1)
SELECT *, weekday > 0 AND saturday + sunday = 0 AS weekday_only FROM n""")
def _(t):
    return schedule.weekend_service(t.trips.where("route_id <> 'R3' or dow between 1 and 5"))


@query("agg_15_asymmetry", """, n AS (SELECT route_id, count(*) FILTER (direction = 0) AS out, count(*) FILTER (direction = 1) AS back FROM trips WHERE dow BETWEEN 1 AND 5 GROUP BY 1)
SELECT route_id, out, back, round(least(out, back) / greatest(out, back) * 100) / 100 AS ratio FROM n WHERE out + back >= 4 AND out > 0 AND back > 0 AND least(out, back) / greatest(out, back) < 0.8""")
def _(t):
    return schedule.asymmetry(t.trips)


SPAN = """, ends AS (SELECT pattern_idx, mode, min(dep_sec) AS a, max(dep_sec) AS b FROM departures GROUP BY 1, 2), span AS (SELECT stop_idx, min(a + offset_sec) AS first_sec, max(b + offset_sec) AS last_sec, bool_or(mode = 'TRAM') AS tram, bool_or(mode = 'BUS') AS bus, bool_or(mode = 'RAIL') AS rail FROM pattern_stops JOIN ends USING (pattern_idx) GROUP BY 1)
"""


def span(t: Tables) -> DataFrame:
    return schedule.service_span(t.departures, t.pattern_stops)


@query("agg_16_service_span", SPAN + "SELECT * FROM span")
def _(t):
    return span(t)


@query("agg_17_span_histogram", SPAN + """SELECT kind, half_hour, count(*) AS n, count(*) FILTER (tram) AS tram FROM (SELECT 'first' AS kind, least(greatest(floor(first_sec / 1800.0), 6), 15)::INT AS half_hour, tram FROM span UNION ALL SELECT 'last', least(greatest(floor(last_sec / 1800.0), 38), 51)::INT, tram FROM span) GROUP BY 1, 2""")
def _(t):
    return schedule.span_histogram(span(t))


@query("agg_18_mode_span", """SELECT mode, min(dep_sec) FILTER (dep_sec BETWEEN 10800 AND 36000) AS morning_sec, max(dep_sec) FILTER (dep_sec BETWEEN 64800 AND 90000) AS evening_sec, count(DISTINCT route) FILTER (dep_sec < 18000) AS early_routes, count(DISTINCT route) FILTER (dep_sec > 86400) AS late_routes FROM departures GROUP BY 1""")
def _(t):
    return schedule.mode_span(t.departures)


@query("agg_19_night_gap", SPAN + """SELECT count(*) AS stops, count(*) FILTER (last_sec < 79200) AS dark_22, count(*) FILTER (last_sec < 82800) AS dark_23, round(count(*) FILTER (last_sec < 79200) / count(*) * 1000) / 10 AS pct_22, round(count(*) FILTER (last_sec < 82800) / count(*) * 1000) / 10 AS pct_23 FROM span""")
def _(t):
    return schedule.night_gap(span(t))


@query("agg_21_mean_headway", "SELECT mode, route, count(*) AS n, round((max(dep_sec) - min(dep_sec)) / (count(*) - 1) / 60, 6) AS headway_min FROM departures WHERE dep_sec BETWEEN 25200 AND 32400 GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return schedule.mean_headway(t.departures, ["mode", "route"], 25200, 32400).withColumns(r6("headway_min"))


@query("agg_22_headway_variation", BUSIEST + """, g AS (SELECT d.mode, d.route, lead(dep_sec) OVER (PARTITION BY d.pattern_idx ORDER BY dep_sec) - dep_sec AS gap FROM departures d JOIN busiest b USING (pattern_idx) WHERE dep_sec BETWEEN 25200 AND 32400)
SELECT mode, route, round(stddev_pop(gap) / avg(gap), 6) AS cv FROM g WHERE gap IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 AND avg(gap) >= 1""")
def _(t):
    return schedule.headway_variation(t.departures).withColumns(r6("cv"))


FIRST_VISIT = ", visit AS (SELECT pattern_idx, stop_idx, offset_sec FROM pattern_stops QUALIFY row_number() OVER (PARTITION BY pattern_idx, stop_idx ORDER BY stop_pos) = 1)\n"


@query("agg_23_district_headway", FIRST_VISIT + """, g AS (SELECT v.stop_idx, d.pattern_idx, (max(dep_sec + offset_sec) - min(dep_sec + offset_sec)) / (count(*) - 1) AS gap FROM departures d JOIN visit v USING (pattern_idx) WHERE dep_sec + offset_sec BETWEEN 27000 AND 30600 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT kvart, floor(quantile_cont(gap, 0.5) / 60 + 0.5)::BIGINT AS headway_min, count(*) AS samples FROM g JOIN stops USING (stop_idx) GROUP BY 1""")
def _(t):
    return schedule.district_headway(t.departures, t.pattern_stops, t.stops)


@query("agg_30_dominant_headsign", "SELECT route_id, direction, headsign, count(*) AS n, min(trip_id) AS trip_id FROM trips GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY route_id, direction ORDER BY count(*) DESC, min(trip_id)) = 1")
def _(t):
    return changes.representative_trips(t.trips)


@query("agg_31_dominant_pattern", "SELECT route_id, direction, headsign, count(*) FILTER (dow BETWEEN 1 AND 5) AS weekday, count(*) AS trips FROM trips GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY route_id, direction ORDER BY count(*) FILTER (dow BETWEEN 1 AND 5) DESC, count(*) DESC, headsign DESC) = 1")
def _(t):
    return schedule.dominant_patterns(t.trips)


@query("agg_32_night_lines", "SELECT mode, route, count(*) FILTER (h < 4 OR h >= 23) AS night, count(*) FILTER (h >= 4 AND h < 23) AS day, count(*) FILTER (h < 4 OR h >= 23) > count(*) FILTER (h >= 4 AND h < 23) AS is_night FROM (SELECT *, floor(dep_sec / 3600.0)::INT % 24 AS h FROM departures) GROUP BY 1, 2")
def _(t):
    return schedule.night_lines(t.departures)


@query("agg_33_terminal_departures", BUSIEST + f""", a AS (SELECT p.pattern_idx, s.lat, s.lon FROM pattern_stops p JOIN stops s USING (stop_idx) WHERE stop_pos = 0), m AS (SELECT b.mode, b.route, a.lat, a.lon FROM busiest b JOIN a USING (pattern_idx))
SELECT d.mode, d.route, d.dep_sec FROM departures d JOIN a USING (pattern_idx) JOIN m ON m.mode = d.mode AND m.route = d.route WHERE {KM('a', 'm')} <= 0.15""")
def _(t):
    return schedule.terminal_departures(t.departures, t.pattern_stops, t.stops)


@query("agg_34_timetable_rows", "SELECT mode, route, floor(dep_sec / 3600.0)::INT AS hour, string_agg(floor(dep_sec % 3600 / 60.0)::INT::VARCHAR, ',' ORDER BY floor(dep_sec % 3600 / 60.0)::INT) AS minutes FROM departures GROUP BY 1, 2, 3")
def _(t):
    return schedule.timetable_rows(t.departures, ["mode", "route"])


GAPS = ", g AS (SELECT mode, route, lead(dep_sec) OVER (PARTITION BY mode, route ORDER BY dep_sec) - dep_sec AS gap FROM departures WHERE dep_sec BETWEEN 23400 AND 34200), h AS (SELECT * FROM g WHERE gap IS NOT NULL)\n"


@query("agg_37_gap_range", GAPS + "SELECT mode, route, greatest(round(quantile_cont(gap, 0.25) / 60), 1)::BIGINT AS lo, greatest(round(quantile_cont(gap, 0.75) / 60), greatest(round(quantile_cont(gap, 0.25) / 60), 1))::BIGINT AS hi FROM h GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t):
    return schedule.gap_range(t.departures, ["mode", "route"], 23400, 34200)


@query("agg_38_peak_range", GAPS + "SELECT mode, route, round(list_sort(list(gap))[floor(count(*) * 0.2)::INT + 1] / 60.0::DOUBLE, 6) AS lo, round(list_sort(list(gap))[floor(count(*) * 0.8)::INT + 1] / 60.0::DOUBLE, 6) AS hi FROM h GROUP BY 1, 2 HAVING count(*) >= 3")
def _(t):
    return schedule.peak_range(t.departures, ["mode", "route"]).withColumns(r6("lo", "hi"))


@query("agg_84_folded_hours", "SELECT mode, route, (floor(dep_sec / 3600.0)::INT % 24)::INT AS hour, count(*) AS n FROM departures GROUP BY 1, 2, 3")
def _(t):
    return schedule.folded_hours(t.departures, ["mode", "route"])


@query("agg_85_most_frequent", """, p AS (SELECT mode, route, (max(dep_sec) - min(dep_sec)) / (count(*) - 1) / 60 AS h FROM departures WHERE dep_sec BETWEEN 25200 AND 32400 GROUP BY 1, 2 HAVING count(*) > 1), d AS (SELECT mode, route, (max(dep_sec) - min(dep_sec)) / (count(*) - 1) / 60 AS h FROM departures WHERE dep_sec BETWEEN 0 AND 93600 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT mode, route, round(d.h, 6) AS day, round(p.h, 6) AS peak, round(coalesce(p.h, d.h), 6) AS headway_min FROM d LEFT JOIN p USING (mode, route) ORDER BY coalesce(p.h, d.h), mode, route LIMIT 1""")
def _(t):
    return schedule.frequency(t.departures).withColumns(r6("day", "peak", "headway_min"))


@query("agg_36_shared_terminals", f""", a AS (SELECT DISTINCT d.route, p.stop_idx, s.lat, s.lon FROM (SELECT DISTINCT pattern_idx, route FROM departures) d JOIN pattern_stops p USING (pattern_idx) JOIN stops s USING (stop_idx) WHERE stop_pos = 0)
SELECT x.route, y.route AS other, round(min({KM('x', 'y')}), 6) AS dist_km FROM a x JOIN a y ON x.route < y.route AND {KM('x', 'y')} <= 0.2 GROUP BY 1, 2""")
def _(t):
    return schedule.shared_terminals(t.departures, t.pattern_stops, t.stops).withColumns(r6("dist_km"))


@query("agg_35_hub_lines", f""", a AS (SELECT DISTINCT d.route, p.stop_idx, s.lat, s.lon FROM (SELECT DISTINCT pattern_idx, route FROM departures) d JOIN pattern_stops p USING (pattern_idx) JOIN stops s USING (stop_idx))
SELECT x.route, x.stop_idx, count(DISTINCT y.route) AS others FROM a x JOIN a y ON x.route <> y.route AND {KM('x', 'y')} <= 0.15 GROUP BY 1, 2""")
def _(t):
    return schedule.hub_lines(t.departures, t.pattern_stops, t.stops)


WAITS = FIRST_VISIT + """, a AS (SELECT v.stop_idx, d.route, d.dep_sec + v.offset_sec AS t, floor((d.dep_sec + v.offset_sec) / 3600.0)::INT AS hour FROM departures d JOIN visit v USING (pattern_idx)), b AS (SELECT * FROM a WHERE hour BETWEEN 5 AND 23)
SELECT x.stop_idx, x.hour, least(x.route, x.other) AS route, greatest(x.route, x.other) AS other, round(avg(nxt - t), 6) AS wait_sec, count(*) AS n FROM (
  SELECT p.*, q.t AS nxt FROM (SELECT b.*, o.route AS other FROM b JOIN (SELECT DISTINCT stop_idx, hour, route FROM b) o ON o.stop_idx = b.stop_idx AND o.hour = b.hour AND o.route <> b.route) p
  ASOF JOIN b q ON q.stop_idx = p.stop_idx AND q.hour = p.hour AND q.route = p.other AND p.t <= q.t) x GROUP BY 1, 2, 3, 4"""


@query("graph_16_transfer_waits", WAITS)
def _(t):
    return schedule.transfer_waits(t.departures, t.pattern_stops).withColumns(r6("wait_sec"))


@query("graph_16_pulse_hubs", WAITS.replace("SELECT x.stop_idx, x.hour", ", waits AS (SELECT x.stop_idx, x.hour").replace("round(avg(nxt - t), 6)", "avg(nxt - t)") + """), r AS (
  SELECT stop_idx, count(DISTINCT route) AS routes FROM (SELECT stop_idx, route FROM waits UNION SELECT stop_idx, other FROM waits) GROUP BY 1 HAVING count(DISTINCT route) >= 2
)
SELECT stop_idx, routes, round(avg(wait_sec), 6) AS wait_sec FROM r JOIN waits USING (stop_idx) GROUP BY 1, 2 ORDER BY routes DESC, avg(wait_sec), stop_idx LIMIT 20""")
def _(t):
    return schedule.pulse_hubs(schedule.transfer_waits(t.departures, t.pattern_stops), least_routes=2).withColumns(r6("wait_sec"))


@query("agg_02_median_offsets", """, x AS (SELECT pattern_idx, stop_pos, quantile_cont(offset_sec, 0.5) FILTER (stop_pos % 3 <> 2 AND offset_sec >= 0) AS m FROM pattern_stops GROUP BY 1, 2), y AS (SELECT *, count(m) OVER (PARTITION BY pattern_idx ORDER BY stop_pos) AS g, max(m) OVER (PARTITION BY pattern_idx ORDER BY stop_pos) AS base FROM x)
SELECT pattern_idx, stop_pos, round(coalesce(base, 0) + CASE WHEN m IS NULL THEN 0.5 / 18 * 3600 ELSE 0 END, 6) AS offset_sec FROM y""")
def _(t):
    times = t.pattern_stops.select("pattern_idx", "stop_pos", F.lit("TRAM").alias("mode"), F.lit(0.5).alias("leg_km"), F.when(F.col("stop_pos") % 3 != 2, F.col("offset_sec")).alias("offset_sec"))
    return schedule.median_offsets(times).withColumns(r6("offset_sec"))


@query("join_09_next_departure", """SELECT stop_idx, mode, c_sec, min(dep_sec) AS nxt FROM (SELECT s.stop_idx, m.mode, (s.stop_idx * 613) % 86400 AS c_sec FROM stops s CROSS JOIN (SELECT DISTINCT mode FROM departures) m) q LEFT JOIN departures d USING (mode) WHERE d.dep_sec >= c_sec GROUP BY 1, 2, 3""")
def _(t):
    asked = t.stops.select("stop_idx", ((F.col("stop_idx") * 613) % 86400).alias("c_sec")).crossJoin(F.broadcast(t.departures.select("mode").distinct()))  # three modes
    return ordered.next_at_or_after(asked, t.departures.select("mode", "dep_sec"), ["mode"], "c_sec", "dep_sec", "nxt", width=60).where("nxt is not null")


@query("sort_01_routes", "SELECT mode, route, row_number() OVER (ORDER BY CASE mode WHEN 'TRAM' THEN 0 WHEN 'BUS' THEN 1 WHEN 'RAIL' THEN 2 ELSE 3 END, coalesce(try_cast(route AS INT), 2147483647), route)::INT AS place FROM (SELECT DISTINCT mode, route FROM departures)")
def _(t):
    routes = t.departures.select("mode", "route").distinct()
    return ordered.ranked(routes, schedule.mode_order(F.col("mode")), schedule.name_order(F.col("route")), "route", out="place")


# --- feeds -------------------------------------------------------------------

OLD, NEW = "route_id not in ('R1', 'R5') and day < 1200", "route_id <> 'R7' and day >= 1200"
SIGS = f""", o AS (SELECT route_id, array_to_string(list_sort(list(DISTINCT concat(direction, '/', headsign))), ',') AS sig FROM trips WHERE {OLD} GROUP BY 1), n AS (SELECT route_id, array_to_string(list_sort(list(DISTINCT concat(direction, '/', headsign))), ',') AS sig FROM trips WHERE {NEW} GROUP BY 1)
"""


@query("join_15_line_diff", SIGS + "SELECT coalesce(o.route_id, n.route_id) AS route_id, CASE WHEN o.sig IS NULL THEN 'added' WHEN n.sig IS NULL THEN 'removed' WHEN o.sig <> n.sig THEN 'changed' ELSE 'same' END AS kind FROM o FULL JOIN n ON o.route_id = n.route_id")
def _(t):
    return changes.line_diff(changes.signatures(t.trips.where(OLD)), changes.signatures(t.trips.where(NEW)))


@query("set_03_added_removed", SIGS + "SELECT route_id, 'removed' AS kind FROM o WHERE route_id NOT IN (SELECT route_id FROM n) UNION ALL SELECT route_id, 'added' FROM n WHERE route_id NOT IN (SELECT route_id FROM o)")
def _(t):
    return changes.set_difference(t.trips.where(OLD), t.trips.where(NEW), "route_id")


@query("agg_86_permanence", """SELECT route_id, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days, max(day) - min(day) AS span, (SELECT max(day) FROM trips) - max(day) <= 10 AND max(day) - min(day) >= 0.4 * (SELECT max(day) - min(day) FROM trips) AS lasting FROM trips GROUP BY 1""")
def _(t):
    return changes.permanence(t.trips.select("route_id", "day"))


@query("join_21_bracketing_pairs", """, f AS (SELECT day - day % 90 AS feed_day, count(*) AS amount FROM trips GROUP BY 1), p AS (SELECT *, lead(feed_day) OVER (ORDER BY feed_day) AS next_day FROM f), c AS (SELECT trip_id AS change_id, day FROM trips)
SELECT change_id, day, feed_day, next_day, amount FROM c JOIN p ON next_day IS NOT NULL AND day BETWEEN feed_day - 80 AND next_day + 80 QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY amount DESC, feed_day) = 1""")
def _(t):
    feeds = t.trips.groupBy((F.col("day") - F.col("day") % 90).alias("feed_day")).agg(F.count("*").alias("amount"))
    return changes.bracketing_pairs(feeds, t.trips.select(F.col("trip_id").alias("change_id"), "day"))


@query("set_01_united_feeds", f"SELECT route_id, min(trip_id) AS trip_id FROM trips WHERE {NEW} GROUP BY 1 UNION ALL SELECT route_id, min(trip_id) FROM trips WHERE {OLD} AND route_id NOT IN (SELECT route_id FROM trips WHERE {NEW}) GROUP BY 1")
def _(t):
    one = lambda c: t.trips.where(c).groupBy("route_id").agg(F.min("trip_id").alias("trip_id"))
    return gtfs.united([one(OLD), one(NEW)], "route_id")


@query("join_01_trips_with_routes", "SELECT trip_id, coalesce(CASE WHEN route_id IN ('R2', 'R4') THEN NULL ELSE 'line ' || route_id END, route_id) AS route, CASE WHEN route_id IN ('R2', 'R4') THEN 'BUS' ELSE 'TRAM' END AS mode FROM trips")
def _(t):
    own = t.trips.select("trip_id", "route_id")
    routes = own.select("route_id").distinct().where("route_id not in ('R2', 'R4')").select("route_id", F.concat(F.lit("line "), "route_id").alias("route"), F.lit("TRAM").alias("mode"))
    return gtfs.trips_with_routes(own, routes).select("trip_id", "route", "mode")


@query("flt_08_service_date", """, d AS (SELECT day AS date, count(*) AS trips, row_number() OVER (ORDER BY day) AS ord FROM trips GROUP BY day), f AS (SELECT min(ord) AS o FROM d) SELECT date, trips FROM d, f WHERE ord = o OR ord = o + 1 ORDER BY trips DESC, ord LIMIT 1""")
def _(t):
    days = t.trips.groupBy(F.col("day").alias("date")).agg(F.count("*").alias("trips"))
    return gtfs.busiest_date(ordered.ranked(days, "date", out="ord"))
