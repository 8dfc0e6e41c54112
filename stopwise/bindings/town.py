"""Queries of reach: journeys by timetable, streets and bikes over all stops, with their DuckDB statements.

The statements follow the definition: labels are settled in windows of time, so
that every ride starts from a final label.  Their window is shorter than any ride
of the synthetic timetable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import slug
from ..operators import graph, journeys, rasters, spatial
from ..operators.journeys import Network
from ..plans import isochrone as iso
from ..plans import network
from ..queries import query, r6
from ..shared import written
from . import Tables
from .schedule import KM
from .space import AREAS, PIP, areas

EIGHT = 8 * 3600.0
#: Departures of the morning and of the evening passes.
MORNING, EVENING = [7.0 * 3600, 7.25 * 3600, 7.5 * 3600, 7.75 * 3600, 8.0 * 3600], [20.0 * 3600, 20.5 * 3600, 21.0 * 3600, 21.5 * 3600, 22.0 * 3600]


def stops(t: Tables) -> DataFrame:
    return t.stops.select("stop_idx", "lat", "lon")


def stations(t: Tables) -> DataFrame:
    return t.stations.select("station_id", "lat", "lon")


def street_nodes(t: Tables) -> DataFrame:
    return t.stops.select(F.col("stop_idx").alias("walk_node"), (F.col("lat") + 0.0002).alias("lat"), (F.col("lon") + 0.0003).alias("lon"))


def stop_places(t: Tables) -> DataFrame:
    """stop_idx, lat, lon, place: stops without calls at the same coordinates are one place, named by the least; a stop with calls is its own.

    Seeds and links depend on coordinates, so journeys reach all stops of a place at the
    same time by the same last leg, and a leg from a place counts from its least stop.
    """
    called = t.pattern_stops.select("stop_idx").distinct()
    plain = spatial.placed(stops(t).join(called, "stop_idx", "left_anti"), "stop_idx")
    return plain.unionByName(stops(t).join(called, "stop_idx", "left_semi").withColumn("place", F.col("stop_idx")))


def place_stops(t: Tables) -> DataFrame:
    """A stop for each place."""
    return stop_places(t).where("stop_idx = place").select("stop_idx", "lat", "lon")


def place_nodes(t: Tables) -> DataFrame:
    """A street node for each place."""
    return spatial.placed(street_nodes(t), "walk_node").where("walk_node = place").select("walk_node", "lat", "lon")


def streets(nodes: DataFrame) -> DataFrame:
    """Streets join nodes (walk_node, lat, lon) within 250 m; a river along 45.78 N is crossed between 15.88 and 15.90 E only."""
    near = spatial.range_join(nodes, nodes, 0.25).where("walk_node <> r_walk_node")
    bridge = F.col("lon").between(15.88, 15.90) & F.col("r_lon").between(15.88, 15.90)
    dry = ((F.col("lat") < 45.78) == (F.col("r_lat") < 45.78)) | bridge
    return near.where(dry).select(F.col("walk_node").alias("src"), F.col("r_walk_node").alias("dst"), F.floor(F.col("dist_km") * 100000).cast("long").alias("dist_cm"))


def timetable(t: Tables, links: DataFrame, late: bool = False) -> Network:
    calls = t.pattern_stops.select(F.col("pattern_idx").cast("long").alias("pattern_idx"), F.col("stop_pos").cast("int").alias("stop_pos"), F.col("stop_idx").alias("node"), F.col("offset_sec").cast("double").alias("offset_sec"))
    departures = t.departures.select(F.col("pattern_idx").cast("long").alias("pattern_idx"), F.col("dep_sec").cast("double").alias("dep_sec")).distinct()
    if not late:
        return Network(calls, departures, links)
    departures = departures.withColumn("trip_id", ((F.col("pattern_idx") * 131 + F.col("dep_sec").cast("long")) % 1009).cast("string"))
    last = t.rt_obs.groupBy("trip_id", "stop_sequence").agg(F.max_by("delay", F.struct("ts", "event_id")).alias("delay"))
    return Network(calls, departures, links, last)


def isochrone_network(t: Tables, late: bool = False) -> Network:
    links = iso.transfers(stops(t), iso.DETOUR, 0.0).unionByName(iso.bike_links(stops(t), stations(t), iso.DETOUR))
    return timetable(t, links, late)


def origins(t: Tables) -> DataFrame:
    return t.stations.select(F.col("station_id").alias("source"), "lat", "lon")


def isochrone_labels(t: Tables, cap: float, late: bool = False) -> DataFrame:
    """Labels from every bike station at eight; written, as further plans read them often."""
    seeds = iso.street_seeds(origins(t), stops(t), street_nodes(t), streets(street_nodes(t)), stations(t))
    return written(journeys.labels(seeds, isochrone_network(t, late), EIGHT, cap, iso.ISOCHRONE))


# --- the same in SQL -----------------------------------------------------------

STREETS = f""", street_nodes AS (SELECT stop_idx AS node, lat + 0.0002::DOUBLE AS lat, lon + 0.0003::DOUBLE AS lon FROM stops), footways AS (
  SELECT a.node AS src, b.node AS dst, floor({KM('a', 'b')} * 100000)::DOUBLE * 0.0072::DOUBLE AS sec FROM street_nodes a JOIN street_nodes b ON a.node <> b.node AND {KM('a', 'b')} <= 0.25
  AND ((a.lat < 45.78) = (b.lat < 45.78) OR (a.lon BETWEEN 15.88 AND 15.90 AND b.lon BETWEEN 15.88 AND 15.90))
)"""


def _snap_sql(name: str, places: str, key: str, km: float, detour: str = "") -> str:
    return f""", {name} AS (SELECT p.{key} AS place, n.node AS node, {KM('p', 'n')}{detour} / 5.0::DOUBLE * 3600.0::DOUBLE AS sec FROM {places} p JOIN street_nodes n ON {KM('p', 'n')} < {km}
  QUALIFY row_number() OVER (PARTITION BY p.{key} ORDER BY {KM('p', 'n')}, n.node) = 1)"""


def _foot_sql(name: str, seeds: str, below: float) -> str:
    """Least seconds on foot from rows (source, node, cost)."""
    return f""", {name}(source, node, cost) USING KEY (source, node) AS (
  SELECT source, node, min(cost) FROM {seeds} WHERE cost < {below} GROUP BY 1, 2
  UNION
  SELECT n.source, n.node, n.cost FROM (SELECT w.source, e.dst AS node, min(w.cost + e.sec) AS cost FROM {name} w JOIN footways e ON w.node = e.src GROUP BY 1, 2) n
  LEFT JOIN recurring.{name} AS r ON r.source = n.source AND r.node = n.node WHERE n.cost < {below} AND (r.cost IS NULL OR n.cost < r.cost)
)"""


CALLS = ", calls AS (SELECT pattern_idx, stop_pos, stop_idx AS node, offset_sec::DOUBLE AS off FROM pattern_stops)"
DEPARTS = """, left_at AS (SELECT DISTINCT pattern_idx, dep_sec::DOUBLE AS sec FROM departures), leaving AS (
  SELECT pattern_idx, sec, row_number() OVER w AS number, coalesce(sec - lag(sec) OVER w, lead(sec) OVER w - sec, 3600.0::DOUBLE) AS headway, coalesce(lag(sec) OVER w, -1e9::DOUBLE) AS before,
    ((pattern_idx * 131 + sec::BIGINT) % 1009)::VARCHAR AS trip FROM left_at WINDOW w AS (PARTITION BY pattern_idx ORDER BY sec)
)"""
LATE = """, told AS (SELECT trip_id, stop_sequence AS q, arg_max(delay, {'ts': ts, 'e': event_id}) AS delay FROM rt_obs GROUP BY 1, 2), trip_of AS (
  SELECT l.pattern_idx, l.number, o.trip FROM leaving l JOIN leaving o ON o.pattern_idx = l.pattern_idx AND o.number BETWEEN l.number - 3 AND l.number AND o.trip IN (SELECT trip_id FROM told)
  QUALIFY row_number() OVER (PARTITION BY l.pattern_idx, l.number ORDER BY o.number DESC) = 1
), late AS (
  SELECT DISTINCT t.trip, c.stop_pos, coalesce((SELECT arg_max(delay, q) FROM told WHERE trip_id = t.trip AND q <= c.stop_pos + 1), 0)::DOUBLE AS delay FROM (SELECT DISTINCT trip FROM trip_of) t, (SELECT DISTINCT stop_pos FROM calls) c
)"""


def _transfers_sql(detour: str, penalty: float) -> str:
    return f"SELECT a.stop_idx AS src, b.stop_idx AS dst, {KM('a', 'b')}{detour} / 5.0::DOUBLE * 3600.0::DOUBLE + {penalty}::DOUBLE AS sec, 2 AS kind FROM stops a JOIN stops b ON a.stop_idx <> b.stop_idx AND {KM('a', 'b')} <= 0.3"


def _bikes_sql(detour: str) -> str:
    walk = f"{KM('a', 'b')}{detour} / 5.0::DOUBLE * 3600.0::DOUBLE"
    near = f"FROM stations a JOIN stops b ON {KM('a', 'b')} <= 0.35"
    return f"""SELECT a.station_id + {iso.STATION} AS src, b.stop_idx AS dst, {walk} AS sec, 2 AS kind {near}
  UNION ALL SELECT b.stop_idx, a.station_id + {iso.STATION}, {walk}, 2 {near}
  UNION ALL SELECT a.station_id + {iso.STATION}, b.station_id + {iso.STATION}, 90.0::DOUBLE + {KM('a', 'b')} / 14.0::DOUBLE * 3600.0::DOUBLE, 3 FROM stations a JOIN stations b ON a.station_id <> b.station_id AND {KM('a', 'b')} <= 6"""


def labels_sql(name: str, seeds: str, links: str, cap: float, depart: float = EIGHT, window: float = 60.0, first: bool = False, late: bool = False, beyond: bool = False) -> str:
    """Labels of rows (source, node, cost): a marker row goes through the windows, following links until nothing changes, then boarding rides.

    With delays a ride may take no time at all, so windows are single times: each source's least open one.
    """
    wait = "least(least(d.headway, 1800.0::DOUBLE) / 2.0::DOUBLE, 3600.0::DOUBLE)"
    exact = f"(d.sec + b.off - ({depart}::DOUBLE + x.cost))"
    if first:
        wait = f"CASE WHEN NOT coalesce(x.cost >= s.cost - 1e-6::DOUBLE, false) THEN {wait} WHEN {exact} <= 3600 THEN least({exact}, 120.0::DOUBLE) END"
    came = "o.aboard + (c.off - o.off)"
    if late:
        came = f"CASE WHEN o.trip IS NULL THEN {came} ELSE greatest({came} + greatest(least(y.delay - z.delay, 900.0::DOUBLE), -300.0::DOUBLE), o.aboard) END"
    keep = "" if beyond else f"WHERE cost <= {cap}"
    state = "{'cost': cost, 'level': level, 'kind': kind, 'pred': pred, 'pattern_idx': pattern_idx, 'board': board, 'alight': alight}"
    trip = ", t.trip" if late else ""
    joined = "LEFT JOIN trip_of t ON t.pattern_idx = d.pattern_idx AND t.number = d.number" if late else ""
    told = "LEFT JOIN late y ON y.trip = o.trip AND y.stop_pos = c.stop_pos LEFT JOIN late z ON z.trip = o.trip AND z.stop_pos = o.stop_pos" if late else ""
    return f""", {name}_seed AS (SELECT source, node, min(cost) AS cost FROM {seeds} GROUP BY 1, 2), {name}_links AS ({links}), {name}_all(source, node, cost, level, kind, pred, pattern_idx, board, alight) USING KEY (source, node) AS (
  SELECT source, node, cost, 0 AS level, 0 AS kind, -1::BIGINT AS pred, -1::BIGINT AS pattern_idx, -1 AS board, -1 AS alight FROM {name}_seed {keep}
  UNION ALL SELECT -1, -1, 0.0::DOUBLE, 0, 0, -1, -1, -1, -1
  UNION
  (WITH m AS (SELECT cost AS k, kind AS phase FROM recurring.{name}_all WHERE source = -1), x AS (
    SELECT r.* FROM recurring.{name}_all AS r, m WHERE r.source <> -1 AND floor(r.cost / {window}::DOUBLE) = m.k AND r.cost <= {cap}
  ), o AS (
    SELECT x.source, x.node, b.pattern_idx, b.stop_pos, b.off, x.cost, x.level, x.cost + {wait} AS aboard{trip} FROM (SELECT x.* FROM x, m WHERE m.phase = 1) x JOIN calls b ON b.node = x.node
    JOIN leaving d ON d.pattern_idx = b.pattern_idx AND {depart}::DOUBLE + x.cost - b.off <= d.sec AND {depart}::DOUBLE + x.cost - b.off > d.before LEFT JOIN {name}_seed s ON s.source = x.source AND s.node = x.node {joined}
  ), offered AS (
    SELECT x.source, l.dst AS node, x.cost + l.sec AS cost, CASE WHEN x.cost + l.sec = x.cost THEN x.level + 1 ELSE 0 END AS level, l.kind, x.node AS pred, -1 AS pattern_idx, -1 AS board, -1 AS alight FROM x JOIN {name}_links l ON l.src = x.node, m WHERE m.phase = 0
    UNION ALL SELECT o.source, c.node, {came}, CASE WHEN {came} = o.cost THEN o.level + 1000 ELSE 0 END, 1, o.node, o.pattern_idx, o.stop_pos, c.stop_pos FROM o JOIN calls c ON c.pattern_idx = o.pattern_idx AND c.stop_pos > o.stop_pos {told} WHERE o.aboard IS NOT NULL
  ), least_ AS (
    SELECT source, node, min({state}) AS l FROM offered {keep} GROUP BY 1, 2
  ), new AS (
    SELECT n.source, n.node, n.l FROM least_ n LEFT JOIN recurring.{name}_all AS r ON r.source = n.source AND r.node = n.node, m
    WHERE r.cost IS NULL OR n.l < {{'cost': r.cost, 'level': r.level, 'kind': r.kind, 'pred': r.pred, 'pattern_idx': r.pattern_idx, 'board': r.board, 'alight': r.alight}}
  ), again AS (
    SELECT count(*) AS n FROM new, m WHERE floor(l.cost / {window}::DOUBLE) = m.k
  )
  SELECT source, node, l.cost, l.level, l.kind, l.pred, l.pattern_idx, l.board::INT, l.alight::INT FROM new
  UNION ALL SELECT -1, -1, CASE WHEN m.phase = 1 AND again.n = 0 THEN m.k + 1 ELSE m.k END, 0, CASE WHEN m.phase = 0 AND again.n = 0 THEN 1 ELSE 0 END, -1, -1, -1, -1 FROM m, again WHERE m.k * {window} <= {cap})
), {name} AS (SELECT * FROM {name}_all WHERE source <> -1)"""


_DETOUR = " * 1.35::DOUBLE"
SEEDS = (
    STREETS + _snap_sql("stop_snap", "stops", "stop_idx", 0.09) + _snap_sql("origin_snap", "stations", "station_id", 0.25, _DETOUR) + ", walk_start AS (SELECT place AS source, node, sec AS cost FROM origin_snap)" + _foot_sql("walked", "walk_start", 864)
    + f""", seeds AS (SELECT w.source, s.place AS node, w.cost + s.sec AS cost FROM walked w JOIN stop_snap s ON s.node = w.node
  UNION ALL SELECT a.station_id, b.station_id + {iso.STATION}, {KM('a', 'b')} * 1.35::DOUBLE / 5.0::DOUBLE * 3600.0::DOUBLE FROM stations a JOIN stations b ON {KM('a', 'b')} <= 1.2)"""
)
_LINKS = _transfers_sql(_DETOUR, 0.0) + " UNION ALL " + _bikes_sql(_DETOUR)
LABELS = SEEDS + CALLS + DEPARTS + labels_sql("labels", "seeds", _LINKS, 1800.0, first=True)


@query("graph_02_isochrone_labels", LABELS + "SELECT source, node, round(cost, 6) AS cost, kind, pred, pattern_idx, board, alight FROM labels")
def _(t):
    return isochrone_labels(t, 1800.0).withColumns(r6("cost"))


#: Statements that take minutes on larger tables; tests run them on the smallest.
SMALL_SQL: dict[str, str] = {}

SMALL_SQL["graph_02_realtime_labels"] = SEEDS + CALLS + DEPARTS + LATE + labels_sql("labels", "seeds", _LINKS, 900.0, window=0.5, first=True, late=True) + "SELECT source, node, round(cost, 6) AS cost, kind, pred, pattern_idx, board, alight FROM labels"


@query("graph_02_realtime_labels")
def _(t):
    return isochrone_labels(t, 900.0, late=True).withColumns(r6("cost"))


# --- on the labels of isochrones -------------------------------------------------


_CELLS = ", cells AS (SELECT DISTINCT w.source, trunc(n.lat * (1 / 0.002::DOUBLE))::BIGINT AS cy, trunc(n.lon * (1 / 0.002::DOUBLE))::BIGINT AS cx FROM {walk} w JOIN street_nodes n ON n.node = w.node)\n"
_AREA_START = """, area_start AS (SELECT place AS source, node, sec AS cost FROM {snap} UNION ALL SELECT l.source, s.node, l.cost + s.sec FROM labels l JOIN stop_snap s ON s.place = l.node WHERE l.cost < 1800)"""


@query("graph_03_walked_cells", LABELS + _snap_sql("plain_snap", "stations", "station_id", 0.25) + _AREA_START.replace("{snap}", "plain_snap") + _foot_sql("area", "area_start", 1800) + _CELLS.replace("{walk}", "area") + "SELECT source, count(*) AS cells FROM cells GROUP BY 1")
def _(t):
    return iso.walked_cells(isochrone_labels(t, 1800.0), origins(t), stops(t), street_nodes(t), streets(street_nodes(t)), 1800.0)


def area_cells(t: Tables) -> DataFrame:
    """(source, cy, cx, sec): raster cells along the streets reached within 30 minutes, with their least time."""
    labels, nodes = isochrone_labels(t, 1800.0), street_nodes(t)
    at = iso.snapped(stops(t), nodes, "stop_idx", iso.STOP_SNAP_KM)
    own = iso.snapped(origins(t), nodes, "source", iso.ORIGIN_SNAP_KM, iso.DETOUR).select("source", F.col("walk_node").alias("node"), F.col("snap_sec").alias("cost"))
    seeds = labels.join(at, F.col("node") == F.col("stop_idx")).select("source", F.col("walk_node").alias("node"), (F.col("cost") + F.col("snap_sec")).alias("cost"))
    ways = streets(street_nodes(t))
    reached = written(iso.on_foot(own.unionByName(seeds), ways, 1800.0))
    return iso.raster(reached, ways, nodes)


@query("graph_08_bands", LABELS + _AREA_START.replace("{snap}", "origin_snap") + _foot_sql("area", "area_start", 1800) + """, legs AS (
  SELECT a.source, a.cost AS s1, b.cost AS s2, floor(x.lat / 0.001::DOUBLE) AS y, floor(x.lon / 0.001::DOUBLE) AS x, floor(y.lat / 0.001::DOUBLE) - floor(x.lat / 0.001::DOUBLE) AS dy, floor(y.lon / 0.001::DOUBLE) - floor(x.lon / 0.001::DOUBLE) AS dx
  FROM footways f JOIN area a ON a.node = f.src JOIN area b ON b.node = f.dst AND b.source = a.source JOIN street_nodes x ON x.node = f.src JOIN street_nodes y ON y.node = f.dst WHERE f.src < f.dst
), n AS (SELECT *, greatest(abs(dy), abs(dx), 1)::BIGINT AS n FROM legs), i AS (SELECT *, unnest(range(n + 1)) AS i FROM n
), cells AS (SELECT source, (y + floor(dy * (i / n) + 0.5))::BIGINT AS cy, (x + floor(dx * (i / n) + 0.5))::BIGINT AS cx, min(s1 + (s2 - s1) * (i / n)) AS sec FROM i GROUP BY 1, 2, 3
), own AS (SELECT source, band, cy, cx FROM cells, (SELECT unnest([300, 600, 900, 1200, 1800]) AS band) WHERE sec <= band
), step AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
), wide AS (SELECT DISTINCT source, band, cy + dy AS cy, cx + dx AS cx FROM own, step
), filled AS (SELECT source, band, cy + dy AS cy, cx + dx AS cx FROM wide, step GROUP BY 1, 2, 3, 4 HAVING count(*) = 9
), side AS (SELECT f.source, f.band, count(*) AS n FROM filled f JOIN step s ON abs(s.dx) + abs(s.dy) = 1 ANTI JOIN filled g ON g.source = f.source AND g.band = f.band AND g.cy = f.cy + s.dy AND g.cx = f.cx + s.dx GROUP BY 1, 2)
SELECT f.source, f.band, count(*) AS cells, count(*)::DOUBLE AS ring_area, any_value(s.n) AS ring_points FROM filled f JOIN side s ON s.source = f.source AND s.band = f.band GROUP BY 1, 2""")
def _(t):
    filled = written(iso.band_cells(area_cells(t)))
    rings = rasters.signed_area(rasters.rings(filled, iso.BAND), iso.BAND).groupBy(*iso.BAND).agg(F.sum("area").alias("ring_area"), F.sum("points").alias("ring_points"))
    return filled.groupBy(*iso.BAND).agg(F.count("*").alias("cells")).join(rings, iso.BAND)


@query("graph_08_shapes")
def _(t):
    return iso.band_shapes(written(iso.band_cells(area_cells(t))))


def segments(t: Tables) -> DataFrame:
    w = W.partitionBy("pattern_idx").orderBy("stop_pos")
    lines = t.departures.select("pattern_idx", "mode").distinct()
    own = t.pattern_stops.withColumn("dst", F.lead("stop_idx").over(w)).where("dst is not null")
    return own.join(lines, "pattern_idx").select("mode", F.col("stop_idx").alias("src"), "dst")


@query("graph_09_line_features", LABELS + """, seg AS (SELECT a.node AS src, b.node AS dst FROM calls a JOIN calls b ON b.pattern_idx = a.pattern_idx AND b.stop_pos = a.stop_pos + 1 JOIN (SELECT DISTINCT pattern_idx, mode FROM departures) m ON m.pattern_idx = a.pattern_idx WHERE mode <> 'RAIL')
SELECT x.source, floor(least(x.cost, y.cost) / 60)::BIGINT AS minute, count(*) AS segments FROM seg JOIN labels x ON x.node = seg.src JOIN labels y ON y.node = seg.dst AND y.source = x.source WHERE x.cost <= 1800 AND y.cost <= 1800 GROUP BY 1, 2""")
def _(t):
    return network.line_features(isochrone_labels(t, 1800.0), segments(t))


@query("graph_10_payload", LABELS + """, used AS (SELECT DISTINCT source, pattern_idx FROM labels WHERE kind = 1), ref AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pattern_idx) - 1 AS pattern_ref FROM used), routes AS (SELECT DISTINCT pattern_idx, route FROM departures)
SELECT l.source, l.node, round(l.cost, 6) AS cost, l.kind, nullif(l.pred, -1) AS pred, r.pattern_ref, x.route, nullif(l.board, -1) AS board, nullif(l.alight, -1) AS alight FROM labels l LEFT JOIN ref r ON r.source = l.source AND r.pattern_idx = l.pattern_idx LEFT JOIN routes x ON x.pattern_idx = l.pattern_idx""")
def _(t):
    labels = isochrone_labels(t, 1800.0)
    known = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    best = labels.select("source", "node", "cost", "kind", *map(known, ("pred", "pattern_idx", "board", "alight")))
    refs = network.routing_payload(best.select("source", "node", "pattern_idx"), t.departures.select(F.col("pattern_idx").cast("long").alias("pattern_idx"), "route").distinct())
    return best.drop("pattern_idx").join(refs, ["source", "node"]).withColumn("pattern_ref", F.col("pattern_ref").cast("long")).withColumns(r6("cost"))


_AREA = AREAS + f", home AS (SELECT station_id, {PIP('stations')} AS ord FROM stations), origin AS (SELECT ord, min(station_id) AS source FROM home WHERE ord IS NOT NULL GROUP BY 1), placed AS (SELECT stop_idx, {PIP('stops')} AS ord FROM stops)"


@query("graph_13_travel_matrix", _AREA + SEEDS + CALLS + DEPARTS + labels_sql("labels", "seeds", _LINKS, 3600.0, first=True) + """
SELECT a.name AS origin, b.name AS dest, ceil(min(l.cost) / 60)::BIGINT AS minutes FROM origin o JOIN areas a ON a.ord = o.ord JOIN labels l ON l.source = o.source JOIN placed p ON p.stop_idx = l.node JOIN areas b ON b.ord = p.ord WHERE a.ord <> b.ord GROUP BY 1, 2""")
def _(t):
    nodes = spatial.containing(t.stops, areas(t), "stop_idx").where("area is not null").select(F.col("stop_idx").alias("node"), "area")
    homes = spatial.containing(t.stations, areas(t), "station_id").where("area is not null")
    best = homes.groupBy("area").agg(F.min("station_id").alias("source"))
    return network.travel_matrix(isochrone_labels(t, 3600.0), nodes, best)


def goals(t: Tables) -> DataFrame:
    """Every pair of a bike station and the middle of a district."""
    middle = t.districts.select(F.col("ord").alias("goal_id"), (F.col("lat0") + 0.0061).alias("lat"), (F.col("lon0") + 0.0083).alias("lon"))
    return origins(t).select("source").join(F.broadcast(middle), F.lit(True))  # a row for each district


_GOALS = f""", target AS (SELECT ord AS goal_id, lat0 + 0.0061::DOUBLE AS lat, lon0 + 0.0083::DOUBLE AS lon FROM districts), spot AS (SELECT stop_idx AS node, lat, lon FROM stops UNION ALL SELECT station_id + {iso.STATION}, lat, lon FROM stations
), terminal AS (SELECT l.source, g.goal_id, l.node AS goal FROM labels l JOIN spot p ON p.node = l.node, target g QUALIFY row_number() OVER (PARTITION BY l.source, g.goal_id ORDER BY l.cost + {KM('p', 'g')} / 5.0::DOUBLE * 3600.0::DOUBLE, l.node) = 1
), want AS (SELECT DISTINCT source, goal FROM terminal), chain(source, goal, node, back) AS (
  SELECT source, goal, goal, 0 FROM want UNION ALL SELECT c.source, c.goal, l.pred, c.back + 1 FROM chain c JOIN labels l ON l.source = c.source AND l.node = c.node WHERE l.pred >= 0
), leg AS (SELECT c.source, c.goal, max(c.back) OVER (PARTITION BY c.source, c.goal) - 1 - c.back AS leg, l.kind, l.pred AS from_node, l.node, l.pattern_idx, b.off AS off1, e.off AS off2, (SELECT min(sec) FROM labels_links k WHERE k.src = l.pred AND k.dst = l.node AND k.kind = l.kind) AS sec
  FROM chain c JOIN labels l ON l.source = c.source AND l.node = c.node LEFT JOIN calls b ON b.pattern_idx = l.pattern_idx AND b.stop_pos = l.board LEFT JOIN calls e ON e.pattern_idx = l.pattern_idx AND e.stop_pos = l.alight
), timed(source, goal, leg, kind, from_node, node, pattern_idx, start, seconds, ridden) AS (
  SELECT w.source, w.goal, -1, 0, -1::BIGINT, -1::BIGINT, -1::BIGINT, 0.0::DOUBLE, coalesce(s.cost, 0.0::DOUBLE), false FROM want w JOIN leg f ON f.source = w.source AND f.goal = w.goal AND f.leg = 0 JOIN labels s ON s.source = w.source AND s.node = f.from_node
  UNION ALL
  SELECT l.source, l.goal, l.leg, l.kind, l.from_node, l.node, l.pattern_idx, t.start + t.seconds,
    CASE WHEN l.kind <> 1 THEN l.sec ELSE floor(l.off2 - l.off1 + coalesce(CASE WHEN t.ridden THEN least(least(d.headway, 1800.0::DOUBLE) / 2, 3600.0::DOUBLE) WHEN d.sec + l.off1 - (28800 + t.start + t.seconds) <= 3600 THEN least(d.sec + l.off1 - (28800 + t.start + t.seconds), 120.0::DOUBLE) END, 0) + 0.5::DOUBLE) END,
    t.ridden OR l.kind = 1 FROM timed t JOIN leg l ON l.source = t.source AND l.goal = t.goal AND l.leg = t.leg + 1
  LEFT JOIN leaving d ON l.kind = 1 AND d.pattern_idx = l.pattern_idx AND 28800 + (t.start + t.seconds) - l.off1 <= d.sec AND 28800 + (t.start + t.seconds) - l.off1 > d.before
)"""


@query("graph_12_itineraries", LABELS + _GOALS + "SELECT source, goal, leg, kind, from_node, node, pattern_idx, round(start, 6) AS start, round(seconds, 6) AS seconds FROM timed WHERE leg >= 0")
def _(t):
    labels = isochrone_labels(t, 1800.0)
    net = isochrone_network(t)
    spots = stops(t).select(F.col("stop_idx").alias("node"), "lat", "lon").unionByName(stations(t).select((F.col("station_id") + iso.STATION).alias("node"), "lat", "lon"))
    ends = iso.terminals(labels, spots, goals(t)).select("source", "goal").distinct()
    legs = iso.retimed(iso.itinerary_chain(labels, ends), labels.select("source", "node", "cost"), net, net.links, EIGHT)
    return legs.withColumn("leg", F.col("leg").cast("int")).withColumns(r6("start", "seconds"))


# --- scores and centrality, every stop a source -----------------------------------


_SCORE_LINKS = _transfers_sql("", 120.0)
STOP_LABELS = CALLS + DEPARTS


def score_network(t: Tables, bikes: bool = False) -> Network:
    links = iso.transfers(stops(t))
    return timetable(t, links.unionByName(iso.bike_links(stops(t), stations(t))) if bikes else links)


def stop_origins(t: Tables) -> DataFrame:
    return t.stops.select(F.col("stop_idx").alias("source"), "lat", "lon")


def arrivals(t: Tables, at: DataFrame, depart: float, cap: float = 2700.0) -> DataFrame:
    """Seconds from each bike station to the places of stops (at) by the rules of scores."""
    net = timetable(t, iso.transfers(at))
    return journeys.labels(iso.straight_seeds(origins(t), at), net, depart, cap, iso.SCORE).select("source", "node", "cost")


_NAMES = ", named AS (SELECT stop_idx AS node, 'trg-' || (stop_idx // 3) AS slug FROM stops)"


SMALL_SQL["graph_01_14_reach"] = (CALLS + DEPARTS + f", seeds AS (SELECT a.stop_idx AS source, b.stop_idx AS node, {KM('a', 'b')} / 5.0::DOUBLE * 3600.0::DOUBLE AS cost FROM stops a JOIN stops b ON {KM('a', 'b')} <= 1.2 UNION ALL SELECT a.stop_idx, b.station_id + {iso.STATION}, {KM('a', 'b')} / 5.0::DOUBLE * 3600.0::DOUBLE FROM stops a JOIN stations b ON {KM('a', 'b')} <= 1.2)"
       + labels_sql("labels", "seeds", _SCORE_LINKS + " UNION ALL " + _bikes_sql(""), 2700.0) + _NAMES + """, met AS (SELECT l.source, n.slug, min(l.cost) AS cost FROM labels l JOIN named n ON n.node = l.node JOIN named o ON o.node = l.source WHERE n.slug <> o.slug GROUP BY 1, 2)
SELECT source, count(*) FILTER (cost <= 900) AS stations_15, count(*) FILTER (cost <= 1800) AS stations_30, count(*) FILTER (cost <= 2700) AS stations_45 FROM met GROUP BY 1""")


@query("graph_01_14_reach")
def _(t):
    seeds = iso.straight_seeds(stop_origins(t), stops(t), stations(t))
    labels = journeys.labels(seeds, score_network(t, bikes=True), EIGHT, 2700.0, iso.SCORE)
    named = t.stops.select(F.col("stop_idx").alias("node"), slug(F.concat(F.lit("Trg "), F.floor(F.col("stop_idx") / 3).cast("string"))).alias("slug"))
    return iso.stations_in_bands(labels, named)


def grid_points(t: Tables) -> DataFrame:
    """Points of a grid over all stops that lie near buildings and in a district."""
    return iso.sample_points(t.stops, areas(t), 0.005)


@query("gen_01_sample_grid", AREAS + f""", box AS (SELECT floor(min(lat) / 0.005) AS a, floor(max(lat) / 0.005) AS b, floor(min(lon) / 0.005) AS c, floor(max(lon) / 0.005) AS d FROM stops), p AS (SELECT y, x, y * 0.005::DOUBLE AS lat, x * 0.005::DOUBLE AS lon FROM (SELECT unnest(range(a::BIGINT, b::BIGINT + 1)) AS y FROM box), (SELECT unnest(range(c::BIGINT, d::BIGINT + 1)) AS x FROM box)
), populated AS (SELECT DISTINCT floor(lat / 0.003::DOUBLE) + dy AS cy, floor(lon / 0.003::DOUBLE) + dx AS cx FROM stops, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)
), q AS (SELECT y, x, lat, lon, {PIP('p')} AS ord FROM p SEMI JOIN populated c ON c.cy = floor(p.lat / 0.003::DOUBLE) AND c.cx = floor(p.lon / 0.003::DOUBLE))
SELECT y::BIGINT AS row, x::BIGINT AS col, round(lat, 6) AS lat, round(lon, 6) AS lon, a.name AS area FROM q JOIN areas a ON a.ord = q.ord""")
def _(t):
    return grid_points(t).select("row", "col", "lat", "lon", "area").withColumns(r6("lat", "lon"))


@query("graph_04_passes")
def _(t):
    """Four passes: without rail, all modes, with bikes, and the evening without rail."""
    points = written(grid_points(t).select("source", "lat", "lon"))
    lines = t.departures.select(F.col("pattern_idx").cast("long").alias("pattern_idx"), "mode").distinct()
    nodes, ways = written(street_nodes(t)), written(streets(street_nodes(t)))
    net, at = score_network(t), stops(t)
    road = iso.without_modes(net, ["RAIL"], lines)
    passes = [(1, road, MORNING, None), (2, net, MORNING, None), (3, score_network(t, bikes=True), MORNING, stations(t)), (4, road, EVENING, None)]
    out = [iso.scoring_pass(points, n, at, nodes, ways, departures, 2700.0, bikes).select(F.lit(k).alias("pass"), "source", "cells") for k, n, departures, bikes in passes]
    return reduce(DataFrame.unionByName, out)


def shares(t: Tables) -> DataFrame:
    return iso.centrality(t.stops.select(F.col("stop_idx").alias("node")), score_network(t), EIGHT, 3600.0)


EVERY = CALLS + DEPARTS + ", seeds AS (SELECT stop_idx AS source, stop_idx AS node, 0.0::DOUBLE AS cost FROM stops)" + labels_sql("labels", "seeds", _SCORE_LINKS, 3600.0, beyond=True) + ", n AS (SELECT count(*) AS n FROM stops)\n"


@query("graph_05_betweenness")
def _(t):
    return iso.betweenness(shares(t), t.stops.count())


SMALL_SQL["graph_06_closeness"] = EVERY + """SELECT source, count(*) AS reached, round(avg(cost), 6) AS mean_cost, round(max(cost), 6) AS farthest, round(count(*) / greatest(1, any_value(n) - 1)::DOUBLE * (count(*) / sum(cost)) * 3600.0::DOUBLE, 6) AS closeness FROM labels, n WHERE source <> node GROUP BY 1"""


@query("graph_06_closeness")
def _(t):
    return iso.closeness(shares(t), t.stops.count()).withColumns(r6("mean_cost", "farthest", "closeness"))


SMALL_SQL["graph_06_path_summary"] = EVERY + """SELECT round(max(cost) / 60 * 100) / 100 AS diameter_min, arg_max(source, {'c': cost, 's': -source, 'n': -node}) AS from_node, arg_max(node, {'c': cost, 's': -source, 'n': -node}) AS to_node, round(avg(cost) / 60 * 100) / 100 AS mean_min,
  count(*) AS pairs, round(count(*) / greatest(1, any_value(n) * (any_value(n) - 1))::DOUBLE * 10000) / 100 AS reachable_pct FROM labels, n WHERE source <> node"""


@query("graph_06_path_summary")
def _(t):
    return iso.path_summary(shares(t), t.stops.count())


@query("graph_11_shortest", STREETS + """, start AS (SELECT node AS source, node, 0.0::DOUBLE AS cost FROM street_nodes), p(source, node, cost) USING KEY (source, node) AS (
  SELECT source, node, cost FROM start
  UNION
  SELECT n.source, n.node, n.cost FROM (SELECT w.source, e.dst AS node, min(w.cost + e.sec) AS cost FROM p w JOIN footways e ON w.node = e.src GROUP BY 1, 2) n
  LEFT JOIN recurring.p AS r ON r.source = n.source AND r.node = n.node WHERE n.cost <= 1200 AND (r.cost IS NULL OR n.cost < r.cost)
) SELECT source, node, round(cost, 6) AS cost FROM p""")
def _(t):
    at = spatial.placed(street_nodes(t), "walk_node")
    nodes = written(at.where("walk_node = place").select("walk_node", "lat", "lon"))
    edges = streets(nodes).select("src", "dst", (F.col("dist_cm").cast("double") * iso.CM_SEC).alias("weight"))
    costs = graph.shortest(edges, nodes.select(F.col("walk_node").alias("node")), 1200.0).withColumns(r6("cost"))
    # streets between nodes of a place take no time
    return spatial.each_member(costs, spatial.members(at, "walk_node"), "source", "node").select("source", "node", "cost")
