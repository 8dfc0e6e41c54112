"""Queries of sources and sinks: tables written to the shared folder in a feed's format and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import numbers as N
from ..functions import text as T
from ..operators import ordered, spatial
from ..plans import bikes, reach, realtime
from ..queries import query, r6
from ..shared import shared_path
from ..sources import feeds, gtfs, networks
from . import EPOCH, Tables
from .space import areas

DAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def feed(t: Tables) -> str:
    """The orders and their lines as a timetable feed in a new folder."""
    folder = shared_path(t.spark, "feed")
    key, line = F.col("o_orderkey"), F.col("l_linenumber")
    route = F.concat(F.lit("R"), (F.col("o_custkey") % 31).cast("string"))
    trips = t.orders.select(
        route.alias("route_id"), F.concat(F.lit("S"), (key % 9).cast("string")).alias("service_id"), key.cast("string").alias("trip_id"),
        F.concat(F.lit('to "'), F.col("o_orderstatus"), F.lit('", slow')).alias("trip_headsign"), (key % 2).cast("int").alias("direction_id"), F.lit("shape").alias("shape_id"),
    )
    kind = F.substring("route_id", 2, 9).cast("int") % 4
    routes = trips.select("route_id").distinct().select("route_id", F.when(kind != 1, F.concat(F.lit("N"), "route_id")).alias("route_short_name"), F.lit("long").alias("route_long_name"), F.when(kind != 2, kind).alias("route_type"))
    on = [F.when((F.substring("service_id", 2, 9).cast("int") + i) % 3 == 0, "1").otherwise("0").alias(d) for i, d in enumerate(DAYS)]
    calendar = trips.select("service_id").distinct().select("service_id", *on)
    dates = t.spark.createDataFrame([("S0", "20240106", "1"), ("S1", "20240107", "2"), ("S2", "bad", "1")], gtfs.FILES["calendar_dates"])
    clock = F.concat_ws(":", (line + 5).cast("string"), F.lpad((F.col("l_orderkey") % 60).cast("string"), 2, "0"), F.lit("00"))
    times = t.lineitem.select(F.col("l_orderkey").cast("string").alias("trip_id"), (F.col("l_suppkey") % 5).cast("string").alias("stop_id"), line.cast("int").alias("stop_sequence"), clock.alias("departure_time"))
    stops = t.supplier.where("s_suppkey < 5").select(F.col("s_suppkey").cast("string").alias("stop_id"), F.col("s_name").alias("stop_name"), (45.0 + F.col("s_suppkey") * 0.3).alias("stop_lat"), F.lit(15.9).alias("stop_lon"))
    gtfs.write_feed({"trips": trips, "routes": routes, "calendar": calendar, "calendar_dates": dates, "stop_times": times, "stops": stops}, folder)
    return folder


KIND = "(o_custkey % 31) % 4"
NAME = f"CASE WHEN {KIND} <> 1 THEN 'NR' || (o_custkey % 31) ELSE 'long' END"
FEED = f""", trips_ AS (SELECT o_orderkey AS trip_id, o_custkey % 31 AS r, {NAME} AS route, CASE {KIND} WHEN 0 THEN 'TRAM' ELSE 'BUS' END AS mode, o_orderkey % 9 AS s, o_orderkey % 2 AS direction_id, o_orderstatus AS status FROM orders)
, times_ AS (SELECT l_orderkey AS trip_id, list((l_suppkey % 5)::VARCHAR ORDER BY l_linenumber, l_suppkey % 5) AS stops FROM lineitem GROUP BY 1)
"""


@query("src_01_routes", FEED + "SELECT DISTINCT 'R' || r AS route_id, route, mode FROM trips_")
def _(t):
    return gtfs.routes(t.spark, feed(t)).select("route_id", "route", "mode")


@query("src_01_service_days", FEED + "SELECT DISTINCT 'S' || s AS service_id, d::INT AS dow FROM trips_, range(7) x(d) WHERE (s + d) % 3 = 0")
def _(t):
    folder = feed(t)
    return gtfs.service_days(gtfs.read_table(t.spark, folder, "calendar"), gtfs.read_table(t.spark, folder, "calendar_dates")).distinct()


@query("src_02_quoted_columns", FEED + """SELECT trip_id::VARCHAR AS trip_id, 'to "' || status || '", slow' AS headsign, NULL::VARCHAR AS block_id FROM trips_""")
def _(t):
    return gtfs.read_table(t.spark, feed(t), "trips").select("trip_id", F.col("trip_headsign").alias("headsign"), "block_id")


@query("src_03_wanted_feed", FEED + """, w AS (SELECT * FROM trips_ WHERE route IN ('NR3', 'NR4'))
SELECT (SELECT count(DISTINCT r) FROM w) AS routes, (SELECT count(*) FROM w) AS trips, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT trip_id FROM w)) AS times""")
def _(t):
    folder = feed(t)
    t.spark.createDataFrame([], gtfs.FILES["shapes"]).write.option("header", True).csv(f"{folder}/shapes.txt")
    own = gtfs.wanted_feed(t.spark, folder, ["NR3", "NR4"])
    n = lambda name: own[name].agg(F.count("*").alias(name))  # noqa: E731  one row each
    return n("routes").crossJoin(n("trips")).crossJoin(n("stop_times").withColumnRenamed("stop_times", "times"))


@query("src_05_patterns", FEED + "SELECT 'R' || r AS route_id, direction_id::INT AS direction_id, array_to_string(stops, ',') AS stops, count(*) AS n_trips FROM trips_ JOIN times_ USING (trip_id) WHERE len(stops) >= 2 GROUP BY 1, 2, 3")
def _(t):
    folder = feed(t)
    own = gtfs.patterns(gtfs.read_table(t.spark, folder, "trips"), gtfs.read_table(t.spark, folder, "stop_times"))
    return own.select("route_id", "direction_id", F.array_join("stops", ",").alias("stops"), "n_trips")


@query("snk_12_written_feed", FEED + "SELECT mode, count(*) AS trips, count(DISTINCT r) AS routes FROM trips_ WHERE mode = 'TRAM' GROUP BY 1")
def _(t):
    first, second = feed(t), shared_path(t.spark, "feed")
    trams = gtfs.routes(t.spark, first).where("mode = 'TRAM'")
    raw = gtfs.read_table(t.spark, first, "routes").join(trams, "route_id", "left_semi")
    gtfs.write_feed({"routes": raw, "trips": gtfs.read_table(t.spark, first, "trips").join(trams, "route_id", "left_semi")}, second)
    own = gtfs.trips_with_routes(gtfs.read_table(t.spark, second, "trips"), gtfs.routes(t.spark, second))
    return own.groupBy("mode").agg(F.count("*").alias("trips"), F.countDistinct("route_id").alias("routes"))


@query("flt_15_trips_near_centre", FEED + """, near AS (SELECT DISTINCT r FROM trips_ WHERE trip_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 5 < 2)), sig AS (
  SELECT l_orderkey AS trip_id, list((l_linenumber, l_suppkey % 5, l_orderkey % 60) ORDER BY l_linenumber, l_suppkey % 5) AS s FROM lineitem GROUP BY 1
)
SELECT 'R' || r AS route_id, count(DISTINCT sig.s) AS trips FROM trips_ JOIN near USING (r) JOIN sig USING (trip_id) GROUP BY 1""")
def _(t):
    folder = feed(t)
    read = lambda name: gtfs.read_table(t.spark, folder, name)
    return gtfs.near_centre(read("stops"), read("stop_times"), read("trips"), 45.0, 15.9).groupBy("route_id").agg(F.count("*").alias("trips"))


#: Values that ways have in turn, one list for each tag; None where the tag is missing.
TAGS = {
    "highway": (
        "residential", "living_street", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "pedestrian", "footway", "path",
        "steps", "cycleway", "track", "service", "road", "motorway", "crossing", "corridor", None,
    ),
    "access": (None, "private", None, "no", "yes"), "foot": (None, None, "no", "yes"), "bicycle": (None, "yes", "no", "designated", None, "dismount", "private", "permissive", "destination", "official", ""),
    "motorroad": (None, None, None, "yes", None, None, "no"), "segregated": (None, None, None, "yes", None, "no", None, None), "cycleway": (None, "track", None, "opposite", "lane", "opposite_lane", None, "opposite_track", None),
    "oneway": (None, "yes", "-1", "no", "true", "1", None, "reversible"), "oneway:bicycle": (None, None, "no", None, "yes", None, None), "junction": (None, None, None, "roundabout", "circular"),
}


def _tag_sql(values: tuple, k: int) -> str:
    return "(" + "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[1 + (p_partkey // {k}) % {len(values)}]"


WAYS = ", tagged AS (SELECT p_partkey AS id, " + ", ".join(f"{_tag_sql(v, 1 + 3 * i)} AS {k.replace(':', '_')}" for i, (k, v) in enumerate(TAGS.items())) + " FROM part)\n"


def tagged(t: Tables) -> DataFrame:
    value = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (1 + F.floor(F.col("p_partkey") / k) % len(values)).cast("int"))
    pairs = [x for i, (k, v) in enumerate(TAGS.items()) for x in (F.lit(k), value(v, 1 + 3 * i))]
    return t.part.select(F.col("p_partkey").alias("id"), F.create_map(*pairs).alias("tags"))


WALKABLE_SQL = WAYS + """SELECT id FROM tagged WHERE highway IN ('residential', 'living_street', 'unclassified', 'tertiary', 'tertiary_link', 'secondary', 'secondary_link', 'primary', 'primary_link', 'pedestrian', 'footway', 'path', 'steps', 'cycleway', 'track', 'service')
  AND access IS DISTINCT FROM 'private' AND foot IS DISTINCT FROM 'no'"""


@query("src_07_walkable", WALKABLE_SQL)
def _(t):
    return tagged(t).where(networks.walkable(F.col("tags"))).select("id")


DIRECTION_SQL = WAYS + """SELECT id, CASE WHEN oneway_bicycle = 'no' OR cycleway IN ('opposite', 'opposite_lane', 'opposite_track') THEN 'both' WHEN oneway = '-1' THEN 'backward' WHEN oneway IN ('yes', '1', 'true') OR junction = 'roundabout' THEN 'forward' ELSE 'both' END AS direction
FROM tagged WHERE (highway IN ('residential', 'living_street', 'unclassified', 'tertiary', 'tertiary_link', 'secondary', 'secondary_link', 'primary', 'primary_link', 'cycleway', 'track', 'service', 'road')
  OR (highway IN ('path', 'pedestrian', 'footway') AND (CASE WHEN coalesce(bicycle, '') <> '' THEN bicycle IN ('yes', 'designated', 'permissive', 'official', 'destination') ELSE highway = 'path' END OR coalesce(segregated = 'yes', false) OR coalesce(cycleway = 'track', false))))
  AND coalesce(access, '') NOT IN ('private', 'no') AND coalesce(bicycle, '') NOT IN ('no', 'dismount') AND coalesce(motorroad, '') <> 'yes'"""


@query("src_08_bike_direction", DIRECTION_SQL)
def _(t):
    return tagged(t).where(networks.rideable(F.col("tags"))).select("id", networks.bike_direction(F.col("tags")).alias("direction"))


CELLS_SQL = """, m AS (SELECT pattern_idx, sum(round(lat * 10000000)::BIGINT)::BIGINT / (count(*) * 10000000::DOUBLE) AS lat, sum(round(lon * 10000000)::BIGINT)::BIGINT / (count(*) * 10000000::DOUBLE) AS lon
  FROM pattern_stops JOIN stops USING (stop_idx) WHERE pattern_idx % 3 <> 0 GROUP BY 1) SELECT DISTINCT floor(lat / 0.003::DOUBLE)::BIGINT AS cy, floor(lon / 0.003::DOUBLE)::BIGINT AS cx FROM m"""


def buildings(t: Tables) -> DataFrame:
    """Patterns as ways, two of three of them buildings."""
    tags = F.create_map(F.lit("building"), F.when(F.col("pattern_idx") % 3 != 0, "yes"))
    return t.pattern_stops.groupBy(F.col("pattern_idx")).agg(F.collect_list("stop_idx").alias("refs")).select(F.col("pattern_idx").alias("way_id"), tags.alias("tags"), "refs")


def places(t: Tables) -> DataFrame:
    """Stops as nodes."""
    return t.stops.select(F.col("stop_idx").alias("node"), "lat", "lon")


@query("src_09_building_cells", CELLS_SQL)
def _(t):
    return networks.building_cells(buildings(t), places(t))


@query("src_11_districts", f"SELECT ord, name, population, round(abs(0.0122::DOUBLE * 0.0166::DOUBLE) * {G.KM_PER_DEGREE**2 * G.LON_SHARE}::DOUBLE, 4) AS km2 FROM districts")
def _(t):
    path = shared_path(t.spark, "districts")
    ring = F.array(F.transform("ring", lambda p: F.array(p["lon"], p["lat"])))
    feature = F.struct(F.struct("name", "population").alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    whole = areas(t).groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", feature.alias("f")))), lambda x: x["f"]).alias("features"))  # a feature for each district
    whole.coalesce(1).write.json(path)
    return networks.districts(t.spark, path).select(F.col("ord").cast("int").alias("ord"), "name", "population", F.round(G.ring_area_km2(F.col("ring")), 4).alias("km2"))


@query("src_12_str_01_snapshots", "SELECT ts, route_id, trip_id, stop_sequence, delay, predicted FROM rt_obs")
def _(t):
    path = shared_path(t.spark, "snapshots")
    stops = F.collect_list(F.struct("stop_sequence", "delay", F.col("predicted").alias("time")))
    trips = t.rt_obs.groupBy("ts", "route_id", "trip_id").agg(stops.alias("stop_times"))
    trip = F.struct(F.concat(F.lit("feed:"), "trip_id").alias("trip_id"), F.concat(F.lit("feed:"), "route_id").alias("route_id"), "stop_times")
    trips.groupBy(F.col("ts").alias("timestamp")).agg(F.collect_list(trip).alias("trips")).write.json(path)  # a snapshot holds one poll
    return feeds.observations(feeds.snapshots(t.spark, path))


@query("src_13_station_status", "SELECT station_id::VARCHAR AS station_id, num_bikes, num_docks, is_installed, is_renting FROM stations")
def _(t):
    path = shared_path(t.spark, "status")
    own = t.stations.select(F.col("station_id").cast("string").alias("station_id"), F.col("num_bikes").alias("num_bikes_available"), F.col("num_docks").alias("num_docks_available"), "is_installed", "is_renting")
    own.agg(F.lit(60).alias("ttl"), F.struct(F.collect_list(F.struct(*own.columns)).alias("stations")).alias("data")).coalesce(1).write.json(path)  # one system's stations
    return feeds.station_status(t.spark, path).select("station_id", "num_bikes", "num_docks", "is_installed", "is_renting")


@query("src_17_rss_items", "SELECT 'http://x/' || p_partkey AS id, p_name AS title, 'about ' || p_brand AS text, '2024-03-' || lpad((1 + p_partkey % 28)::VARCHAR, 2, '0') AS date FROM part")
def _(t):
    path = shared_path(t.spark, "rss")
    day = (1 + F.col("p_partkey") % 28).cast("string")
    item = F.concat(
        F.lit("<item><title><![CDATA[<b>"), "p_name", F.lit("</b>]]></title><link>http://x/"), F.col("p_partkey").cast("string"), F.lit("</link><description><![CDATA[<p>about "), "p_brand",
        F.lit("</p>]]></description><pubDate>Fri, "), day, F.lit(" Mar 2024 08:00:00 +0100</pubDate></item>"),
    )
    # one feed is one document
    t.part.select(item.alias("item")).agg(F.concat(F.lit("<rss><channel>"), F.concat_ws("", F.collect_list("item")), F.lit("</channel></rss>")).alias("value")).coalesce(1).write.text(path)
    return feeds.rss_items(t.spark, path, "feed").select("id", "title", "text", "date")


@query("src_18_listing_links", "SELECT 'http://x/' || p_partkey AS href, p_name AS title FROM part")
def _(t):
    html = F.concat(F.lit('<ul><li><a class="n" href="http://x/'), F.col("p_partkey").cast("string"), F.lit('"> <b>'), "p_name", F.lit("</b>&nbsp;</a></li></ul>"))
    return feeds.listing_links(t.part.select(html.alias("html")))


@query("src_18_archived_links", """, x AS (SELECT event_id % 90 AS id, {ts} AS ts, 'item-' || event_id % 90 AS slug FROM events WHERE event_id % 7 <> 0)
SELECT id::VARCHAR AS id, any_value(slug) AS slug, 'Item ' || id AS title, 'https://x/news/item-' || id || '/' || id AS url, min(ts) AS ts, substr(min(ts), 1, 4) || '-' || substr(min(ts), 5, 2) || '-' || substr(min(ts), 7, 2) AS date FROM x GROUP BY id""".replace("{ts}", f"({EPOCH}::BIGINT * 10000 + (event_id * 7919) % 100003)::VARCHAR"))
def _(t):
    path, n = shared_path(t.spark, "listing"), (F.col("event_id") % 90).cast("string")
    ts = (F.lit(EPOCH * 10_000) + (F.col("event_id") * 7919) % 100_003).cast("string")
    section = F.when(F.col("event_id") % 7 != 0, "news").otherwise("other")
    t.events.select(F.concat(ts, F.lit(" http://x:80/"), section, F.lit("/item-"), n, F.lit("/"), n)).write.text(path)
    return feeds.archived_links(t.spark, path, "news")


HOURS = """, h AS (SELECT floor(event_id / 40)::BIGINT * 3600 AS hour_ts, event_type AS station_id, user_id % 3 AS starts, user_id % 5 AS returns, 1 AS samples, user_id % 17 AS bikes FROM events)
"""


def station_hours(t: Tables, rows: str) -> DataFrame:
    own = t.events.where(rows).groupBy((F.floor(F.col("event_id") / 40) * 3600).alias("hour_ts"), F.col("event_type").alias("station_id"))
    user = F.col("user_id")
    return own.agg(F.sum(user % 3).alias("starts"), F.sum(user % 5).alias("returns"), F.count("*").alias("samples"), F.min(user % 17).alias("min_bikes"), F.max(user % 17).alias("max_bikes"))


@query("snk_03_merged_hours", HOURS + "SELECT hour_ts, station_id, sum(starts)::BIGINT AS starts, sum(returns)::BIGINT AS returns, count(*) AS samples, min(bikes) AS min_bikes, max(bikes) AS max_bikes FROM h GROUP BY 1, 2")
def _(t):
    return feeds.merged_hours(station_hours(t, "event_id % 2 = 0"), station_hours(t, "event_id % 2 = 1"))


@query("snk_04_replaced", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS name FROM nation")
def _(t):
    old = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return feeds.replaced(old, old.where("id % 2 = 0").withColumn("name", F.lit("new")), ["id"])


@query("snk_09_documents", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def _(t):
    path = shared_path(t.spark, "documents")
    feeds.write_documents(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    return t.spark.read.schema("id long, name string").json(path)


@query("snk_10_without_orphans", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def _(t):
    return feeds.without_orphans(t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem.where("l_linenumber > 3").select(F.col("l_orderkey").alias("id")), "id")


@query("str_02_latest_snapshot", "SELECT event_id, route_id, trip_id FROM rt_obs WHERE ts = (SELECT max(ts) FROM rt_obs)")
def _(t):
    newest = t.rt_obs.agg(F.max("ts").alias("ts"))  # one row
    return t.rt_obs.join(F.broadcast(newest), "ts", "left_semi").select("event_id", "route_id", "trip_id")


# --- small operators with a query of their own ---------------------------------


@query("flt_14_gap_guards", f""", g AS (SELECT route_id, ts - lag(ts) OVER (PARTITION BY route_id ORDER BY ts) AS g FROM (SELECT DISTINCT route_id, ts - {EPOCH} AS ts FROM rt_obs)) SELECT route_id, count(*) AS gaps, max(g) AS longest FROM g WHERE g > 30 AND g < 3600 GROUP BY 1""")
def _(t):
    times = t.rt_obs.select("route_id", "ts").distinct()
    own = ordered.gaps_of(times, ["route_id"], "ts").where((F.col("gap") > realtime.HEADWAY_BOUNDS[0]) & (F.col("gap") < realtime.HEADWAY_BOUNDS[1]))
    return own.groupBy("route_id").agg(F.count("*").alias("gaps"), F.max("gap").alias("longest"))


@query("agg_72_busiest_stations", HOURS + "SELECT station_id, sum(starts)::BIGINT AS starts, sum(returns)::BIGINT AS returns, count(*) AS samples FROM h GROUP BY 1 ORDER BY starts DESC, station_id LIMIT 3")
def _(t):
    hours = station_hours(t, "true").withColumns({"sum_bikes": F.lit(0), "empty_samples": F.lit(0)})
    return bikes.station_ranking(hours).orderBy(F.desc("starts"), "station_id").limit(3).select("station_id", "starts", "returns", "samples")


@query("win_04_rolling_day", "SELECT event_id, max(delay) OVER (PARTITION BY route_id ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS peak FROM rt_obs")
def _(t):
    return realtime.rolling_peak(t.rt_obs.select("event_id", "route_id", "ts", "delay"), "delay", 86_400, ["route_id"]).select("event_id", "peak")


@query("win_09_shares", "SELECT o_orderkey AS id, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS of_most FROM orders")
def _(t):
    w, price = W.partitionBy("o_custkey"), F.col("o_totalprice").cast("double")
    return t.orders.select(F.col("o_orderkey").alias("id"), (price / F.sum(price).over(w)).alias("share"), (price / F.max(price).over(w)).alias("of_most")).withColumns(r6("share", "of_most"))


@query("win_12_next_on_circle", "SELECT s_suppkey AS id, coalesce(lead(b) OVER w, first(b) OVER w + 360) - b AS gap FROM (SELECT s_suppkey, s_nationkey, s_suppkey * 37 % 360 AS b FROM supplier) WINDOW w AS (PARTITION BY s_nationkey ORDER BY b, s_suppkey)")
def _(t):
    b = F.col("s_suppkey") * 37 % 360
    w = W.partitionBy("s_nationkey").orderBy(b, "s_suppkey")
    return t.supplier.select(F.col("s_suppkey").alias("id"), (F.coalesce(F.lead(b).over(w), F.first(b).over(w) + 360) - b).alias("gap"))


@query("sort_03_04_top_and_ties", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 20")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).orderBy("status", "id").limit(20)


@query("fn_02_district_slugs", "SELECT n_nationkey AS id, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("id"), T.slug(F.col("n_name")).alias("slug"))


@query("fn_10_local_hours", f"SELECT event_id, strftime(timezone('Europe/Zagreb', to_timestamp({EPOCH} + event_id * 3600)), '%Y-%m-%d') AS date, hour(timezone('Europe/Zagreb', to_timestamp({EPOCH} + event_id * 3600)))::INT AS hour FROM events")
def _(t):
    return bikes.local_hours(t.events.select("event_id", (F.lit(EPOCH) + F.col("event_id") * 3600).alias("hour_ts"))).select("event_id", "date", "hour")


@query("geo_03_polylines", "SELECT p_partkey AS id, p::INT AS pos, round(CASE p WHEN 0 THEN 38.5 WHEN 1 THEN 40.7 ELSE 43.252 END, 5) AS lat, round(CASE p WHEN 0 THEN -120.2 WHEN 1 THEN -120.95 ELSE -126.453 END, 5) AS lon FROM part, range(3) x(p)")
def _(t):
    lines = t.part.select(F.col("p_partkey").alias("id"), F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@").alias("line"))
    own = reach.polyline_points(lines, "id", "line")
    return own.select("id", F.col("pos").cast("int").alias("pos"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("set_05_distinct_boxes", "SELECT DISTINCT round(lat * 2000)::BIGINT AS y, round(lon * 2000)::BIGINT AS x FROM stops")
def _(t):
    return t.stops.select(N.round_to(F.col("lat") * 2000, 0).cast("long").alias("y"), N.round_to(F.col("lon") * 2000, 0).cast("long").alias("x")).distinct()


@query("join_06_counted_neighbours", "SELECT a.station_id, count(*) AS others FROM stations a JOIN stations b ON abs(a.lat - b.lat) < 1 AND a.station_id <> b.station_id AND a.capacity = b.capacity GROUP BY 1")
def _(t):
    near = spatial.range_join(t.stations, t.stations, 12.0).where("station_id <> r_station_id and capacity = r_capacity")
    return near.groupBy("station_id").agg(F.count("*").alias("others"))
