"""Reach of places by timetable, on foot through the streets and by bike: seeds, labels, cells, bands, centrality.

Two sets of rules are in use.  Isochrones walk through the street graph to the
first stops, wait for the first departure at most two minutes, half a headway
later, and follow delays.  Scores walk in a straight line to stops within 1.2 km,
wait half a headway everywhere and pay two minutes for a transfer.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import REACH_CELL
from ..functions.numbers import js_round, round_to
from ..operators import journeys, rasters
from ..operators.journeys import BIKE, WALK, Network, Rules
from ..operators.ordered import first_by
from ..operators.spatial import containing, nearest_join, range_join
from ..shared import written
from .network import cells_on_line

#: km/h on foot and by bike, the detour of walks, seconds of a transfer, of picking up and returning a bike, km of walks and rides.
WALK_KMH, BIKE_KMH, DETOUR = 5.0, 14.0, 1.35
TRANSFER_SEC, BIKE_SEC = 120.0, 90.0
SEED_KM, TRANSFER_KM, BIKE_WALK_KM, BIKE_KM = 1.2, 0.3, 0.35, 6.0
ORIGIN_SNAP_KM, STOP_SNAP_KM = 0.25, 0.09
#: Seconds of a centimetre on foot, and the longest walk to a first stop.
CM_SEC, SEED_SEC = 0.0072, 864.0
ISOCHRONE = Rules(first_wait=120.0)
SCORE = Rules()
#: Stations of bikes have ids from here on among the nodes.
STATION = 1 << 40


def walk_sec(km: Column, detour: float = 1.0) -> Column:
    return (km * detour / WALK_KMH if detour != 1.0 else km / WALK_KMH) * 3600.0


def transfers(stops: DataFrame, detour: float = 1.0, penalty: float = TRANSFER_SEC) -> DataFrame:
    """Links on foot between stops (stop_idx, lat, lon) within 300 m."""
    near = range_join(stops, stops, TRANSFER_KM).where("stop_idx <> r_stop_idx")
    return near.select(F.col("stop_idx").alias("src"), F.col("r_stop_idx").alias("dst"), (walk_sec(F.col("dist_km"), detour) + penalty).alias("sec"), F.lit(WALK).alias("kind"))


def bike_links(stops: DataFrame, stations: DataFrame, detour: float = 1.0) -> DataFrame:
    """Links between stops and stations (station_id, lat, lon) on foot, and between stations by bike."""
    at = stations.select((F.col("station_id") + STATION).alias("s"), "lat", "lon")
    near = range_join(at, stops, BIKE_WALK_KM)
    there = near.select(F.col("s").alias("src"), F.col("r_stop_idx").alias("dst"), walk_sec(F.col("dist_km"), detour).alias("sec"), F.lit(WALK).alias("kind"))
    ride = range_join(at, at, BIKE_KM).where("s <> r_s").select(F.col("s").alias("src"), F.col("r_s").alias("dst"), (F.lit(BIKE_SEC) + F.col("dist_km") / BIKE_KMH * 3600.0).alias("sec"), F.lit(BIKE).alias("kind"))
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sec", "kind")).unionByName(ride)


def snapped(places: DataFrame, nodes: DataFrame, key: str, km: float, detour: float = 1.0) -> DataFrame:
    """(key, walk_node, snap_sec): the nearest street node of each place; none further than km."""
    near = nearest_join(places.select(key, "lat", "lon"), nodes.select("walk_node", "lat", "lon"), km, key, "walk_node")
    return near.select(key, F.col("r_walk_node").alias("walk_node"), walk_sec(F.col("dist_km"), detour).alias("snap_sec"))


def _calls() -> str:
    return "pattern_idx long, stop_pos int, node long, offset_sec double"


def on_foot(seeds: DataFrame, streets: DataFrame, below: float) -> DataFrame:
    """(source, node, cost) of the street nodes reached in less than so many seconds from seeds (source, node, cost); streets: src, dst, dist_cm."""
    spark = seeds.sparkSession
    links = streets.select("src", "dst", (F.col("dist_cm").cast("double") * CM_SEC).alias("sec"), F.lit(WALK).alias("kind"))
    net = Network(spark.createDataFrame([], _calls()), spark.createDataFrame([], "pattern_idx long, dep_sec double"), links)
    found = journeys.labels(seeds.where(F.col("cost") < below), net, 0.0, below)
    return found.where(F.col("cost") < below).select("source", "node", "cost")


def street_seeds(origins: DataFrame, stops: DataFrame, nodes: DataFrame, streets: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """(source, node, cost): stops that origins (source, lat, lon) reach through the streets, and stations in a straight line."""
    own = snapped(origins, nodes, "source", ORIGIN_SNAP_KM, DETOUR)
    walked = on_foot(own.select("source", F.col("walk_node").alias("node"), F.col("snap_sec").alias("cost")), streets, SEED_SEC)
    at = snapped(stops, nodes, "stop_idx", STOP_SNAP_KM)
    found = walked.join(at, F.col("node") == F.col("walk_node")).groupBy("source", F.col("stop_idx").alias("node")).agg(F.min(F.col("cost") + F.col("snap_sec")).alias("cost"))
    if stations is None:
        return found
    near = range_join(origins, stations.select((F.col("station_id") + STATION).alias("s"), "lat", "lon"), SEED_KM)
    return found.unionByName(near.select("source", F.col("r_s").alias("node"), walk_sec(F.col("dist_km"), DETOUR).alias("cost")))


def straight_seeds(origins: DataFrame, stops: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """(source, node, cost): stops and stations within 1.2 km of origins, in a straight line."""
    at = stops.select(F.col("stop_idx").alias("to"), "lat", "lon")
    if stations is not None:
        at = at.unionByName(stations.select((F.col("station_id") + STATION).alias("to"), "lat", "lon"))
    near = range_join(origins, at, SEED_KM)
    return near.select("source", F.col("r_to").alias("node"), walk_sec(F.col("dist_km")).alias("cost"))


def without_modes(net: Network, modes: Iterable[str], lines: DataFrame) -> Network:
    """The network without the patterns (pattern_idx, mode) of some modes."""
    gone = lines.where(F.col("mode").isin(*modes)).select("pattern_idx").distinct()
    return net._replace(calls=net.calls.join(gone, "pattern_idx", "left_anti"), departures=net.departures.join(gone, "pattern_idx", "left_anti"))


def walked_cells(labels: DataFrame, origins: DataFrame, stops: DataFrame, nodes: DataFrame, streets: DataFrame, cap: float, stations: DataFrame | None = None) -> DataFrame:
    """(source, cells): distinct cells of the street nodes that are reached in less than cap seconds, from the origin and from labels (source, node, cost).

    Cells cut degrees towards zero, as whole numbers are cut.
    """
    own = snapped(origins, nodes, "source", ORIGIN_SNAP_KM).select("source", F.col("walk_node").alias("node"), F.col("snap_sec").alias("cost"))
    at = snapped(stops, nodes, "stop_idx", STOP_SNAP_KM).withColumnRenamed("stop_idx", "at")
    if stations is not None:
        near = snapped(stations.select((F.col("station_id") + STATION).alias("at"), "lat", "lon"), nodes, "at", STOP_SNAP_KM)
        at = at.unionByName(near)
    seeds = labels.where(F.col("cost") < cap).join(at, F.col("node") == F.col("at")).select("source", F.col("walk_node").alias("node"), (F.col("cost") + F.col("snap_sec")).alias("cost"))
    cut = lambda c: F.col(c).__mul__(F.lit(1.0 / REACH_CELL)).cast("long")
    cells = nodes.select("walk_node", cut("lat").alias("cy"), cut("lon").alias("cx"))
    reached = on_foot(own.unionByName(seeds), streets, cap)
    return reached.join(cells, F.col("node") == F.col("walk_node")).select("source", "cy", "cx").distinct().groupBy("source").agg(F.count("*").alias("cells"))


BAND = ["source", "band"]
BANDS = (300, 600, 900, 1200, 1800)
#: Side of a cell of outlines in degrees.
RASTER = 0.001


def raster(reached: DataFrame, streets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, cy, cx, sec): cells along streets whose both ends (source, node, cost) are reached, with the least time, which grows evenly along a street."""
    a = nodes.select(F.col("walk_node").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = nodes.select(F.col("walk_node").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    ways = streets.where("src < dst").select("src", "dst").join(a, "src").join(b, "dst")
    one = reached.select("source", F.col("node").alias("src"), F.col("cost").alias("sec1"))
    two = reached.select("source", F.col("node").alias("dst"), F.col("cost").alias("sec2"))
    return cells_on_line(one.join(ways, "src").join(two, ["source", "dst"]), ["source"], RASTER)


def band_cells(cells: DataFrame, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """(source, band, cx, cy): cells (source, cy, cx, sec) within each band, gaps closed."""
    each = F.explode(F.filter(F.array(*map(F.lit, bands)), lambda b: F.col("sec") <= b)).alias("band")
    return rasters.closed(cells.select("source", each, "cx", "cy"), BAND)


def band_shapes(filled: DataFrame, least_points: int = 9) -> DataFrame:
    """(source, band, rings): outlines of each band as a MultiPolygon of one ring each, corners rounded, points [lon, lat] closed with the first."""
    kept = rasters.without_small(rasters.rings(filled, BAND), BAND, least_points)
    soft = rasters.held_in(rasters.corners_cut(kept, BAND), filled, BAND)
    ordered = soft.groupBy(*BAND, "ring").agg(F.sort_array(F.collect_list(F.struct("pos", F.array(F.col("x") * RASTER, F.col("y") * RASTER).alias("p"))))["p"].alias("line"))
    closed = ordered.select(*BAND, "ring", F.concat("line", F.slice("line", 1, 1)).alias("line"))
    return closed.groupBy(*BAND).agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "line"))), lambda r: F.array(r["line"])).alias("rings"))


def sample_points(places: DataFrame, areas: DataFrame, step: float, cell: float = 0.003) -> DataFrame:
    """(source, row, col, lat, lon, area): points of a grid over the box of all places, in the first area that holds them, where a place lies in one of the nine cells around.

    Points are made from the cells of the places, not from the box: a point without
    a place near it would be dropped.
    """
    k = int(-(-2 * cell // step)) + 1
    near = places.select(F.floor(F.col("lat") / step).alias("y"), F.floor(F.col("lon") / step).alias("x")).distinct()
    box = places.agg(*[f(F.floor(F.col(c) / step)).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))])
    span = F.sequence(F.lit(-k), F.lit(k))
    grid = near.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).select((F.col("y") + F.col("dy")).alias("row"), (F.col("x") + F.col("dx")).alias("col")).distinct()
    inside = F.col("row").between(F.col("low_lat"), F.col("high_lat")) & F.col("col").between(F.col("low_lon"), F.col("high_lon"))
    grid = grid.join(F.broadcast(box), inside).select("row", "col", (F.col("row") * F.lit(step)).alias("lat"), (F.col("col") * F.lit(step)).alias("lon"))  # one row
    own = rasters.dilated(places.select(F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy")), [])
    lived = grid.withColumns({"cy": F.floor(F.col("lat") / cell), "cx": F.floor(F.col("lon") / cell)}).join(own, ["cx", "cy"], "left_semi").drop("cx", "cy")
    point = lived.withColumn("source", F.shiftleft(F.col("row"), 32) + F.col("col"))
    return containing(point, areas, "source").where("area is not null").select("source", "row", "col", "lat", "lon", "area")


def scoring_pass(origins: DataFrame, net: Network, stops: DataFrame, nodes: DataFrame, streets: DataFrame, departures: list[float], cap: float, stations: DataFrame | None = None) -> DataFrame:
    """(source, cells): mean cells over the departures, halves up; a departure without cells counts 0."""
    seeds = written(straight_seeds(origins, stops, stations))
    total = None
    for depart in departures:
        own = walked_cells(journeys.labels(seeds, net, depart, cap, SCORE), origins, stops, nodes, streets, cap, stations)
        total = own if total is None else total.unionByName(own)
    per = total.groupBy("source").agg(F.sum("cells").alias("n"))
    return origins.select("source").join(per, "source", "left").select("source", js_round(F.coalesce("n", F.lit(0)) / float(len(departures))).cast("long").alias("cells"))


def centrality(nodes: DataFrame, net: Network, depart: float, cap: float) -> DataFrame:
    """Rows of path_shares with sums, every node (node) as a source; written, since several results are made of it."""
    seeds = nodes.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))
    return written(journeys.path_shares(seeds, net, depart, cap, SCORE, sums=True))


def betweenness(shares: DataFrame, n: int) -> DataFrame:
    """Shares of each node summed over all sources, over (n - 1)(n - 2)."""
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    return shares.where("source = -1").groupBy("node").agg((F.sum("delta") / scale).alias("betweenness"))


def closeness(shares: DataFrame, n: int) -> DataFrame:
    """Per source: others reached, the mean time, the farthest and (reached / (n - 1)) * (reached / sum) * 3600."""
    own = shares.where("source <> -1")
    value = F.col("reached") / float(max(1, n - 1)) * (F.col("reached") / F.col("cost")) * 3600.0
    return own.select("source", "reached", (F.col("cost") / F.col("reached")).alias("mean_cost"), "farthest", F.when(F.col("cost") > 0, value).otherwise(0.0).alias("closeness"))


def path_summary(shares: DataFrame, n: int) -> DataFrame:
    """Diameter with its ends (the first source of equals), mean path in minutes, reachable pairs and their percentage."""
    own = shares.where("source <> -1")
    far = F.max_by(F.struct("source", "node"), F.struct("farthest", (-F.col("source")).alias("s")))
    summed = own.agg(F.max("farthest").alias("d"), far.alias("ends"), F.sum("cost").alias("c"), F.sum("reached").alias("p"))
    pairs = float(max(1, n * (n - 1)))
    return summed.select(round_to(F.col("d") / 60.0, 2).alias("diameter_min"), F.col("ends.source").alias("from_node"), F.col("ends.node").alias("to_node"), round_to(F.col("c") / F.col("p") / 60.0, 2).alias("mean_min"), F.col("p").alias("pairs"), round_to(F.col("p") / pairs * 100.0, 2).alias("reachable_pct"))


def stations_in_bands(labels: DataFrame, named: DataFrame, bands: tuple[int, ...] = (900, 1800, 2700)) -> DataFrame:
    """Per source: distinct names (node, slug) reached within each band, without the source's own."""
    own = named.select(F.col("node").alias("source"), F.col("slug").alias("_own"))
    met = labels.join(named, "node").join(own, "source").where((F.col("slug") != "") & (F.col("slug") != F.col("_own")))
    first = met.groupBy("source", "slug").agg(F.min("cost").alias("cost"))
    return first.groupBy("source").agg(*[F.sum((F.col("cost") <= b).cast("long")).alias(f"stations_{b // 60}") for b in bands])


def itinerary_chain(labels: DataFrame, goals: DataFrame, most: int = 10_000) -> DataFrame:
    """Legs of the way from each goal (source, goal) back to its first stop: source, goal, back (0 is the last leg) and the leg's label."""
    legs = labels.select("source", "node", "kind", "pred", "pattern_idx", "board", "alight")
    now, out = goals.select("source", "goal", F.col("goal").alias("node"), F.lit(0).alias("back")), None
    for _ in range(most):
        step = written(now.join(legs, ["source", "node"]).where(F.col("pred") >= 0))
        out = step if out is None else out.unionByName(step)
        if step.isEmpty():
            return out
        now = step.select("source", "goal", F.col("pred").alias("node"), (F.col("back") + 1).alias("back"))
    raise RuntimeError(f"a way is longer than {most} legs")


def terminals(labels: DataFrame, places: DataFrame, goals: DataFrame, km: float = 20_000.0) -> DataFrame:
    """(source, goal_id, goal): for each pair of a source and a destination (source, goal_id, lat, lon), the label with the least time and straight walk."""
    met = labels.join(places, "node").join(goals.withColumnsRenamed({"lat": "g_lat", "lon": "g_lon"}), "source")
    from ..functions.geometry import flat_km

    away = flat_km(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon"))
    scored = met.withColumn("_s", F.col("cost") + walk_sec(away)).where(away <= km)
    return first_by(scored, ["source", "goal_id"], "_s", "node").select("source", "goal_id", F.col("node").alias("goal"))


def retimed(chain: DataFrame, first: DataFrame, net: Network, links: DataFrame, depart: float, rules: Rules = ISOCHRONE) -> DataFrame:
    """Legs in order with their seconds: walks and bikes take their link's, rides are boarded anew at the clock that the legs before them give.

    chain is of itinerary_chain, first holds (source, node, cost), the walk to the
    first stop; a ride whose pattern has left for good takes its scheduled time.
    A round times the next leg of all ways at once, its departure found by an
    as-of search in the pattern's day.
    """
    from pyspark.sql.window import Window as W

    own = W.partitionBy("source", "goal")
    legs = chain.withColumn("leg", F.max("back").over(own) - F.col("back"))
    last = legs.agg(F.max("leg")).first()[0]
    if last is None:
        return legs.select("source", "goal", "leg", "kind", F.col("pred").alias("from_node"), "node", "pattern_idx", F.lit(0.0).alias("start"), F.lit(0.0).alias("seconds"))
    w = W.partitionBy("pattern_idx").orderBy("dep_sec")
    headway = F.coalesce(F.col("dep_sec") - F.lag("dep_sec").over(w), F.lead("dep_sec").over(w) - F.col("dep_sec"), F.lit(rules.lone_headway))
    days = net.departures.select("pattern_idx", "dep_sec", headway.alias("headway")).groupBy("pattern_idx").agg(F.sort_array(F.collect_list(F.struct("dep_sec", "headway"))).alias("day"))
    call = lambda name: net.calls.select("pattern_idx", F.col("stop_pos").alias(name), F.col("offset_sec").alias(f"{name}_off"))
    link = links.select(F.col("src").alias("pred"), F.col("dst").alias("node"), "kind", "sec").groupBy("pred", "node", "kind").agg(F.min("sec").alias("sec"))
    legs = legs.join(call("board"), ["pattern_idx", "board"], "left").join(call("alight"), ["pattern_idx", "alight"], "left").join(days, "pattern_idx", "left").join(link, ["pred", "node", "kind"], "left")
    legs = written(legs)
    now = legs.where("leg = 0").join(first.select("source", F.col("node").alias("pred"), F.col("cost").alias("start")), ["source", "pred"], "left").select("source", "goal", F.coalesce("start", F.lit(0.0)).alias("start"), F.lit(False).alias("ridden"))
    out = None
    for leg in range(last + 1):
        met = legs.where(F.col("leg") == leg).join(now, ["source", "goal"])
        d = F.get(F.filter("day", lambda x: x["dep_sec"] >= F.lit(depart) + F.col("start") - F.col("board_off")), 0)
        met = met.withColumn("d", d)
        ride = F.col("alight_off") - F.col("board_off")
        exact = F.col("d.dep_sec") + F.col("board_off") - (F.lit(depart) + F.col("start"))
        expected = F.least(F.least("d.headway", F.lit(rules.most_headway)) / 2.0, F.lit(rules.most_wait))
        wait = F.when(F.col("ridden") | F.lit(rules.first_wait is None), expected).when(exact <= rules.most_wait, F.least(exact, F.lit(rules.first_wait or 0.0)))
        seconds = F.when(F.col("kind") == journeys.RIDE, js_round(ride + F.coalesce(wait, F.lit(0.0)))).otherwise(F.col("sec"))
        step = written(met.select("source", "goal", "leg", "kind", F.col("pred").alias("from_node"), "node", "pattern_idx", "start", seconds.cast("double").alias("seconds"), "ridden"))
        out = step.drop("ridden") if out is None else out.unionByName(step.drop("ridden"))
        now = step.select("source", "goal", (F.col("start") + F.col("seconds")).alias("start"), (F.col("ridden") | (F.col("kind") == journeys.RIDE)).alias("ridden"))
    return out
