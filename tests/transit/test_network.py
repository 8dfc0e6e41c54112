"""Operators whose queries have no SQL, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from stopwise import queries as transit
from stopwise.functions import text as T
from stopwise.plans import network

transit.register()


def kept_by_rule(points, tolerance):
    """Douglas and Peucker's rule, recursively."""
    if len(points) < 3:
        return points
    (x0, y0), (x1, y1) = points[0], points[-1]
    dx, dy = x1 - x0, y1 - y0

    def away(p):
        size = dx * dx + dy * dy
        t = min(max(((p[0] - x0) * dx + (p[1] - y0) * dy) / size, 0), 1) if size else 0
        return math.hypot(p[0] - x0 - t * dx, p[1] - y0 - t * dy)

    far = max(range(1, len(points) - 1), key=lambda i: away(points[i]))
    if away(points[far]) <= tolerance:
        return [points[0], points[-1]]
    return kept_by_rule(points[: far + 1], tolerance)[:-1] + kept_by_rule(points[far:], tolerance)


def test_simplified_lines(spark):
    rng = random.Random(4)
    lines = {k: [(i * 0.01, rng.random() * 0.02) for i in range(n)] for k, n in enumerate((1, 2, 30, 200))}
    rows = [(k, i, y, x) for k, line in lines.items() for i, (x, y) in enumerate(line)]
    df = spark.createDataFrame(rows, "k long, pos long, lat double, lon double")
    got = {}
    for r in sorted(network.simplified(df, "k", 0.006).collect(), key=lambda r: (r["k"], r["pos"])):
        got.setdefault(r["k"], []).append((r["lon"], r["lat"]))
    assert got == {k: kept_by_rule(line, 0.006) for k, line in lines.items()}


def test_station_names(spark):
    raw = ["TRG KRALJA TOMISLAVA", "UL. GRADA VUKOVARA - TRG  HAK", "V. HEINZELA I KBC", "Already Cased NAME", "", "PARK"]
    want = ["Trg kralja Tomislava", "Ul. grada Vukovara - Trg HAK", "V. Heinzela i KBC", "Already Cased NAME", "", "Park"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, s string")
    assert [r["n"] for r in df.select("i", T.station_name(F.col("s")).alias("n")).orderBy("i").collect()] == want


def test_near_doubles_keep_the_first(spark):
    rows = [
        (1, 1, "Ilica", 45.0, 15.0), (1, 2, "ILICA", 46.0, 15.0), (1, 3, "Ilica 5", 45.0001, 15.0001), (1, 4, "Ilica 7", 45.01, 15.0), (1, 5, "Ilica 7", 45.02, 15.0), (2, 9, "Ilica", 45.0, 15.0),
    ]
    df = spark.createDataFrame(rows, "q long, o long, title string, lat double, lon double")
    assert sorted((r["q"], r["o"]) for r in network.without_near_doubles(df, "q", "o").collect()) == [(1, 1), (1, 4), (1, 5), (2, 9)]


def test_maps_follow_the_arrivals(spark, sf_dir):
    """Line features, payload and matrix recomputed from the labels."""
    run = lambda name: transit.QUERIES[name](spark, sf_dir).collect()
    t = transit.Tables(spark, sf_dir)
    from stopwise.bindings.town import isochrone_labels

    cost = {(r["source"], r["node"]): r["cost"] for r in isochrone_labels(t, 1800.0).collect()}
    mode = {r["pattern_idx"]: r["mode"] for r in t.departures.select("pattern_idx", "mode").distinct().collect()}
    stops = {(r["pattern_idx"], r["stop_pos"]): r["stop_idx"] for r in t.pattern_stops.collect()}
    legs = [(mode[p], v, stops[p, i + 1]) for (p, i), v in stops.items() if (p, i + 1) in stops and mode[p] != "RAIL"]
    minutes = {}
    for s in {s for s, _ in cost}:
        for _, a, b in legs:
            if (s, a) in cost and (s, b) in cost:
                key = s, math.floor(min(cost[s, a], cost[s, b]) / 60)
                minutes[key] = minutes.get(key, 0) + 1
    assert {(r["source"], r["minute"]): r["segments"] for r in run("graph_09_line_features")} == minutes
    payload = run("graph_10_payload")
    assert {(r["source"], r["node"]) for r in payload} == set(cost)
    for s in {s for s, _ in cost}:
        refs = sorted({r["pattern_ref"] for r in payload if r["source"] == s and r["pattern_ref"] is not None})
        assert refs == list(range(len(refs)))
    assert all(r["minutes"] > 0 and r["origin"] != r["dest"] for r in run("graph_13_travel_matrix"))
