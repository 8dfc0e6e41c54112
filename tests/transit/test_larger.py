"""Plans that must not grow with the square of rows that share a time, a place or a key, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise import queries
from stopwise.bindings import Tables, town
from stopwise.bindings import reach as reach_bindings
from stopwise.functions.geometry import KM_PER_DEGREE, LON_SHARE
from stopwise.operators import graph_tasks, journeys, spatial
from stopwise.plans import isochrone as iso
from stopwise.plans import reach, realtime

queries.register()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rolling_peak_equals_a_plain_search_without_sliding_frames(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 5 + ["k", None]), rng.choice([None] + [rng.randrange(-90, 400) for _ in range(12)]), rng.choice([None, *range(-50, 50)])) for i in range(500)]
    series = spark.createDataFrame(rows, "id int, k string, ts long, v int")
    got = realtime.rolling_peak(series, "v", 60, ["k"])
    # a frame that slides is searched anew for each row
    assert "RangeFrame, -" not in plan_of(got)

    def peak(k, t):
        seen = [v for _, rk, rt, v in rows if rk == k and v is not None and (rt is t if t is None else rt is not None and t - 60 <= rt <= t)]
        return max(seen, default=None)

    assert got.columns == ["id", "k", "ts", "v", "peak"]
    assert {r["id"]: r["peak"] for r in got.collect()} == {i: peak(k, t) for i, k, t, _ in rows}


def km(a, b):
    dy, dx = (b[0] - a[0]) * KM_PER_DEGREE, (b[1] - a[1]) * (KM_PER_DEGREE * LON_SHARE)
    return (dx * dx + dy * dy) ** 0.5


def crowded(spark, n=300, sites=12, seed=4):
    """(rows, frame) of n points at few sites: id, lat, lon."""
    rng = random.Random(seed)
    at = [(45.8 + rng.randrange(9) * 0.003, 15.9 + rng.randrange(9) * 0.004) for _ in range(sites)]
    rows = [(i, *rng.choice(at)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, lat double, lon double")


def most_rows(df, operator):
    """The greatest number of rows that an operator of the run plan put out."""
    df.collect()
    seen, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif operator in name and node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(seen)


def test_readouts_around_points_of_the_same_place_meet_once(spark):
    rows, frame = crowded(spark)
    points = frame.withColumnRenamed("id", "point_id")
    stops = frame.selectExpr("id as stop_idx", "lat", "lon", "concat('N', id % 40) as name")
    places = frame.selectExpr("concat('P', id % 50) as name", "lat", "lon", "id % 3 as category")
    served = spark.createDataFrame([(i, f"L{i % 4}", float(i % 17)) for i in range(0, 300, 11)], "stop_idx long, route string, headway_min double")
    around, lines, nearest = reach.stops_around(points, stops), reach.lines_around(points, stops, served), reach.nearest_places(points, places)
    for i, lat, lon in rows:
        near = sorted((km((lat, lon), (b, c)), j) for j, b, c in rows)
        best, names = [], set()
        for d, j in near:
            if d <= 0.8 and j % 40 not in names:
                names.add(j % 40)
                best.append((i, len(best) + 1, f"N{j % 40}", j))
        assert [tuple(r)[:4] for r in sorted(around.collect()) if r[0] == i] == best[:3]
        if i == 30:  # a few points of the same places suffice
            break
    want = {}
    for i, lat, lon in rows:
        for j, b, c in rows:
            d = km((lat, lon), (b, c))
            if d <= 0.45 and j % 11 == 0:
                want[i, f"L{j % 4}"] = min(want.get((i, f"L{j % 4}"), 99.0), float(j % 17))
    assert {(r["point_id"], r["route"]): r["headway_min"] for r in lines.collect()} == want
    first = {}
    for i, lat, lon in rows:
        for j, b, c in rows:
            d = km((lat, lon), (b, c))
            if d <= 1.2:
                first[i, j % 3] = min(first.get((i, j % 3), (99.0, "")), (d, f"P{j % 50}"))
    got = {(r["point_id"], r["category"]): (r["dist_km"], r["name"]) for r in nearest.collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in first.items()}
    assert all(got[k][0] == pytest.approx(first[k][0]) for k in got)
    # 300 points on 12 sites: all pairs would be 90,000 rows
    assert max(most_rows(x, "Join") for x in (around, lines, nearest)) < 3_000


def test_pairs_of_points_of_the_same_places_are_unfolded_last(spark):
    rows, frame = crowded(spark)
    at = spatial.placed(frame, "id")
    places = at.where("id = place").select("place", "lat", "lon")
    near = spatial.range_join(places, places, 0.4).selectExpr("place as a", "r_place as b")
    got = spatial.each_member(near, spatial.members(at, "id", 7), "a", "b").select("a", "b")
    want = sorted((i, j) for i, *p in rows for j, *q in rows if km(p, q) <= 0.4)
    assert sorted(map(tuple, got.collect())) == want
    assert most_rows(got, "Join") < len(want) / 5
    lost = spark.createDataFrame([(1, None, 15.9), (2, None, 15.9), (3, 45.8, float("nan")), (4, 45.8, float("nan")), (5, 45.8, 15.9), (6, 45.8, 15.9)], "id long, lat double, lon double")
    assert {r["id"]: r["place"] for r in spatial.placed(lost, "id").collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}


def test_stops_within_300m_do_not_join_every_pair(spark, tmp_path):
    """120 stops at each of two places 62 m apart."""
    spark.range(240).selectExpr("case when id < 120 then id * 10403 else (id - 120) * 10403 + 4848 end as c_custkey", "'n' as c_name", "0 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["join_03_stops_within_300m"](spark, str(tmp_path))
    far = got.selectExpr("count(*) as n", "count(distinct stop_idx, other_idx) as d", "count(distinct dist_km) as k").first()
    stops = [(r["stop_idx"], r["lat"], r["lon"]) for r in Tables(spark, str(tmp_path)).stops.collect()]
    want = {(a, b) for a, *p in stops for b, *q in stops if a != b and km(p, q) <= 0.3}
    assert far["n"] == far["d"] == len(want)
    assert {(r["stop_idx"], r["other_idx"]) for r in got.collect()} == want
    assert most_rows(got, "Join") < 100


def test_single_linkage_links_cells_not_pairs_of_points(spark):
    rng = random.Random(8)
    rows = [(i, 45.8 + rng.random() * 0.03, 15.9 + rng.random() * 0.04, rng.choice(["a"] * 3 + ["b", None])) for i in range(260)]
    rows += [(300 + i, *rows[i][1:3], rows[i][3]) for i in range(60)] + [(400, None, 15.9, "a"), (401, float("nan"), 15.9, "a"), (402, float("nan"), 15.9, "a")]
    frame = spark.createDataFrame(rows, "id long, lat double, lon double, k string")
    root = {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, *p, k in rows:
        for j, *q, other in rows:
            if k is not None and k == other and None not in (*p, *q) and km(p, q) <= 0.25:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {}
    for i, *_, k in rows:
        want[k, top(i)] = want.get((k, top(i)), 0) + 1
    got = spatial.single_linkage(frame, "id", 0.25, "k")
    assert {(r["k"], r["component"]): r["n"] for r in got.collect()} == want


def test_components_get_links_of_cells(spark, monkeypatch):
    """All 300 points are in one cell: nothing is left to link."""
    frame = spark.range(300).selectExpr("id", "45.8 + id * 1e-6 as lat", "15.9 + id % 7 * 1e-6 as lon", "1 as k")
    links = []
    plain = spatial.components
    monkeypatch.setattr(spatial, "components", lambda pairs, nodes, *a: links.append(pairs.count()) or plain(pairs, nodes, *a))
    own = spatial.single_linkage(frame, "id", 0.5, "k").collect()
    assert [(r["component"], r["n"]) for r in own] == [(0, 300)]
    assert links[0] < 10


def test_least_costs_go_on_from_changed_nodes_only(monkeypatch):
    """A line of 400 nodes, searched up to a cost of 3: few edges are looked at."""
    n = 400
    src = np.concatenate([np.arange(n - 1), np.arange(1, n)])
    dst = np.concatenate([np.arange(1, n), np.arange(n - 1)])
    order = np.lexsort((dst, src))
    g = graph_tasks.Graph(np.arange(n), src[order], dst[order], np.ones(len(src)), np.searchsorted(src[order], np.arange(n + 1)))
    looked, plain = [], graph_tasks.spread
    monkeypatch.setattr(graph_tasks, "spread", lambda a, b: looked.append(int((b - a).sum())) or plain(a, b))
    cost = graph_tasks.least_costs(g, np.arange(0, n, 50), 3.0)
    far = np.abs(np.arange(n)[None, :] - np.arange(0, n, 50)[:, None]).astype(float)
    assert np.array_equal(cost, np.where(far <= 3.0, far, np.inf))
    assert sum(looked) <= 8 * 7 * 2


def test_shortest_paths_between_places_are_unfolded(spark, tmp_path):
    """60 stops at each of two places: rows for every pair of stops, one search for each place."""
    spark.range(120).selectExpr("case when id < 60 then id * 10403 else id * 10403 + 4848 end as c_custkey", "'n' as c_name", "0 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["graph_11_shortest"](spark, str(tmp_path))
    nodes = [(r["walk_node"], (r["lat"], r["lon"])) for r in town.street_nodes(Tables(spark, str(tmp_path))).collect()]
    want = {(a, b): round(int(km(p, q) * 100000) * 0.0072, 6) for a, p in nodes for b, q in nodes}
    assert len({p for _, p in nodes}) == 2
    assert {(r["source"], r["node"]): r["cost"] for r in got.collect()} == want
    assert got.count() == len(want) and most_rows(got, "Join") < 400


def test_reach_by_places_equals_reach_by_stops(spark, tmp_path):
    """Three stops at each place and some lines: cells and labels as of a network of all stops."""
    for name in ("supplier", "lineitem", "nation", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_custkey < 80").selectExpr("explode(array(c_custkey, c_custkey + 10403, c_custkey + 5 * 10403)) as c_custkey", "c_name", "c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    t = Tables(spark, str(tmp_path))
    at = town.place_stops(t)
    assert 80 <= at.count() < 240 and town.place_nodes(t).count() == 80
    nodes, seeds = town.street_nodes(t), iso.straight_seeds(town.origins(t), town.stops(t))
    labels = journeys.labels(seeds, town.score_network(t), town.EIGHT, 1200.0, iso.SCORE).cache()
    want = iso.walked_cells(labels, town.origins(t), town.stops(t), nodes, town.streets(nodes), 1200.0)
    got = reach_bindings.reached_cells(t, [town.EIGHT], 1200.0)
    assert {(r["point_id"], r["cells"]) for r in got.collect()} == {tuple(r) for r in want.collect()}
    # each stop has the time of its place
    own = town.arrivals(t, at, town.EIGHT, 1200.0).withColumnRenamed("node", "place").join(town.stop_places(t), "place").select("source", "stop_idx", "cost")
    have = labels.join(town.stops(t), F.col("node") == F.col("stop_idx"), "left_semi")  # some calls are at stops that are not in the table
    assert {tuple(r) for r in own.collect()} == {(r["source"], r["node"], r["cost"]) for r in have.collect()}


def test_walks_are_followed_in_short_windows(monkeypatch):
    """400 nodes on a line, all of them seeds: each node's links are looked at about once."""
    n = 400
    src = np.concatenate([np.arange(n - 1), np.arange(1, n)])
    dst = np.concatenate([np.arange(1, n), np.arange(n - 1)])
    order = np.lexsort((dst, src))
    none = np.zeros(0, np.int64)
    first = np.searchsorted(src[order], np.arange(n + 1))
    a = journeys._Arrays(np.arange(n), first, dst[order], np.full(len(src), 30.0), np.full(len(src), journeys.WALK), np.zeros(n + 1, np.int64), none, none, none, none, none, none, none, none, none, np.zeros(1, np.int64), none, np.zeros((0, 0)), float("inf"))
    looked, plain = [], journeys.spread
    monkeypatch.setattr(journeys, "spread", lambda lo, hi: looked.append(int((hi - lo).sum())) or plain(lo, hi))
    cost = np.arange(n)[::-1] * 40.0
    at, _ = journeys._settle(a, journeys.Rules(), (np.zeros(n, np.int64), np.arange(n), cost), 1, 0.0, 20_000.0)
    assert np.array_equal(at.cost[0], np.arange(n)[::-1] * 30.0)
    assert sum(looked) < 4 * len(src)
