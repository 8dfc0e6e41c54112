"""As-of joins in spans, waits between routes and components against plain loops."""

import random

import pytest

from stopwise.operators import ordered, spatial
from stopwise.plans import schedule


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_as_of_equals_a_plain_search(spark, width):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 6 + ["k", "only", None])
    time = lambda: rng.choice([None] + [rng.randrange(-40, 160) for _ in range(15)])
    left = [(i, key(), time()) for i in range(400)] + [(400, "hot", 9), (401, "hot", 9), (402, "none", 3)]
    right = [(k if k != "only" else "other", t) for k, t in ((key(), time()) for _ in range(60))] + [("hot", 9), ("hot", 9)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, u int")
    up, down = ordered.next_at_or_after(a, b, ["k"], "t", "u", "x", width), ordered.last_at_or_before(a, b, ["k"], "t", "u", "x", width)
    assert up.columns == ["i", "k", "t", "x"]
    known = lambda k, t: [u for rk, u in right if None not in (k, t, u) and rk == k]
    assert {(r["i"], r["x"]) for r in up.collect()} == {(i, min((u for u in known(k, t) if u >= t), default=None)) for i, k, t in left}
    assert {(r["i"], r["x"]) for r in down.collect()} == {(i, max((u for u in known(k, t) if u <= t), default=None)) for i, k, t in left}
    assert up.count() == down.count() == len(left)
    none = spark.createDataFrame([], b.schema)
    assert ordered.next_at_or_after(a, none, ["k"], "t", "u", "x", width).where("x is not null").count() == 0


def test_transfer_waits_equal_a_plain_search(spark):
    rng = random.Random(9)
    # one stop holds most departures, many at the same second
    departures = [(rng.choice([0, 0, 0, 1, 2]), "BUS", rng.choice(["a", "č", "B", None]), rng.randrange(14_000, 26_000) // 50 * 50) for _ in range(700)]
    stops = [(0, 0, 7, 0), (0, 1, 8, 60), (0, 2, 7, 90), (1, 0, 7, 30), (2, 0, 9, 0)]
    own = schedule.transfer_waits(spark.createDataFrame(departures, "pattern_idx int, mode string, route string, dep_sec int"), spark.createDataFrame(stops, "pattern_idx int, stop_pos int, stop_idx int, offset_sec int"))
    first = {}
    for p, _, s, off in sorted(stops):
        first.setdefault((p, s), off)
    at = [(s, route, t + off) for pattern, _, route, t in departures if route for (p, s), off in first.items() if p == pattern]
    waits = {}
    for s, route, t in at:
        h = t // 3600
        for other in {r for s2, r, t2 in at if s2 == s and t2 // 3600 == h} - {route}:
            later = [t2 for s2, r, t2 in at if (s2, r, t2 // 3600) == (s, other, h) and t2 >= t]
            if later and 5 <= h <= 23:
                waits.setdefault((s, h, *sorted((route, other))), []).append(min(later) - t)
    assert {tuple(r)[:4]: (round(r["wait_sec"], 6), r["n"]) for r in own.collect()} == {k: (round(sum(v) / len(v), 6), len(v)) for k, v in waits.items()}
    assert own.count() == len(waits) > 3


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components_equal_plain_search(spark, kind):
    rng = random.Random(3)
    n = 120
    links = {"chain": [(i, i + 1) for i in range(n - 2)], "star": [(n - 1, i) for i in range(0, n, 2)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)], "none": [(4, 4)]}[kind]
    rng.shuffle(links)
    least = list(range(n))
    for _ in range(n):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    own = spatial.components(spark.createDataFrame(links, "a int, b int"), spark.createDataFrame([(i,) for i in range(n)], "node int"))
    assert {r["node"]: r["component"] for r in own.collect()} == dict(enumerate(least))
