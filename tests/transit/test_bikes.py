"""Movements from polls: the worked cases of FIXTURES.md C, and hypothesis against a plain replay."""

import pytest

from stopwise.plans import bikes, realtime

SCHEMA = "poll_ord long, poll_ts long, bike_id string, station_id string"


def moves(spark, seen, polls=6, step=60):
    """seen: bike -> {poll: station}; a bike that is always there keeps the clock."""
    rows = [(p, p * step, "clock", "Z") for p in range(polls)] + [(p, p * step, b, s) for b, at in seen.items() for p, s in at.items()]
    out = bikes.movements(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r["kind"], r["ts"], r["bike_id"], r["station_id"]) for r in out)


@pytest.mark.parametrize(
    "seen,want",
    [
        ({"b": {p: "A" for p in range(6)}}, []),
        ({"b": {0: "A", 2: "A", 3: "A", 4: "A", 5: "A"}}, []),  # flicker
        ({"b": {0: "A"}}, [("start", 120, "b", "A")]),
        ({"b": {0: "A", 3: "B", 4: "B", 5: "B"}}, [("return", 180, "b", "B"), ("start", 120, "b", "A")]),
        ({"b": {0: "A", 2: "B", 3: "B", 4: "B", 5: "B"}}, [("return", 120, "b", "B"), ("start", 60, "b", "A")]),
        ({"b": {0: "A", 1: "B", 2: "B", 3: "B", 4: "B", 5: "B"}}, []),  # another dock after 60 s
        ({"b": {0: "A", 4: "A", 5: "A"}}, []),  # back at its dock: the start is retracted
    ],
)
def test_cases(spark, seen, want):
    assert moves(spark, seen) == want


def test_other_dock_after_two_minutes(spark):
    assert [m[0] for m in moves(spark, {"b": {0: "A", 1: "B"}}, polls=2, step=120)] == ["return", "start"]


@pytest.mark.parametrize("n,kind", [(3, "start"), (4, "bulk_out")])
def test_bulk(spark, n, kind):
    rows = [(p, p * 60, "clock", "Z") for p in range(4)] + [(0, 0, f"b{i}", "A") for i in range(n)]
    out = bikes.with_bulk(bikes.movements(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [r["kind"] for r in out] == [kind] * n


def test_hourly_totals_example(spark):
    t0 = 1710720000
    rows = [(t0 + 60 * i, 2, 1, 0, 0, 1000 + i, 5, 900 if i == 7 else 60) for i in range(40)] + [(t0 + 3600, 5, 0, 0, 0, 900, 5, 60)]
    flow = spark.createDataFrame(rows, "ts long, starts long, returns long, bulk_out long, bulk_in long, docked long, stations long, gap_sec long")
    a, b = sorted(bikes.hourly_totals(flow).collect(), key=lambda r: r["hour_ts"])
    assert (a["minutes"], a["starts"], a["returns"], a["min_docked"]) == (39, 78, 39, 1000) and b["starts"] == 5


def test_local_days(spark):
    rows = [(1787169600, 10), (1787173200, 20), (1787176800, 30), (1767222000, 1)]
    hours = spark.createDataFrame([(t, s, 0, 60, 60) for t, s in rows], "hour_ts long, starts long, returns long, minutes long, worst_gap_sec long")
    local = {r["hour_ts"]: (r["date"], r["hour"]) for r in bikes.local_hours(hours).collect()}
    assert local[1787173200] == ("2026-08-19", 23) and local[1787176800] == ("2026-08-20", 0) and local[1767222000] == ("2026-01-01", 0)
    days = {r["date"]: (r["starts"], r["minutes"]) for r in bikes.daily_rides(hours).collect()}
    assert days["2026-08-19"] == (30, 120) and days["2026-08-20"] == (30, 60)


def test_snapshot_example(spark):
    ts = 1710720000
    rows = [(1, ts, "6", "t1", 30, 1, ts + 30), (2, ts, "6", "t1", 90, 2, ts + 90), (3, ts, "6", "t2", -30, 1, ts), (4, ts, "11", "t3", 0, 1, None), (5, ts, "6", "t2", 5, 2, ts)]
    obs = spark.createDataFrame(rows, "event_id long, ts long, route_id string, trip_id string, delay int, stop_sequence int, predicted long")
    out = {r["route_id"]: r for r in realtime.route_snapshots(obs).collect()}
    assert (out["6"]["trip_count"], out["6"]["avg_delay"], out["6"]["max_delay"], out["6"]["on_time_pct"]) == (2, 15.0, 30, 1.0) and out["11"]["trip_count"] == 1
