"""The tracker's batches against a plain replay, one poll at a time, with restarts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stopwise.streaming import tracker
from stopwise.streaming.versions import VersionedTable


def replay(polls, listed):
    """(minutes, station hours, rides) by the rules, poll by poll; polls: {ts: {bike: station}} in order."""
    docked, pending, flights, before = {}, {}, {}, None
    minutes, hours, rides = Counter(), {}, []
    bump = lambda ts, station, name, n=1: (minutes.update({(ts, name): n}), hours.setdefault((ts // 3600 * 3600, station), Counter()).update({name: n}))
    for ts, now in polls.items():
        if before is not None:
            starts, returns, settled = Counter(), Counter(), set(pending)
            for bike, (station, since) in pending.items():
                if bike not in now:
                    starts[station] += 1
                    flights[bike] = (station, since, ts)
                elif now[bike] != station:
                    starts[station] += 1
                    returns[now[bike]] += 1
                    rides.append((since, ts, station, now[bike]))
            pending = {b: (s, before) for b, s in docked.items() if b not in now}
            for bike, station in now.items():
                if bike in docked:
                    if docked[bike] != station and ts - before >= 120:
                        starts[docked[bike]] += 1
                        returns[station] += 1
                        rides.append((before, ts, docked[bike], station))
                elif bike not in settled:
                    flight = flights.pop(bike, None)
                    if flight and flight[0] == station:
                        bump(flight[2], station, "starts", -1)
                        continue
                    returns[station] += 1
                    if flight:
                        rides.append((flight[1], ts, flight[0], station))
            for moved, name, bulk in ((starts, "starts", "bulk_out"), (returns, "returns", "bulk_in")):
                for station, n in moved.items():
                    bump(ts, station, bulk if n >= 4 else name, n)
            minutes[ts, "gap_sec"] = ts - before
            minutes[ts, "docked"] = len(now)
            minutes[ts, "stations"] = len(set(now.values()))
        held = Counter(now.values())
        for station in set(held) | set(listed):
            h = hours.setdefault((ts // 3600 * 3600, station), Counter())
            h.update({"sum_bikes": held[station], "samples": 1, "empty_samples": int(not held[station])})
        docked, before = dict(now), ts
        flights = {b: f for b, f in flights.items() if ts - f[1] <= 6 * 3600}
    return minutes, hours, rides


def made_up(seed, polls=60, bikes=14):
    rng = random.Random(seed)
    at = {b: f"S{rng.randrange(4)}" for b in range(bikes)}
    away, out, ts = {}, {}, 1_000_000
    for k in range(polls):
        ts += rng.choice([60, 60, 60, 130, 400, 8_000 if k % 19 == 0 else 60])
        if k == polls // 2:
            ts += 120
            for b in [b for b in at if b not in away][:9]:  # a truck
                at[b] = "S1"
        for b in list(at):
            if b in away:
                away[b] -= 1
                if not away[b]:
                    del away[b]
                    at[b] = at[b] if rng.random() < 0.4 else f"S{rng.randrange(4)}"
            elif rng.random() < 0.15:
                away[b] = rng.choice([1, 1, 2, 3, 8])
            elif rng.random() < 0.05:
                at[b] = f"S{rng.randrange(4)}"
        if k == 20:
            at[99] = "S2"
        out[ts] = {str(b): s for b, s in at.items() if b not in away}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_a_replay_after_restarts(spark, tmp_path, monkeypatch, seed):
    polls = made_up(seed)
    listed = ["S0", "S1", "S2", "S3", "S9"]
    stations = spark.createDataFrame([(s,) for s in listed], "station_id string")
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    times = list(polls)
    schema = "poll_ts long, bike_id string, station_id string"
    swap, fail = VersionedTable.swap, [True]
    for n, (lo, hi) in enumerate([(0, 7), (7, 8), (8, 33), (33, len(times))]):
        rows = [(t, b, s) for t in times[max(0, lo - 1) : hi] for b, s in polls[t].items()]  # the last poll comes again
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        run = lambda: tracker.track(spark.readStream.schema(schema).json(str(tmp_path / "in")), path, check, stations).awaitTermination(180)
        if n == 2:  # everything is written but the swap

            def broken(self, version):
                raise OSError("lost")

            monkeypatch.setattr(VersionedTable, "swap", broken)
            with pytest.raises(Exception, match="lost"):
                run()
            assert VersionedTable(spark, f"{path}/state").current() == 1
            assert tracker.tracked(spark, path, "minutes").agg(F.max("batch")).first()[0] == 1
            monkeypatch.setattr(VersionedTable, "swap", swap)
        run()
    minutes, hours, rides = replay(polls, listed)
    got = tracker.tracked(spark, path, "minutes")
    assert got.where("gap_sec > 0").count() == len(times) - 1
    names = ["starts", "returns", "bulk_out", "bulk_in", "docked", "stations", "gap_sec"]
    summed = got.groupBy("ts").agg(*[F.sum(c).alias(c) for c in names]).collect()
    assert {(r["ts"], c): r[c] for r in summed for c in names if r[c]} == {k: v for k, v in minutes.items() if v}
    assert any(v for (_, name), v in minutes.items() if name.startswith("bulk"))
    found = tracker.tracked(spark, path, "rides").select("departed_ts", "arrived_ts", "from_station", "to_station").collect()
    assert sorted(map(tuple, found)) == sorted(rides)
    names = ["starts", "returns", "bulk_out", "bulk_in", "sum_bikes", "samples", "empty_samples"]
    summed = tracker.tracked(spark, path, "stations").groupBy("hour_ts", "station_id").agg(*[F.sum(c).alias(c) for c in names]).collect()
    assert {(r["hour_ts"], r["station_id"], c): r[c] for r in summed for c in names if r[c]} == {(*k, c): v for k, x in hours.items() for c, v in x.items() if v}
    assert not tracker.run_batch(spark, spark.createDataFrame([], schema), 2, path, stations)


def test_versions_stay_readable(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.current() is None and table.read() is None
    for v in range(6):
        assert table.replace(spark.range(v + 1), v)
    old = table.read()
    table.stage(spark.range(50), 6)
    assert table.current() == 5 and old.count() == 6 and table.read().count() == 6
    table.swap(6)
    assert table.read().count() == 50 and old.count() == 6
    assert not table.replace(spark.range(1), 6) and table.read().count() == 50
