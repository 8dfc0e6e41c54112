"""Readers, writers and streams on small files."""

import json
import struct

from pyspark.sql import functions as F

from stopwise.functions import numbers as N
from stopwise.operators import ordered
from stopwise.sources import feeds, gtfs, networks
from stopwise.streaming import realtime as live


def test_timetable_feed(spark, tmp_path):
    files = {
        "routes": 'route_type,route_id,route_short_name,extra\n0,r1,"6 ""a""",x\n,r2,,x\n3,r3,109,x\n',
        "trips": "route_id,service_id,trip_id,trip_headsign\nr1,s1,t1,North\nr1,s1,t2,North\nr3,s2,t3,East\n",
        "stop_times": "trip_id,stop_id,stop_sequence,departure_time\nt1,a,1,08:00:00\nt1,b,2,08:05:00\nt2,b,2,25:05:00\nt2,a,1,25:00:00\nt3,c,1,09:00:00\n",
        "stops": "stop_id,stop_name,stop_lat,stop_lon\na,A,45.8,15.9\nb,B,45.81,15.91\nc,C,47.0,17.0\n",
        "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday\ns1,0,0,0,0,0,0,0\n",
        "calendar_dates": "service_id,date,exception_type\ns1,20240102,1\ns1,20240106,2\ns2,20240107,1\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.txt").write_text(text)
    at = str(tmp_path)
    assert {(r["route_id"], r["route"], r["mode"]) for r in gtfs.routes(spark, at).collect()} == {("r1", '6 "a"', "TRAM"), ("r2", "r2", "BUS"), ("r3", "109", "BUS")}
    days = gtfs.service_days(gtfs.read_table(spark, at, "calendar"), gtfs.read_table(spark, at, "calendar_dates"))
    assert {tuple(r) for r in days.collect()} == {("s1", 2), ("s2", 0)}
    feed = gtfs.wanted_feed(spark, at, ['6 "a"'])
    assert {k: v.count() for k, v in feed.items()} == {"routes": 1, "trips": 2, "stop_times": 4, "stops": 2, "shapes": 0}
    (p,) = gtfs.patterns(feed["trips"], feed["stop_times"]).collect()
    assert p["stops"] == ["a", "b"] and p["departures"] == [28800, 90000] and p["n_trips"] == 2
    near = gtfs.near_centre(gtfs.read_table(spark, at, "stops"), gtfs.read_table(spark, at, "stop_times"), gtfs.read_table(spark, at, "trips"), 45.8, 15.9)
    assert {r["trip_id"] for r in near.collect()} == {"t1", "t2"}


def test_snapshots_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, ts in enumerate((1710720000, 1710720060, 1710720065)):
        snap = {"timestamp": ts, "trips": [{"trip_id": "1:t", "route_id": "1:6", "stop_times": [{"stop_sequence": 1, "delay": 30 * i, "time": 0}, {"stop_sequence": 2, "time": ts}]}], "alerts": [], "vehicles": [{"route_id": "1:6", "speed_mps": 5.5, "occupancy_status": 2}]}
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(snap))
    obs = feeds.observations(feeds.snapshots(spark, str(tmp_path / "in")))
    rows = sorted(tuple(r) for r in obs.collect())
    assert rows[0] == (1710720000, "6", "t", 1, 0, None) and rows[1] == (1710720000, "6", "t", 2, 0, 1710720000) and len(rows) == 6
    assert feeds.vehicles(feeds.snapshots(spark, str(tmp_path / "in"))).count() == 3
    stream = feeds.observations(feeds.snapshots(spark, str(tmp_path / "in"), stream=True))
    live.append_once(live.once_a_minute(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    live.append_once(live.once_a_minute(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_snapshot_stream_keeps_the_latest_poll(spark, tmp_path):
    from stopwise.streaming.versions import VersionedTable

    rows = [(60 * p, f"t{k}", k) for p in range(4) for k in range(3)]
    df = spark.createDataFrame(rows, "ts long, trip string, delay int")
    for lo, hi in ((0, 120), (120, 240)):
        df.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
        live.current_snapshot(stream, str(tmp_path / "now"), str(tmp_path / "check")).awaitTermination(120)
        table = VersionedTable(spark, str(tmp_path / "now"))
        assert {r["ts"] for r in table.read().collect()} == {hi - 60} and table.read().count() == 3


def test_notices_and_documents(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title><![CDATA[Lines 6 &amp; <b>11</b>]]></title><link>http://x/1</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>")
    (r,) = feeds.rss_items(spark, str(tmp_path / "rss.xml"), "rss").collect()
    assert (r["id"], r["title"], r["date"]) == ("http://x/1", "Lines 6 11", "2024-02-05")
    pages = spark.createDataFrame([('<ul><li><a class="k" href="/a">One <b>two</b></a></li><li><a href="/b">Three</a></li></ul>',), (None,)], "html string")
    assert {tuple(x) for x in feeds.listing_links(pages).collect()} == {("/a", "One two"), ("/b", "Three")}
    docs = spark.createDataFrame([("a", 1), ("b", None)], "slug string, n int")
    feeds.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    assert {x["slug"] for x in feeds.without_orphans(docs, docs.where("slug = 'a'"), "slug").collect()} == {"a"}


def test_archived_listing(spark, tmp_path):
    lines = [
        "20240305101010 http://www.x.hr:80/news/nova-linija-6/12?a=1", "20230102000000 https://x.hr/news/nova-linija-6/12", "20230102000000 https://a.hr/NEWS/nova-linija-6/12",
        "20220101000000 https://x.hr/other/slug/13", "20220101000000 https://x.hr/news/14", "20220101000000", "", "20210101000000 http://x.hr/news/ukida-SE/15 200", "20200101000000 https://x.hr/news/nova-linija-6/12?a=1", "2019 https://x.hr/news/a/1?id=16",
    ]
    (tmp_path / "cdx.txt").write_text("\n".join(lines))
    own = feeds.archived_links(spark, str(tmp_path / "cdx.txt"), "news")
    assert {tuple(r) for r in own.collect()} == {
        ("12", "nova-linija-6", "Nova Linija 6", "https://a.hr/NEWS/nova-linija-6/12", "20230102000000", "2023-01-02"),
        ("15", "ukida-SE", "Ukida SE", "https://x.hr/news/ukida-SE/15", "20210101000000", "2021-01-01"), ("16", "a", "A", "https://x.hr/news/a/1?id=16", "2019", "2019--"),
    }
    (tmp_path / "none.txt").write_text("")
    assert feeds.archived_links(spark, str(tmp_path / "none.txt"), "news").count() == 0


def test_upsert(spark, tmp_path):
    at = str(tmp_path / "table")
    one = spark.createDataFrame([(1, "a", 5, 0), (1, "a", 5, 0), (2, "b", 6, 1)], "ts long, k string, v int, day int")
    feeds.upsert(spark, at, ["ts", "k"], one, "day")
    feeds.upsert(spark, at, ["ts", "k"], spark.createDataFrame([(1, "a", 9, 0), (3, "c", 7, 1)], "ts long, k string, v int, day int"), "day")
    assert {(r["ts"], r["v"]) for r in spark.read.parquet(at).collect()} == {(1, 5), (2, 6), (3, 7)}


def test_walk_graph_and_way_rules(spark, tmp_path):
    nodes, edges = 3, [(0, 1, 500), (0, 2, 70), (2, 1, 9)]
    raw = struct.pack("<II", nodes, len(edges)) + struct.pack("<6d", *range(6)) + struct.pack("<4I", 0, 2, 2, 3) + struct.pack("<3I", *[e[1] for e in edges]) + struct.pack("<3I", *[e[2] for e in edges])
    (tmp_path / "g.bin").write_bytes(raw)
    assert sorted(map(tuple, networks.walk_graph(spark, str(tmp_path / "g.bin")).collect())) == sorted(edges)
    tags = [({"highway": "footway"}, True, "both"), ({"highway": "service", "access": "private"}, False, "both"), ({"highway": "residential", "oneway": "-1"}, True, "backward"), ({"highway": "path", "oneway": "yes", "oneway:bicycle": "no"}, True, "both"), ({}, False, "both")]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(tags)], "i int, tags map<string,string>").select("i", networks.walkable(F.col("tags")).alias("w"), networks.bike_direction(F.col("tags")).alias("d")).orderBy("i").collect()
    assert [(r["w"], r["d"]) for r in rows] == [(w, d) for _, w, d in tags]
    geo = {"features": [{"properties": {"name": "A", "osm_id": 1, "population": 9}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]]]}}]}
    (tmp_path / "d.json").write_text(json.dumps(geo))
    (d,) = networks.districts(spark, str(tmp_path / "d.json")).collect()
    assert d["name"] == "A" and [(p["lon"], p["lat"]) for p in d["ring"]] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]


def test_numbers_and_asof(spark):
    (r,) = spark.range(1).select(N.js_round(F.lit(-0.5)).alias("a"), N.round_to(F.lit(2.25), 1).alias("b"), N.clock(F.lit(91800)).alias("c"), N.clock(F.lit(91800), False).alias("d"), N.clock_seconds(F.lit("08:13")).alias("e"), N.clock_seconds(F.lit("99:00")).alias("f")).collect()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"]) == (0, 2.3, "01:30", "25:30", 29700, 28800)
    left = spark.createDataFrame([("k", 5), ("k", 20), ("m", 1)], "k string, t int")
    right = spark.createDataFrame([("k", 5), ("k", 12)], "k string, u int")
    assert {(r["k"], r["t"], r["next"]) for r in ordered.next_at_or_after(left, right, ["k"], "t", "u").collect()} == {("k", 5, 5), ("k", 20, None), ("m", 1, None)}
    assert {(r["t"], r["previous"]) for r in ordered.last_at_or_before(left, right, ["k"], "t", "u").collect()} == {(5, 5), (20, 12), (1, None)}
