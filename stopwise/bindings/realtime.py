"""Queries of the realtime, bike and district analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import floor_to
from ..plans import bikes, districts, realtime
from ..queries import EPOCH, query, r6
from . import Tables

CUTOFF = EPOCH + 20_000

SNAPSHOTS = """, at_minute AS (
  SELECT floor(ts / 60.0)::BIGINT * 60 AS m, * EXCLUDE (ts) FROM rt_obs
), first_stop AS (
  SELECT m AS ts, route_id, trip_id, first(delay ORDER BY stop_sequence, event_id) AS delay, first(predicted ORDER BY stop_sequence, event_id) AS predicted FROM at_minute GROUP BY ALL
), times AS (
  SELECT ts, route_id, count(predicted) AS raw, list_sort(list_distinct(list(predicted) FILTER (predicted IS NOT NULL))) AS t FROM first_stop GROUP BY ALL
), usable AS (
  SELECT ts, route_id, raw, list_filter(list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]), lambda g: g > 30 AND g < 3600) AS g FROM times
), snapshots AS (
  SELECT f.ts, f.route_id, avg(greatest(delay, 0))::DOUBLE AS avg_delay, first(delay ORDER BY abs(delay) DESC, f.trip_id) AS max_delay,
    avg(CASE WHEN delay BETWEEN -60 AND 300 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS on_time_pct, count(*) AS trip_count,
    any_value(CASE WHEN raw >= 3 AND len(g) >= 2 THEN list_avg(g) END)::DOUBLE AS headway_sec, any_value(CASE WHEN raw >= 3 AND len(g) >= 2 AND list_avg(g) > 0 THEN list_stddev_pop(g) / list_avg(g) END)::DOUBLE AS headway_cv
  FROM first_stop f JOIN usable u ON f.ts = u.ts AND f.route_id = u.route_id GROUP BY f.ts, f.route_id
)
"""


def snapshots(t: Tables) -> DataFrame:
    return realtime.route_snapshots(t.rt_obs)


@query("agg_24_route_snapshots", SNAPSHOTS + "SELECT ts, route_id, round(avg_delay, 6) AS avg_delay, max_delay, round(on_time_pct, 6) AS on_time_pct, trip_count, round(headway_sec, 6) AS headway_sec, round(headway_cv, 6) AS headway_cv FROM snapshots")
def _(t):
    return snapshots(t).withColumns(r6("avg_delay", "on_time_pct", "headway_sec", "headway_cv"))


@query("agg_20_headway", """SELECT route_id, stop_sequence, round(list_avg(g), 6) AS mean, round(list_stddev_pop(g) / list_avg(g), 6) AS cv FROM (
  SELECT route_id, stop_sequence, raw, list_filter(list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]), lambda x: x > 30 AND x < 3600) AS g FROM (
    SELECT route_id, stop_sequence, count(predicted) AS raw, list_sort(list_distinct(list(predicted) FILTER (predicted IS NOT NULL))) AS t FROM rt_obs GROUP BY ALL)) WHERE raw >= 3 AND len(g) >= 2""")
def _(t):
    own = t.rt_obs.groupBy("route_id", "stop_sequence").agg(realtime.headway(F.collect_list("predicted")).alias("h")).select("route_id", "stop_sequence", "h.*")
    return own.where("mean is not null").withColumns(r6("mean", "cv"))


HEALTH = SNAPSHOTS + """, h AS (
  SELECT route_id, avg(avg_delay) AS avg_delay, sum(on_time_pct * trip_count) / sum(trip_count) AS on_time_pct, avg(headway_cv) AS headway_cv, avg(headway_sec) AS headway_sec, count(*) AS samples, sum(trip_count)::BIGINT AS trips
  FROM snapshots GROUP BY route_id HAVING sum(trip_count) > 0
), s AS (
  SELECT *, greatest(least((1 - on_time_pct) * 40 + greatest(coalesce(headway_cv, 0) - 0.3::DOUBLE, 0) / 0.7::DOUBLE * 30 + least(greatest(avg_delay, 0) / 60, 3) * 10, 100), 0) AS x FROM h
)
SELECT route_id, round(avg_delay, 6) AS avg_delay, round(on_time_pct, 6) AS on_time_pct, round(headway_cv, 6) AS headway_cv, round(headway_sec, 6) AS headway_sec, samples, trips, round(x * 10) / 10 AS score,
  CASE WHEN x < 20 THEN 'good' WHEN x < 45 THEN 'fair' WHEN x < 70 THEN 'poor' ELSE 'critical' END AS label FROM s"""


@query("agg_27_28_route_health", HEALTH)
def route_health(t):
    return realtime.route_health(snapshots(t)).withColumns(r6("avg_delay", "on_time_pct", "headway_cv", "headway_sec"))


@query("flt_01_plausible", "SELECT event_id, delay FROM rt_obs WHERE delay BETWEEN -300 AND 1800")
def _(t):
    return realtime.plausible(t.rt_obs).select("event_id", "delay")


@query("flt_02_fresh_trips", """SELECT event_id FROM rt_obs JOIN (SELECT ts, trip_id, route_id, max(predicted) AS last FROM rt_obs GROUP BY ALL) USING (ts, trip_id, route_id) WHERE last IS NULL OR last >= ts - 120""")
def _(t):
    return realtime.fresh(t.rt_obs).select("event_id")


@query("flt_03_04_clamped_on_time", "SELECT event_id, greatest(delay, 0) AS clamped, delay BETWEEN -60 AND 300 AS on_time, least(greatest(delay, -300), 900) AS adjusted FROM rt_obs")
def _(t):
    d = F.col("delay")
    return t.rt_obs.select("event_id", F.greatest(d, F.lit(0)).alias("clamped"), d.between(-60, 300).alias("on_time"), F.least(F.greatest(d, F.lit(-300)), F.lit(900)).alias("adjusted"))


@query("agg_25_speeds", "SELECT floor(ts / 300.0)::BIGINT * 300 AS ts, route_id, round(avg(speed_mps), 9) AS avg_speed_mps, count(*) AS sample_count FROM rt_obs WHERE speed_mps >= 0 GROUP BY 1, 2")
def _(t):
    return realtime.speeds(t.rt_obs).withColumn("avg_speed_mps", F.round("avg_speed_mps", 9))


@query("agg_25_occupancy_counts", "SELECT floor(ts / 300.0)::BIGINT * 300 AS ts, route_id, occupancy_level, count(*) AS n FROM rt_obs GROUP BY 1, 2, 3")
def _(t):
    return realtime.occupancy_counts(t.rt_obs)


@query("agg_61_occupancy_by_hour", """SELECT route_id, (floor((floor(ts / 300.0) * 300 + 3600) / 3600)::BIGINT % 24)::INT AS hour, count(*) FILTER (occupancy_level IN (0, 1)) AS empty, count(*) FILTER (occupancy_level = 2) AS few,
  count(*) FILTER (occupancy_level IN (3, 4)) AS standing, count(*) FILTER (occupancy_level = 5) AS "full", count(*) AS total FROM rt_obs GROUP BY 1, 2""")
def _(t):
    return realtime.occupancy_by_hour(realtime.occupancy_counts(t.rt_obs), 3600)


@query("agg_26_delay_profile", "SELECT route_id, stop_sequence, round(avg(delay), 6) AS avg_delay, quantile_disc(delay, 0.9) AS p90_delay, count(*) AS samples FROM rt_obs GROUP BY 1, 2")
def _(t):
    return realtime.delay_profile(t.rt_obs).withColumns(r6("avg_delay"))


@query("agg_29_alert_stats", """SELECT 'total' AS kind, 'all' AS key, count(*) AS n FROM alerts UNION ALL SELECT 'cause', cause::VARCHAR, count(*) FROM alerts GROUP BY cause
  UNION ALL SELECT 'effect', effect::VARCHAR, count(*) FROM alerts GROUP BY effect UNION ALL SELECT 'route', r, count(*) FROM (SELECT unnest(string_split(route_ids, ',')) AS r FROM alerts) WHERE r <> '' GROUP BY r""")
def _(t):
    return realtime.alert_stats(t.alerts)


@query("fn_15_first_alerts", "SELECT concat(cause, '|', effect, '|', header, '|', route_ids) AS hash, min(first_seen) AS first_seen, arg_min(alert_id, first_seen * 10000000 + alert_id) AS alert_id FROM alerts GROUP BY 1")
def _(t):
    return realtime.first_alerts(t.alerts)


@query("agg_60_summary", "SELECT count(*) AS rows, count(DISTINCT route_id) AS routes, min(ts) AS first_ts, max(ts) AS last_ts FROM rt_obs")
def _(t):
    return realtime.summary(t.rt_obs)


@query("snk_01_insert_if_absent", """SELECT ts, route_id, stop_sequence, min(delay) AS delay FROM (
  SELECT floor(ts / 600.0)::BIGINT * 600 AS ts, route_id, stop_sequence, delay, event_id % 2 AS late, min(event_id % 2) OVER (PARTITION BY floor(ts / 600.0), route_id, stop_sequence) AS best FROM rt_obs) WHERE late = best GROUP BY 1, 2, 3""")
def _(t):
    at = t.rt_obs.withColumn("ts", floor_to(F.col("ts"), 600))
    one = lambda p: at.where(F.col("event_id") % 2 == p).groupBy("ts", "route_id", "stop_sequence").agg(F.min("delay").alias("delay"))
    return realtime.insert_if_absent(one(0), one(1), ["ts", "route_id", "stop_sequence"])


@query("snk_07_retained", f"SELECT event_id FROM rt_obs WHERE ts >= {CUTOFF} - 7200")
def _(t):
    return realtime.retained(t.rt_obs, F.lit(CUTOFF), 7200).select("event_id")


@query("snk_08_compacted", SNAPSHOTS + f"SELECT floor(ts / 3600.0)::BIGINT * 3600 AS hour_ts, route_id, round(avg(avg_delay), 6) AS avg_delay, max(max_delay) AS max_delay, round(avg(on_time_pct), 6) AS on_time_pct, count(*) AS samples FROM snapshots WHERE floor(ts / 3600.0) * 3600 < {CUTOFF} GROUP BY 1, 2")
def _(t):
    return realtime.compact(snapshots(t), F.lit(CUTOFF)).withColumns(r6("avg_delay", "on_time_pct"))


@query("set_02_history", SNAPSHOTS + f"""SELECT ts, route_id, round(avg_delay, 6) AS avg_delay, max_delay, trip_count FROM snapshots WHERE floor(ts / 3600.0) * 3600 >= {CUTOFF}
  UNION ALL SELECT floor(ts / 3600.0)::BIGINT * 3600, route_id, round(avg(avg_delay), 6), max(max_delay), count(*) FROM snapshots WHERE floor(ts / 3600.0) * 3600 < {CUTOFF} GROUP BY 1, 2""")
def _(t):
    return realtime.history(snapshots(t), F.lit(CUTOFF)).withColumns(r6("avg_delay")).select("ts", "route_id", "avg_delay", "max_delay", "trip_count")


@query("win_06_forward_filled", """, k AS (SELECT floor(ts / 3600.0)::BIGINT * 3600 AS ts, route_id, trip_id, stop_sequence, max(delay) AS d FROM rt_obs GROUP BY ALL), e AS (SELECT DISTINCT ts, route_id, trip_id FROM k)
SELECT ts, route_id, trip_id, stop_sequence, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY ts, route_id, trip_id ORDER BY stop_sequence), 0) AS delay
FROM (SELECT e.*, s.stop_sequence, k.d FROM e CROSS JOIN (SELECT unnest(range(1, 13))::INT AS stop_sequence) s LEFT JOIN k USING (ts, route_id, trip_id, stop_sequence))""")
def _(t):
    return realtime.forward_filled(t.rt_obs.withColumn("ts", floor_to(F.col("ts"), 3600)))


@query("agg_70_rolling_peak", """, u AS (SELECT floor(ts / 60.0)::BIGINT * 60 AS ts, route_id, count(*) AS available FROM rt_obs GROUP BY 1, 2)
SELECT ts, route_id, available, max(available) OVER (PARTITION BY route_id ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS peak FROM u""")
def _(t):
    usage = t.rt_obs.groupBy(floor_to(F.col("ts"), 60).alias("ts"), "route_id").agg(F.count("*").alias("available"))
    return realtime.rolling_peak(usage, "available", 3600, ["route_id"])


@query("agg_77_fleet_deployment", f""", sched AS (SELECT route_id, trip_id, min(ts) AS a, max(ts) AS b FROM rt_obs GROUP BY 1, 2), live AS (SELECT DISTINCT trip_id FROM rt_obs WHERE speed_mps IS NOT NULL)
SELECT route_id, count(*) AS scheduled, count(l.trip_id) AS active, round(count(l.trip_id)::DOUBLE / count(*) * 100 * 10) / 10 AS pct FROM sched s LEFT JOIN live l USING (trip_id) WHERE a <= {CUTOFF} AND b >= {CUTOFF} GROUP BY route_id""")
def _(t):
    sched = t.rt_obs.groupBy("route_id", "trip_id").agg(F.min("ts").alias("start_sec"), F.max("ts").alias("end_sec"))
    return realtime.running_trips(sched, t.rt_obs.where("speed_mps is not null"), F.lit(CUTOFF))


@query("agg_78_speed_comparison", """, s AS (SELECT DISTINCT route_id, (length(route_id) * 4)::DOUBLE AS scheduled_kmh FROM rt_obs), l AS (SELECT route_id, avg(x) AS mps FROM (SELECT floor(ts / 300.0), route_id, avg(speed_mps) AS x FROM rt_obs WHERE speed_mps >= 0 AND route_id <> 'view' GROUP BY 1, 2) GROUP BY 1)
SELECT route_id, scheduled_kmh, round(mps * 3.6 * 10) / 10 AS live_kmh, round(round(mps * 3.6 * 10) / 10 / scheduled_kmh * 100) / 100 AS ratio FROM s LEFT JOIN l USING (route_id)""")
def _(t):
    sched = t.rt_obs.select("route_id", (F.length("route_id") * 4).cast("double").alias("scheduled_kmh")).distinct()
    return realtime.speed_comparison(sched, realtime.speeds(t.rt_obs).where("route_id <> 'view'"))


@query("agg_79_downsampled", SNAPSHOTS + """, sp AS (SELECT route_id, min(ts) AS lo, max(ts) AS hi FROM snapshots GROUP BY 1)
SELECT route_id, bucket, round(sum(avg_delay * trip_count) / sum(trip_count), 6) AS avg_delay, max(max_delay) AS max_delay, round(sum(on_time_pct * trip_count) / sum(trip_count), 6) AS on_time_pct, sum(trip_count)::BIGINT AS trips, floor((min(ts) + max(ts)) / 2)::BIGINT AS ts
FROM (SELECT s.*, least(floor((ts - lo) / greatest(1.0, (hi - lo) / 24.0::DOUBLE)), 23)::INT AS bucket FROM snapshots s JOIN sp USING (route_id)) GROUP BY 1, 2""")
def _(t):
    return realtime.downsample(snapshots(t), 24).withColumns(r6("avg_delay", "on_time_pct"))


@query("agg_80_punctuality", SNAPSHOTS + "SELECT round(sum(avg_delay * trip_count) / sum(trip_count), 6) AS avg_delay, max(max_delay) AS max_delay, round(sum(on_time_pct * trip_count), 6) AS on_time_trips, sum(trip_count)::BIGINT AS trips FROM snapshots")
def _(t):
    return realtime.punctuality(snapshots(t)).withColumns(r6("avg_delay", "on_time_trips"))


@query("join_13_look_back", """, r AS (SELECT DISTINCT stop_sequence AS pattern_idx, trip_id::BIGINT AS trip_no FROM rt_obs), u AS (SELECT stop_sequence AS pattern_idx, trip_id::BIGINT AS trip_no, max(delay) AS delay FROM rt_obs WHERE predicted IS NULL GROUP BY 1, 2)
SELECT r.pattern_idx, r.trip_no, (SELECT arg_min(u.delay, r.trip_no - u.trip_no) FROM u WHERE u.pattern_idx = r.pattern_idx AND u.trip_no BETWEEN r.trip_no - 3 AND r.trip_no) AS delay FROM r""")
def _(t):
    at = t.rt_obs.select(F.col("stop_sequence").alias("pattern_idx"), F.col("trip_id").cast("long").alias("trip_no"), "delay", "predicted")
    return realtime.with_look_back(at.select("pattern_idx", "trip_no").distinct(), at.where("predicted is null").groupBy("pattern_idx", "trip_no").agg(F.max("delay").alias("delay")))


@query("str_03_minute_dedupe", "SELECT event_id, floor(ts / 60.0)::BIGINT * 60 AS ts FROM rt_obs WHERE (ts) IN (SELECT min(ts) FROM rt_obs GROUP BY floor(ts / 60.0))")
def _(t):
    return realtime.minute(t.rt_obs).select("event_id", "ts")


@query("win_01_gaps", """SELECT route_id, stop_sequence, event_id, nxt - ts AS gap FROM (SELECT *, lead(ts) OVER (PARTITION BY route_id, stop_sequence ORDER BY ts, event_id) AS nxt FROM rt_obs) WHERE nxt IS NOT NULL""")
def _(t):
    w = W.partitionBy("route_id", "stop_sequence").orderBy("ts", "event_id")
    return t.rt_obs.withColumn("gap", F.lead("ts").over(w) - F.col("ts")).where("gap is not null").select("route_id", "stop_sequence", "event_id", "gap")


# --- bikes -------------------------------------------------------------------

MOVES = f""", seen AS (
  SELECT *, lead(poll_ord) OVER w AS n_ord, lead(poll_ts) OVER w AS n_ts, lead(station_id) OVER w AS n_st, (SELECT max(poll_ord) FROM bike_polls) AS end_ord FROM bike_polls WINDOW w AS (PARTITION BY bike_id ORDER BY poll_ord)
), m AS (
  SELECT *, coalesce(n_ord, end_ord + 1) - poll_ord - 1 AS missing, coalesce(n_st <> station_id AND n_ts - poll_ts BETWEEN 120 AND 21600, FALSE) AS ride FROM seen
), moves0 AS (
  SELECT 'start' AS kind, poll_ord + least(2, greatest(missing, 1)) AS ord, bike_id, station_id, NULL::VARCHAR AS from_station, NULL::BIGINT AS departed_ts FROM m
  WHERE (missing >= 2 OR ride) AND (n_st IS NULL OR n_st <> station_id OR n_ts - poll_ts > 21600)
  UNION ALL SELECT 'return', n_ord, bike_id, n_st, station_id, poll_ts FROM m WHERE ride
), moves AS (
  SELECT CASE WHEN count(*) OVER (PARTITION BY kind, ord, station_id) < 4 THEN kind WHEN kind = 'start' THEN 'bulk_out' ELSE 'bulk_in' END AS kind, ord, {EPOCH} + 60 * ord AS ts, bike_id, station_id, from_station, departed_ts FROM moves0
  WHERE ord IN (SELECT poll_ord FROM bike_polls)
), flow AS (
  SELECT b.poll_ts AS ts, coalesce(c.starts, 0) AS starts, coalesce(c.returns, 0) AS returns, coalesce(c.bulk_out, 0) AS bulk_out, coalesce(c.bulk_in, 0) AS bulk_in, docked, stations, coalesce(b.poll_ts - p.poll_ts, 0) AS gap_sec
  FROM (SELECT poll_ord, poll_ts, count(*) AS docked, count(DISTINCT station_id) AS stations FROM bike_polls GROUP BY 1, 2) b LEFT JOIN (SELECT DISTINCT poll_ord, poll_ts FROM bike_polls) p ON p.poll_ord = b.poll_ord - 1
  LEFT JOIN (SELECT ord, count(*) FILTER (kind = 'start') AS starts, count(*) FILTER (kind = 'return') AS returns, count(*) FILTER (kind = 'bulk_out') AS bulk_out, count(*) FILTER (kind = 'bulk_in') AS bulk_in FROM moves GROUP BY ord) c ON c.ord = b.poll_ord
), hours AS (
  SELECT h.hour_ts, h.station_id, sum_bikes, min_bikes, max_bikes, empty_samples, samples, coalesce(starts, 0) AS starts, coalesce(returns, 0) AS returns, coalesce(bulk_out, 0) AS bulk_out, coalesce(bulk_in, 0) AS bulk_in FROM (
    SELECT hour_ts, station_id, sum(bikes)::BIGINT AS sum_bikes, min(bikes) AS min_bikes, max(bikes) AS max_bikes, count(*) FILTER (bikes = 0) AS empty_samples, count(*) AS samples FROM (
      SELECT c.poll_ord, c.hour_ts, k.station_id, (SELECT count(*) FROM bike_polls b WHERE b.poll_ord = c.poll_ord AND b.station_id = k.station_id) AS bikes
      FROM (SELECT DISTINCT poll_ord, poll_ts - poll_ts % 3600 AS hour_ts FROM bike_polls) c JOIN (SELECT DISTINCT poll_ts - poll_ts % 3600 AS hour_ts, station_id FROM bike_polls) k USING (hour_ts)) GROUP BY 1, 2) h
  LEFT JOIN (SELECT ts - ts % 3600 AS hour_ts, station_id, count(*) FILTER (kind = 'start') AS starts, count(*) FILTER (kind = 'return') AS returns, count(*) FILTER (kind = 'bulk_out') AS bulk_out, count(*) FILTER (kind = 'bulk_in') AS bulk_in FROM moves GROUP BY 1, 2) m USING (hour_ts, station_id)
), totals AS (
  SELECT ts - ts % 3600 AS hour_ts, sum(starts)::BIGINT AS starts, sum(returns)::BIGINT AS returns, sum(bulk_out)::BIGINT AS bulk_out, sum(bulk_in)::BIGINT AS bulk_in, avg(docked) AS avg_docked, min(docked) AS min_docked, max(docked) AS max_docked, count(*) AS minutes, max(gap_sec) AS worst_gap_sec
  FROM flow WHERE gap_sec <= 180 GROUP BY 1
), local_totals AS (
  SELECT *, strftime(timezone('Europe/Zagreb', to_timestamp(hour_ts)), '%Y-%m-%d') AS date, hour(timezone('Europe/Zagreb', to_timestamp(hour_ts)))::INT AS hour FROM totals
)
"""


def moves(t: Tables) -> DataFrame:
    return bikes.with_bulk(bikes.movements(t.bike_polls))


def flow(t: Tables) -> DataFrame:
    return bikes.minute_flow(t.bike_polls, moves(t))


def hours(t: Tables) -> DataFrame:
    return bikes.station_hours(t.bike_polls, moves(t))


@query("str_06_bike_movements", MOVES + "SELECT kind, ts, ord, bike_id, station_id, from_station, departed_ts FROM moves")
def _(t):
    return moves(t)


@query("snk_05_rides", MOVES + "SELECT departed_ts, ts AS arrived_ts, from_station, station_id AS to_station FROM moves WHERE kind = 'return'")
def _(t):
    return bikes.rides(moves(t))


@query("str_08_minute_flow", MOVES + "SELECT * FROM flow")
def _(t):
    return flow(t)


@query("snk_02_06_merged_flow", MOVES + """SELECT ts, greatest(sum(starts), 0)::BIGINT AS starts, sum(returns)::BIGINT AS returns, sum(bulk_out)::BIGINT AS bulk_out, sum(bulk_in)::BIGINT AS bulk_in, arg_max(docked, q) AS docked, arg_max(stations, q) AS stations, max(gap_sec) AS gap_sec
  FROM (SELECT ts, starts, returns, bulk_out, bulk_in, docked, stations, gap_sec, 0 AS q FROM flow UNION ALL SELECT ts, -3, 0, 0, 0, docked + 1, stations, 0, 1 FROM flow WHERE ts % 7 = 0) GROUP BY ts""")
def _(t):
    own = flow(t).withColumn("ingest_seq", F.lit(0))
    back = own.where("ts % 7 = 0").withColumns({"starts": F.lit(-3).cast("long"), "returns": F.lit(0).cast("long"), "bulk_out": F.lit(0).cast("long"), "bulk_in": F.lit(0).cast("long"), "docked": F.col("docked") + 1, "gap_sec": F.lit(0).cast("long"), "ingest_seq": F.lit(1)})
    return bikes.merged_flow(own.unionByName(back))


@query("str_07_station_hours", MOVES + "SELECT * FROM hours")
def _(t):
    return hours(t)


@query("agg_62_hourly_totals", MOVES + "SELECT * REPLACE (round(avg_docked, 6) AS avg_docked) FROM totals")
def _(t):
    return bikes.hourly_totals(flow(t)).withColumns(r6("avg_docked"))


RANKING = MOVES + """SELECT station_id, sum(starts)::BIGINT AS starts, sum(returns)::BIGINT AS returns, round(sum(sum_bikes) / sum(samples), 6) AS avg_bikes, round(sum(empty_samples) / sum(samples), 6) AS empty_share, sum(samples)::BIGINT AS samples, round(sum(starts) / (sum(samples) / 1440), 6) AS starts_per_day FROM hours GROUP BY 1"""


@query("agg_63_64_station_ranking", RANKING)
def _(t):
    return bikes.station_ranking(hours(t)).withColumns(r6("avg_bikes", "empty_share", "starts_per_day"))


@query("agg_66_daily_rides", MOVES + "SELECT date, sum(starts)::BIGINT AS starts, sum(returns)::BIGINT AS returns, sum(minutes)::BIGINT AS minutes, max(worst_gap_sec) AS worst_gap_sec FROM local_totals GROUP BY 1")
def _(t):
    return bikes.daily_rides(bikes.hourly_totals(flow(t)))


@query("agg_66_hour_profile", MOVES + "SELECT hour, round(avg(starts), 6) AS avg_starts, round(avg(returns), 6) AS avg_returns, count(*) AS days FROM local_totals WHERE minutes >= 50 GROUP BY 1")
def _(t):
    return bikes.hour_profile(bikes.hourly_totals(flow(t))).withColumns(r6("avg_starts", "avg_returns"))


@query("agg_65_without_relocations", MOVES + "SELECT hour_ts, greatest(starts - m, 0) AS starts, greatest(returns - m, 0) AS returns, least(starts, m) AS removed, m AS relocations, minutes FROM (SELECT *, bulk_out AS m FROM totals)")
def _(t):
    totals = bikes.hourly_totals(flow(t))
    return bikes.without_relocations(totals, totals.select("hour_ts", F.col("bulk_out").alias("moves")))


@query("agg_71_rides_summary", MOVES + """, d AS (SELECT date, sum(starts) AS starts, sum(minutes) AS minutes FROM local_totals GROUP BY 1), p AS (SELECT hour, avg(starts) AS s FROM local_totals WHERE minutes >= 50 GROUP BY 1)
SELECT (SELECT count(*) FROM d WHERE minutes >= 1400) AS days, (SELECT round(avg(starts), 6) FROM d WHERE minutes >= 1400) AS avg_starts, (SELECT first(date ORDER BY starts DESC, date) FROM d WHERE minutes >= 1400) AS busiest_date,
  (SELECT first(hour ORDER BY s DESC, hour) FROM p) AS peak_hour, (SELECT first(hour ORDER BY s DESC, hour) FROM p WHERE hour < 12) AS morning_peak_hour""")
def _(t):
    totals = bikes.hourly_totals(flow(t))
    return bikes.rides_summary(bikes.daily_rides(totals), bikes.hour_profile(totals)).withColumns(r6("avg_starts"))


@query("agg_67_station_flow", MOVES + """SELECT station_id, hour(l)::INT AS hour, sum(starts)::BIGINT AS starts, sum(returns)::BIGINT AS returns, sum(bulk_out)::BIGINT AS bulk_out, sum(bulk_in)::BIGINT AS bulk_in, count(DISTINCT strftime(l, '%Y-%m-%d')) AS days
  FROM (SELECT *, timezone('Europe/Zagreb', to_timestamp(hour_ts)) AS l FROM hours WHERE samples >= 50) GROUP BY 1, 2""")
def _(t):
    return bikes.station_flow(hours(t))


@query("agg_68_corridors", MOVES + """SELECT from_station, station_id AS to_station, count(*) AS trips, round(avg(floor((ts - departed_ts) / 60)), 6) AS avg_minutes FROM moves WHERE kind = 'return' GROUP BY 1, 2 ORDER BY trips DESC, 1, 2 LIMIT 10""")
def _(t):
    return bikes.corridors(bikes.rides(moves(t))).withColumns(r6("avg_minutes"))


@query("agg_69_utilisation", """SELECT count(*) AS active, sum(capacity)::BIGINT AS capacity, sum(num_bikes)::BIGINT AS bikes, count(*) FILTER (num_bikes = 0) AS empty, count(*) FILTER (num_docks = 0) AS "full", round(sum(num_bikes) / sum(capacity) * 100 * 10) / 10 AS pct FROM stations WHERE is_installed AND is_renting""")
def _(t):
    return bikes.utilisation(t.stations)


@query("agg_75_balance", """, r AS (SELECT station_id, num_docks / 13.0::DOUBLE AS e FROM stations)
SELECT * FROM (SELECT 'surplus' AS kind, station_id, (num_bikes - capacity)::DOUBLE AS value FROM stations WHERE num_bikes > capacity ORDER BY value DESC, station_id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'shortage', station_id, round(e, 6) FROM r WHERE e > 0 ORDER BY e DESC, station_id LIMIT 5)""")
def _(t):
    return bikes.balance(t.stations, t.stations.select("station_id", (F.col("num_docks") / 13.0).alias("empty_share"))).withColumns(r6("value"))


@query("src_14_dock_table", """SELECT station_id, coalesce(CASE WHEN station_id % 4 = 0 THEN NULL ELSE capacity END, num_bikes + num_docks) AS capacity, num_bikes FROM stations WHERE station_id % 10 <> 3""")
def _(t):
    s = t.stations
    info = s.select("station_id", F.when(F.col("station_id") % 4 != 0, F.col("capacity")).alias("capacity"), (F.col("station_id") % 10 == 3).alias("is_virtual"))
    return bikes.dock_table(info, s.select("station_id", "num_bikes", "num_docks")).select("station_id", "capacity", "num_bikes")


# --- districts ---------------------------------------------------------------


@query("agg_48_gini", """, x AS (SELECT *, sum(population) OVER (ORDER BY score, name) / (sum(population) OVER ())::DOUBLE AS p, sum(score * population) OVER (ORDER BY score, name) / sum(score * population) OVER () AS v FROM scores WHERE population > 0)
SELECT round(greatest(1 - 2 * sum((p - p0) * (v + v0) / 2), 0), 6) AS gini FROM (SELECT p, v, lag(p, 1, 0) OVER (ORDER BY score, name) AS p0, lag(v, 1, 0) OVER (ORDER BY score, name) AS v0 FROM x)""")
def _(t):
    return districts.gini(t.scores).withColumns(r6("gini"))


@query("agg_49_lorenz", "SELECT name, score, population, round(sum(population) OVER (ORDER BY score, name) / (sum(population) OVER ())::DOUBLE, 6) AS weight_share, round(sum(score * population) OVER (ORDER BY score, name) / sum(score * population) OVER (), 6) AS value_share FROM scores")
def _(t):
    return districts.lorenz(t.scores).withColumns(r6("weight_share", "value_share"))


@query("agg_50_weighted_change", "SELECT floor((sum(weekend * samples) - sum(reach * samples)) / sum(reach * samples) * 100 + 0.5)::BIGINT AS change_pct FROM scores WHERE weekend IS NOT NULL")
def _(t):
    return districts.weighted_change(t.scores, "reach", "weekend")


@query("agg_51_city_summary", """SELECT round(sum(reach * samples) / sum(samples), 6) AS reach, round(sum(score * population) / sum(population), 6) AS score, sum(population) FILTER (score < 25)::BIGINT AS poor_population, sum(population) FILTER (score >= 50)::BIGINT AS good_population, round(max(reach) / min(reach), 6) AS best_to_worst FROM scores""")
def _(t):
    return districts.city_summary(t.scores).withColumns(r6("reach", "score", "best_to_worst"))


@query("agg_52_bands", "SELECT CASE WHEN score >= 70 THEN 'excellent' WHEN score >= 50 THEN 'good' WHEN score >= 25 THEN 'fair' ELSE 'poor' END AS band, count(*) AS districts, sum(population)::BIGINT AS population FROM scores GROUP BY 1")
def _(t):
    return districts.bands(t.scores)


@query("agg_52_evening_drop", "SELECT name, (-floor((evening - reach) / reach * 100 + 0.5))::BIGINT AS drop_pct FROM scores")
def _(t):
    return districts.evening_drop(t.scores)


@query("agg_56_weekend_change", "SELECT name, round(d * 10) / 10 AS change_pct, round(sum(d * population) OVER () / sum(population) OVER () * 10) / 10 AS city_pct FROM (SELECT *, (weekend - reach) / reach * 100 AS d FROM scores WHERE weekend IS NOT NULL AND reach > 0)")
def _(t):
    return districts.weekend_change(t.scores)


@query("agg_58_ranked", "SELECT name, reach, row_number() OVER (ORDER BY reach DESC, name)::INT AS rank, round(reach / max(reach) OVER (), 6) AS of_best FROM scores")
def _(t):
    return districts.ranked_by(t.scores, "reach").withColumns(r6("of_best"))


@query("agg_57_extremes", " UNION ALL ".join(f"SELECT '{v}' AS value, (SELECT name FROM scores WHERE {v} IS NOT NULL ORDER BY {v} DESC, name LIMIT 1) AS most, (SELECT name FROM scores WHERE {v} IS NOT NULL ORDER BY {v}, name LIMIT 1) AS least" for v in ("reach", "evening", "weekend")))
def _(t):
    return districts.extremes(t.scores, ["reach", "evening", "weekend"])


@query("join_23_backfilled", "SELECT name, coalesce(weekend, reach) AS weekend, score FROM scores")
def _(t):
    return districts.backfilled(t.scores.select("name", "weekend", "score"), t.scores.select("name", F.col("reach").alias("weekend")), ["weekend"])


@query("agg_54_matrix_summary", """, m AS (SELECT * FROM matrix WHERE origin <> dest AND minutes > 0)
SELECT (SELECT origin || '>' || dest FROM m ORDER BY minutes DESC, origin, dest LIMIT 1) AS worst, (SELECT max(minutes) FROM m) AS worst_min, (SELECT origin || '>' || dest FROM m ORDER BY minutes, origin, dest LIMIT 1) AS best, (SELECT min(minutes) FROM m) AS best_min, (SELECT round(avg(minutes), 6) FROM m) AS mean""")
def _(t):
    return districts.matrix_summary(t.matrix).withColumns(r6("mean"))


PAIRS = "SELECT a.origin, a.dest, greatest(a.minutes, b.minutes) AS minutes FROM matrix a JOIN matrix b ON a.origin = b.dest AND a.dest = b.origin WHERE a.origin < a.dest AND a.minutes > 0 AND b.minutes > 0 AND greatest(a.minutes, b.minutes) > 80"


@query("agg_55_slow_pairs", PAIRS)
def _(t):
    return districts.slow_pairs(t.matrix)


@query("agg_55_connectivity_gaps", f""", p AS ({PAIRS}) SELECT * FROM (SELECT 'underserved' AS kind, name, population AS value FROM scores WHERE score < 25 AND population > 20000 ORDER BY population DESC, name LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'pair', origin || '>' || dest, minutes FROM p ORDER BY minutes DESC, origin, dest LIMIT 2) UNION ALL SELECT * FROM (SELECT 'tramless', name, population FROM scores WHERE tram_lines = 0 AND population > 40000 ORDER BY population DESC, name LIMIT 1)""")
def _(t):
    return districts.connectivity_gaps(t.scores, t.matrix)


@query("agg_81_within_30", "SELECT origin, count(*) FILTER (minutes BETWEEN 1 AND 30) AS reached, count(*) AS districts FROM matrix WHERE origin <> dest GROUP BY 1")
def _(t):
    return districts.within(t.matrix)


@query("agg_88_quality_gate", """SELECT * FROM (SELECT 'missing' AS name, 1.0::DOUBLE AS floor, NULL::DOUBLE AS value, FALSE AS passed UNION ALL SELECT 'pairs', 100, count(*), count(*) >= 100 FROM matrix UNION ALL SELECT 'scores', 1000, count(*), count(*) >= 1000 FROM scores)""")
def _(t):
    n = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("value"))
    return districts.quality_gate(n(t.scores, "scores").unionByName(n(t.matrix, "pairs")), {"scores": 1000, "pairs": 100, "missing": 1})
