"""Realtime history: per-minute route snapshots, headways, health, alerts, occupancy, rollups and retention.

Observations have (ts, route_id, trip_id, stop_sequence, delay, predicted): one
row for each stop update of a trip in a poll, ts in epoch seconds.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import deviation, floor_to, gaps, mean, round_to

#: Seconds of delay that routing accepts, on-time bounds, age of stale trips, usable headways, raw history kept.
PLAUSIBLE = (-300, 1800)
ON_TIME = (-60, 300)
STALE_AFTER = 120
HEADWAY_BOUNDS = (30, 3600)
LEAST_TIMES, LEAST_GAPS = 3, 2
RAW_SECONDS = 180 * 86400
FLOW_SECONDS = 365 * 86400


def plausible(obs: DataFrame) -> DataFrame:
    """Observations whose delay the routing store takes."""
    return obs.where(F.col("delay").between(*PLAUSIBLE))


def fresh(obs: DataFrame) -> DataFrame:
    """Without trips whose last predicted time in a poll is over two minutes old; trips without times stay."""
    last = obs.groupBy("ts", "trip_id", "route_id").agg(F.max("predicted").alias("_last"))
    stale = last.where(F.col("_last") < F.col("ts") - STALE_AFTER)
    return obs.join(stale, ["ts", "trip_id", "route_id"], "left_anti")


def minute(obs: DataFrame, seconds: int = 60) -> DataFrame:
    """Polls moved to their minute; of polls of one minute the first counts."""
    moved = obs.withColumn("minute", floor_to(F.col("ts"), seconds))
    first = moved.groupBy("minute").agg(F.min("ts").alias("ts"))
    return moved.join(first, ["minute", "ts"], "left_semi").drop("ts").withColumnRenamed("minute", "ts")


def headway(times: Column) -> Column:
    """Struct (mean, cv) of a route's arrival times at a stop; null fields where too few times or gaps are usable."""
    own = F.filter(gaps(F.sort_array(F.array_distinct(times))), lambda g: (g > HEADWAY_BOUNDS[0]) & (g < HEADWAY_BOUNDS[1]))
    good = (F.size(times) >= LEAST_TIMES) & (F.size(own) >= LEAST_GAPS)
    m = mean(own)
    return F.struct(F.when(good, m).alias("mean"), F.when(good & (m > 0), deviation(own) / m).alias("cv"))


def route_snapshots(obs: DataFrame, seconds: int = 60) -> DataFrame:
    """Per minute and route: mean of delays clamped at 0, the delay of greatest size, on-time share, trips, headway."""
    at = obs.withColumn("ts", floor_to(F.col("ts"), seconds))
    # a trip counts by its first stop
    first = at.groupBy("ts", "route_id", "trip_id").agg(F.min_by(F.struct("delay", "predicted"), F.struct("stop_sequence", "event_id")).alias("f")).select("ts", "route_id", "trip_id", "f.*")
    size = F.struct((-F.abs("delay")).alias("a"), "trip_id")  # of equal sizes the first trip
    out = first.groupBy("ts", "route_id").agg(
        F.avg(F.greatest(F.col("delay"), F.lit(0))).alias("avg_delay"), F.min_by("delay", size).alias("max_delay"),
        F.avg(F.when(F.col("delay").between(*ON_TIME), 1.0).otherwise(0.0)).alias("on_time_pct"), F.count("*").alias("trip_count"), headway(F.collect_list("predicted")).alias("h"),
    )
    return out.select("ts", "route_id", "avg_delay", "max_delay", "on_time_pct", "trip_count", F.col("h.mean").alias("headway_sec"), F.col("h.cv").alias("headway_cv"))


def speeds(obs: DataFrame, seconds: int = 300) -> DataFrame:
    """Mean of the speeds of 0 and more and their number, per step and route."""
    at = obs.where("speed_mps >= 0").groupBy(floor_to(F.col("ts"), seconds).alias("ts"), "route_id")
    return at.agg(F.avg("speed_mps").alias("avg_speed_mps"), F.count("*").alias("sample_count"))


def occupancy_counts(obs: DataFrame, seconds: int = 300) -> DataFrame:
    """Vehicles per step, route and level."""
    return obs.groupBy(floor_to(F.col("ts"), seconds).alias("ts"), "route_id", "occupancy_level").agg(F.count("*").alias("n"))


def occupancy_by_hour(counts: DataFrame, offset_sec: int) -> DataFrame:
    """Levels as empty (0, 1), few (2), standing (3, 4) and full (5), and all levels in total, per route and local hour."""
    some = lambda *levels: F.sum(F.when(F.col("occupancy_level").isin(*levels), F.col("n")).otherwise(0))
    hour = F.pmod(F.floor((F.col("ts") + offset_sec) / 3600), F.lit(24)).cast("int")
    return counts.groupBy("route_id", hour.alias("hour")).agg(some(0, 1).alias("empty"), some(2).alias("few"), some(3, 4).alias("standing"), some(5).alias("full"), F.sum("n").alias("total"))


def delay_profile(obs: DataFrame) -> DataFrame:
    """Mean, nearest-rank 90th percentile and number of delays per route and stop of the sequence."""
    return obs.groupBy("route_id", "stop_sequence").agg(F.avg("delay").alias("avg_delay"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY delay)").alias("p90_delay"), F.count("*").alias("samples"))


def route_health(snapshots: DataFrame) -> DataFrame:
    """Per route: mean delay, trip-weighted on-time share, mean headway and its variation, severity score and label; worst first."""
    n = F.sum("trip_count")
    own = snapshots.groupBy("route_id").agg(
        F.avg("avg_delay").alias("avg_delay"), (F.sum(F.col("on_time_pct") * F.col("trip_count")) / n).alias("on_time_pct"), F.avg("headway_cv").alias("headway_cv"),
        F.avg("headway_sec").alias("headway_sec"), F.count("*").alias("samples"), n.alias("trips"),
    ).where("trips > 0")
    late, uneven = (1.0 - F.col("on_time_pct")) * 40.0, F.greatest(F.coalesce("headway_cv", F.lit(0.0)) - 0.3, F.lit(0.0)) / 0.7 * 30.0
    slow = F.least(F.greatest(F.col("avg_delay"), F.lit(0.0)) / 60.0, F.lit(3.0)) * 10.0
    score = F.greatest(F.least(late + uneven + slow, F.lit(100.0)), F.lit(0.0))
    label = F.when(score < 20, "good").when(score < 45, "fair").when(score < 70, "poor").otherwise("critical")
    return own.withColumn("score", round_to(score, 1)).withColumn("label", label).orderBy(F.desc("score"), "route_id")


def alert_key(cause: str = "cause", effect: str = "effect", header: str = "header", routes: str = "route_ids") -> Column:
    """What makes two alerts the same: cause, effect, header and routes."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (cause, effect, header, routes)])


def first_alerts(alerts: DataFrame) -> DataFrame:
    """One row for each alert key, as first seen."""
    return alerts.withColumn("hash", alert_key()).groupBy("hash").agg(F.min(F.struct("first_seen", "alert_id")).alias("f")).select("hash", F.col("f.first_seen").alias("first_seen"), F.col("f.alert_id").alias("alert_id"))


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Numbers of alerts in total, by cause, by effect and by route; blanks of the route list are dropped."""
    route = F.explode(F.filter(F.split("route_ids", ","), lambda x: x != ""))
    kinds = [alerts.select(F.lit("total").alias("kind"), F.lit("all").alias("key")), alerts.select(F.lit("cause").alias("kind"), F.col("cause").cast("string").alias("key"))]
    kinds += [alerts.select(F.lit("effect").alias("kind"), F.col("effect").cast("string").alias("key")), alerts.select(F.lit("route").alias("kind"), route.alias("key"))]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.groupBy("kind", "key").agg(F.count("*").alias("n"))


def summary(obs: DataFrame) -> DataFrame:
    """Rows, distinct routes and the span of the history."""
    return obs.agg(F.count("*").alias("rows"), F.countDistinct("route_id").alias("routes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows of new whose key it lacks, one for each key (the least by all columns)."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*new.columns)).alias("_r")).select("_r.*")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti").select(target.columns))


def compact(snapshots: DataFrame, cutoff: Column) -> DataFrame:
    """Whole hours that begin before the cutoff, per route: mean delay, greatest delay, mean on-time share, rows."""
    hour = floor_to(F.col("ts"), 3600)
    old = snapshots.where(hour < cutoff)
    return old.groupBy(hour.alias("hour_ts"), "route_id").agg(F.avg("avg_delay").alias("avg_delay"), F.max("max_delay").alias("max_delay"), F.avg("on_time_pct").alias("on_time_pct"), F.count("*").alias("samples"))


def history(snapshots: DataFrame, cutoff: Column) -> DataFrame:
    """Hours before the cutoff, compacted, and the raw minutes from then on; columns that hours lack are null."""
    hours = compact(snapshots, cutoff).withColumnRenamed("hour_ts", "ts").withColumnRenamed("samples", "trip_count")
    raw = snapshots.where(floor_to(F.col("ts"), 3600) >= cutoff)
    return raw.unionByName(hours, allowMissingColumns=True)


def retained(rows: DataFrame, now: Column, seconds: int = RAW_SECONDS) -> DataFrame:
    """Rows that retention keeps."""
    return rows.where(F.col("ts") >= now - seconds)


def forward_filled(obs: DataFrame, stops: int = 12) -> DataFrame:
    """Delay at each stop of each trip and poll: that of the last update at or before it, 0 before the first."""
    trips = obs.select("ts", "route_id", "trip_id").distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(stops))).alias("stop_sequence"))
    known = obs.groupBy("ts", "route_id", "trip_id", "stop_sequence").agg(F.max("delay").alias("_delay"))
    w = W.partitionBy("ts", "route_id", "trip_id").orderBy("stop_sequence")
    joined = trips.join(known, ["ts", "route_id", "trip_id", "stop_sequence"], "left")
    return joined.select("ts", "route_id", "trip_id", "stop_sequence", F.coalesce(F.last("_delay", ignorenulls=True).over(w), F.lit(0)).alias("delay"))


def rolling_peak(series: DataFrame, value: str, seconds: int = 86400, by: list[str] | None = None) -> DataFrame:
    """The greatest value in the seconds up to each row; by splits the series into independent ones.

    Times are cut into spans of that length. A row's peak is the greatest value up to it
    in its span, or in the span before from its time less the seconds on: two running
    maxima over the distinct times of a span, so no row looks back over others.
    """
    keys = [*(by or []), "ts"]
    best = series.groupBy(*keys).agg(F.max(value).alias("_v"))
    at = best.select(*keys, F.floor(F.col("ts") / seconds).alias("_span"), F.col("_v").alias("_now"), F.lit(None).cast(dict(best.dtypes)["_v"]).alias("_before"))
    later = at.select(*(by or []), (F.col("ts") + seconds).alias("ts"), (F.col("_span") + 1).alias("_span"), F.col("_before").alias("_now"), F.col("_now").alias("_before"))
    both = at.withColumn("_own", F.lit(True)).unionByName(later.where("ts is not null").withColumn("_own", F.lit(False)))
    own = W.partitionBy(*(by or []), "_span")
    up, down = (own.orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in ("ts", F.desc("ts")))
    peaks = both.withColumn("peak", F.greatest(F.max("_now").over(up), F.max("_before").over(down))).where("_own")
    peaks = peaks.select(*[F.col(k).alias(f"_{k}") for k in keys], "peak")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return series.join(peaks, same, "left").select(*series.columns, "peak")


def running_trips(trips: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """Per route: trips scheduled at the instant, those also live, and their share in percent; the least first."""
    scheduled = trips.where((F.col("start_sec") <= now) & (F.col("end_sec") >= now))
    met = scheduled.join(live.select("trip_id").distinct().withColumn("_live", F.lit(1)), "trip_id", "left")
    out = met.groupBy("route_id").agg(F.count("*").alias("scheduled"), F.count("_live").alias("active"))
    return out.withColumn("pct", round_to(F.col("active") / F.col("scheduled") * 100.0, 1)).orderBy("pct", "route_id")


def speed_comparison(scheduled: DataFrame, live: DataFrame) -> DataFrame:
    """Scheduled against live speed in km/h and the ratio of the rounded values; null without live values."""
    own = live.groupBy("route_id").agg(F.avg("avg_speed_mps").alias("_mps"))
    met = scheduled.join(own, "route_id", "left").withColumn("live_kmh", round_to(F.col("_mps") * 3.6, 1)).drop("_mps")
    return met.withColumn("ratio", F.when(F.col("scheduled_kmh") > 0, round_to(F.col("live_kmh") / F.col("scheduled_kmh"), 2)))


def downsample(snapshots: DataFrame, buckets: int) -> DataFrame:
    """The series of each route in so many equal spans of time: trip-weighted means, greatest delay, middle of the span."""
    span = snapshots.groupBy("route_id").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    width = F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo")) / F.lit(float(buckets)))
    at = snapshots.join(span, "route_id").withColumn("bucket", F.least(F.floor((F.col("ts") - F.col("_lo")) / width), F.lit(buckets - 1)).cast("int"))
    n = F.col("trip_count")
    out = at.groupBy("route_id", "bucket").agg(
        (F.sum(F.col("avg_delay") * n) / F.sum(n)).alias("avg_delay"), F.max("max_delay").alias("max_delay"), (F.sum(F.col("on_time_pct") * n) / F.sum(n)).alias("on_time_pct"),
        F.sum(n).alias("trips"), F.floor((F.min("ts") + F.max("ts")) / 2).cast("long").alias("ts"),
    )
    return out


def punctuality(snapshots: DataFrame) -> DataFrame:
    """Trip-weighted mean delay, greatest delay and on-time trips over all rows."""
    n = F.col("trip_count")
    return snapshots.agg((F.sum(F.col("avg_delay") * n) / F.sum(n)).alias("avg_delay"), F.max("max_delay").alias("max_delay"), F.sum(F.col("on_time_pct") * n).alias("on_time_trips"), F.sum(n).alias("trips"))


def with_look_back(requests: DataFrame, updates: DataFrame, steps: int = 3) -> DataFrame:
    """Each request (pattern_idx, trip_no) with the delay of its own trip or the nearest of the steps trips before it."""
    tried = requests.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_back")).withColumn("_no", F.col("trip_no") - F.col("_back"))
    met = tried.join(updates.select("pattern_idx", F.col("trip_no").alias("_no"), "delay"), ["pattern_idx", "_no"])
    best = met.groupBy("pattern_idx", "trip_no").agg(F.min_by("delay", "_back").alias("delay"))
    return requests.join(best, ["pattern_idx", "trip_no"], "left")
