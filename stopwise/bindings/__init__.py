"""Transit tables derived by arithmetic from the synthetic TPC-like tables.

Each view is given twice: as Spark SQL for the library's queries and as DuckDB
SQL for their oracles.  Most texts serve both; where the engines differ the
difference is stated beside the view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: First second of the events table.
EPOCH = 1704067200

#: Views in both dialects. ``{epoch}`` is whole seconds of events.ts, ``{dow}`` the weekday of orders (0 is Sunday), ``{day}`` the days since 1995-01-01.
VIEWS: dict[str, str] = {
    # minutes are compressed by 60 so that a minute and route hold several trips
    "rt_obs": f"""SELECT event_id, {EPOCH} + CAST(floor(({{epoch}} - {EPOCH}) / 60.0) AS BIGINT) AS ts, event_type AS route_id, CAST(user_id AS {{text}}) AS trip_id,
        CAST(floor(value * 10) AS INT) - 300 AS delay, CAST(1 + event_id % 12 AS INT) AS stop_sequence,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE {EPOCH} + CAST(floor(({{epoch}} - {EPOCH}) / 60.0) AS BIGINT) + CAST(floor(value * 10) AS BIGINT) - 300 END AS predicted,
        CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 20 END AS speed_mps, CAST(event_id % 7 AS INT) AS occupancy_level FROM events""",
    "alerts": """SELECT event_id AS alert_id, {epoch} AS first_seen, CAST(event_id % 11 AS INT) AS cause, CAST(user_id % 8 AS INT) AS effect, concat('A', user_id % 40) AS header,
        concat('R', user_id % 13, ',', CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('R', event_id % 7) END) AS route_ids FROM events WHERE event_type = 'error'""",
    "bike_polls": f"""SELECT poll_ord, {EPOCH} + 60 * poll_ord AS poll_ts, bike_id, station_id FROM (
        SELECT CAST(floor(event_id / 50) AS BIGINT) AS poll_ord, user_id AS bike_id, concat('S', event_type) AS station_id, row_number() OVER (PARTITION BY floor(event_id / 50), user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1""",
    "departures": """SELECT l_partkey % 40 AS pattern_idx, CASE WHEN l_partkey % 40 % 3 = 0 THEN 'TRAM' WHEN l_partkey % 40 % 7 = 0 THEN 'RAIL' ELSE 'BUS' END AS mode,
        concat('L', l_partkey % 40 % 23) AS route, CAST((l_orderkey * 37 + l_linenumber * 911) % 93600 AS BIGINT) AS dep_sec FROM lineitem""",
    "stops": """SELECT c_custkey AS stop_idx, c_name AS name, CAST(45.75 AS DOUBLE) + (c_custkey * 37 % 101) * CAST(0.0006 AS DOUBLE) AS lat, CAST(15.85 AS DOUBLE) + (c_custkey * 59 % 103) * CAST(0.0008 AS DOUBLE) AS lon, c_nationkey AS kvart FROM customer""",
    "stations": """SELECT s_suppkey AS station_id, s_name AS name, CAST(45.75 AS DOUBLE) + (s_suppkey * 37 % 101) * CAST(0.0006 AS DOUBLE) AS lat, CAST(15.85 AS DOUBLE) + (s_suppkey * 59 % 103) * CAST(0.0008 AS DOUBLE) AS lon, CAST(s_suppkey % 30 + 5 AS INT) AS capacity,
        CAST(s_suppkey % 17 AS INT) AS num_bikes, CAST(s_suppkey % 13 AS INT) AS num_docks, s_suppkey % 19 <> 0 AS is_installed, s_suppkey % 23 <> 0 AS is_renting FROM supplier""",
    "districts": """SELECT CAST(n_nationkey AS INT) AS ord, n_name AS name, CAST(45.75 AS DOUBLE) + CAST(floor(n_nationkey / 5) AS INT) * CAST(0.0122 AS DOUBLE) AS lat0, CAST(15.85 AS DOUBLE) + CAST(n_nationkey % 5 AS INT) * CAST(0.0166 AS DOUBLE) AS lon0,
        CAST((n_nationkey * 7919) % 60000 + 5000 AS BIGINT) AS population FROM nation""",
    # a pattern visits eight stops along a chain of the lattice
    "pattern_stops": """SELECT p.pattern_idx AS pattern_idx, k.pos AS stop_pos, (p.pattern_idx * 13 + k.pos * (1 + p.pattern_idx % 5)) % n.n AS stop_idx, CAST(k.pos * (90 + p.pattern_idx) AS BIGINT) AS offset_sec
        FROM (SELECT DISTINCT l_partkey % 40 AS pattern_idx FROM lineitem) p CROSS JOIN (SELECT DISTINCT l_linenumber AS pos0, CAST(l_linenumber AS BIGINT) - 1 AS pos FROM lineitem) k CROSS JOIN (SELECT count(*) AS n FROM customer) n""",
    "trips": """SELECT o_orderkey AS trip_id, concat('R', o_custkey % 31) AS route_id, CAST({dow} AS INT) AS dow, CAST(o_orderkey % 2 AS INT) AS direction, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey % 97 END AS block_id,
        o_orderstatus AS headsign, CAST({day} AS INT) AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'TRAM' ELSE 'BUS' END AS mode FROM orders""",
    "scores": """SELECT CAST(n_nationkey AS INT) AS ord, n_name AS name, CAST((n_nationkey * 7919) % 60000 + 5000 AS BIGINT) AS population, CAST((n_nationkey * 37) % 41 + 3 AS INT) AS samples,
        CAST((n_nationkey * 1237) % 97 + 3 AS DOUBLE) AS score, CAST((n_nationkey * 911) % 211 + 40 AS DOUBLE) AS reach, CAST((n_nationkey * 577) % 173 + 20 AS DOUBLE) AS evening,
        CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE CAST((n_nationkey * 389) % 151 + 25 AS DOUBLE) END AS weekend, CAST((n_nationkey * 71) % 9 AS INT) AS tram_lines FROM nation""",
    "matrix": """SELECT a.n_name AS origin, b.n_name AS dest, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0 WHEN (a.n_nationkey * 3 + b.n_nationkey) % 29 = 0 THEN -1 ELSE CAST((a.n_nationkey * 31 + b.n_nationkey * 17) % 120 AS INT) END AS minutes
        FROM nation a CROSS JOIN nation b""",
    "streets": """SELECT p_name AS street, p_brand AS settlement, CAST(p_size AS INT) AS house, p_partkey AS ord FROM part""",
}

_SPARK = {"epoch": "unix_timestamp(CAST(ts AS TIMESTAMP))", "text": "STRING", "dow": "dayofweek(o_orderdate) - 1", "day": "datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')"}
_DUCKDB = {"epoch": "CAST(floor(epoch(ts)) AS BIGINT)", "text": "VARCHAR", "dow": "dayofweek(o_orderdate)", "day": "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"}


class Tables:
    """The views over a folder of tables, by name: ``t.rt_obs``; source tables too."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            if name.startswith("_"):
                raise AttributeError(name)
            return self.source(name)
        # tables are passed as parameters, so no view of the session is touched
        text, used = VIEWS[name].format(**_SPARK), {}
        for t in ("events", "orders", "lineitem", "customer", "supplier", "nation", "part"):
            if re.search(rf"FROM {t}\b|JOIN {t}\b", text):
                text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
                used[t] = self.source(t)
        return self.spark.sql(text, **used)


def oracle(body: str) -> str:
    """A DuckDB statement over the views; body is a SELECT or begins with further named tables: ``, x AS (...) SELECT``."""
    views = ",\n".join(f"{k} AS ({v.format(**_DUCKDB)})" for k, v in VIEWS.items() if k in body or k == "rt_obs")
    return f"WITH RECURSIVE {views}\n{body}"
