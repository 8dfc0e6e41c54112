"""Street networks: rules for ways, binary walk graphs, areas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Way classes that one can walk.
WALKABLE = (
    "residential", "living_street", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link",
    "pedestrian", "footway", "path", "steps", "cycleway", "track", "service",
)
#: Way classes that one can ride, those that need a sign for it, and the values of the sign.
RIDEABLE = (
    "residential", "living_street", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link",
    "cycleway", "track", "service", "road", "path", "pedestrian", "footway",
)
SIGNED = ("path", "pedestrian", "footway")
BIKE_SIGNS = ("yes", "designated", "permissive", "official", "destination")


def _is(tag: Column, *values: str) -> Column:
    """Whether a tag has one of the values; a missing tag has none."""
    return F.coalesce(tag.isin(*values), F.lit(False))


def walkable(tags: Column) -> Column:
    """Whether a way with these tags is open on foot."""
    return _is(tags["highway"], *WALKABLE) & ~_is(tags["access"], "private") & ~_is(tags["foot"], "no")


def rideable(tags: Column) -> Column:
    """Whether a way with these tags is open by bike; paths are, unless they name others, footways need a sign, a track or a lane of their own."""
    bicycle = F.nullif(tags["bicycle"], F.lit(""))
    signed = F.when(bicycle.isNotNull(), _is(bicycle, *BIKE_SIGNS)).otherwise(_is(tags["highway"], "path")) | _is(tags["segregated"], "yes") | _is(tags["cycleway"], "track")
    shut = _is(tags["access"], "private", "no") | _is(tags["bicycle"], "no", "dismount") | _is(tags["motorroad"], "yes")
    return _is(tags["highway"], *RIDEABLE) & ~shut & (~_is(tags["highway"], *SIGNED) | signed)


def bike_direction(tags: Column) -> Column:
    """both, forward or backward, from one-way rules and their exceptions for bikes."""
    free = _is(tags["oneway:bicycle"], "no") | _is(tags["cycleway"], "opposite", "opposite_lane", "opposite_track")
    one_way = _is(tags["oneway"], "yes", "1", "true") | _is(tags["junction"], "roundabout")
    return F.when(free, "both").when(_is(tags["oneway"], "-1"), "backward").when(one_way, "forward").otherwise("both")


#: Parts of a degree in which coordinates are summed, those of the map files.
DEGREE = 10_000_000


def building_cells(ways: DataFrame, nodes: DataFrame, cell: float = 0.003) -> DataFrame:
    """Cells that hold the middle of a building: distinct (cy, cx)."""
    parts = ways.where(F.col("tags")["building"].isNotNull()).select("way_id", F.explode("refs").alias("node"))
    # sums of whole numbers, so the middle does not depend on their order
    mean = lambda c: F.sum(F.round(F.col(c) * DEGREE).cast("long")) / (F.count(c) * F.lit(DEGREE))
    middle = parts.join(nodes, "node").groupBy("way_id").agg(mean("lat").alias("lat"), mean("lon").alias("lon"))
    return middle.select(F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx")).distinct()


def walk_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, dst, dist_cm) of binary graph files in compressed rows.

    Layout, little endian: nodes and edges as uint32, then 2 float64 for each
    node, nodes + 1 offsets, targets and centimetres as uint32.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                n, e = np.frombuffer(raw, "<u4", 2)
                at = 8 + 16 * int(n)
                offsets = np.frombuffer(raw, "<u4", int(n) + 1, at)
                dst = np.frombuffer(raw, "<u4", int(e), at + 4 * (int(n) + 1))
                cm = np.frombuffer(raw, "<u4", int(e), at + 4 * (int(n) + 1) + 4 * int(e))
                src = np.repeat(np.arange(int(n)), np.diff(offsets))
                for lo in range(0, int(e), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000].astype(np.int64)) for x in (src, dst, cm)], names=["src", "dst", "dist_cm"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "src long, dst long, dist_cm long")


def districts(spark: SparkSession, path: str) -> DataFrame:
    """ord, name and outer ring of the first polygon of each feature of a GeoJSON file."""
    schema = "features array<struct<properties: struct<name: string, osm_id: long, population: long>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("ord", "f"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")[0][0]
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0]
    ring = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)
    return rows.select("ord", "f.properties.*", F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("ring"))


def slope_edges(edges: DataFrame) -> DataFrame:
    """Both directions of edges (a, b, metres, rise) with costs in centimetres on the flat."""
    from ..functions.geometry import slope_factor

    there = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "metres", "rise")
    back = edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "metres", (-F.col("rise")).alias("rise"))
    return there.unionByName(back).withColumn("cost_cm", F.round(F.col("metres") / slope_factor(F.col("rise"), F.col("metres")) * 100.0).cast("long"))
