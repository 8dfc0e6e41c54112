"""Distances, bearings, areas and containment as column expressions over degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres of a degree of latitude, the share of it that a degree of longitude has, Earth's radius in km.
KM_PER_DEGREE = 111.32
LON_SHARE = 0.69716510293
EARTH_KM = 6371.0
#: Side of a reach cell in degrees and its area.
REACH_CELL = 0.002
REACH_CELL_KM2 = 0.0346


def flat_km2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared flat-earth distance."""
    dy, dx = (lat2 - lat1) * F.lit(KM_PER_DEGREE), (lon2 - lon1) * F.lit(KM_PER_DEGREE * LON_SHARE)
    return dx * dx + dy * dy


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth distance."""
    return F.sqrt(flat_km2(lat1, lon1, lat2, lon2))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from 0 to 360."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area of an array of (lon, lat) structs."""
    n = F.size(ring)
    shifted = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, shifted, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2 * F.lit(KM_PER_DEGREE * KM_PER_DEGREE * LON_SHARE)


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in the ring, by counting the edges that a ray crosses."""
    n = F.size(ring)
    before = F.concat(F.slice(ring, n, 1), F.slice(ring, 1, F.greatest(n - 1, F.lit(0))))
    crossed = F.zip_with(ring, before, lambda a, b: F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0))
    return F.coalesce(F.aggregate(crossed, F.lit(0), lambda s, x: s + x) % 2 == 1, F.lit(False))


def segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of a point from a segment."""
    x, y = (lon - lon1) * F.lit(LON_SHARE), lat - lat1
    dx, dy = (lon2 - lon1) * F.lit(LON_SHARE), lat2 - lat1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest((x * dx + y * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.sqrt(F.pow(x - t * dx, 2) + F.pow(y - t * dy, 2)) * F.lit(KM_PER_DEGREE)


def reach_km2(cells: Column) -> Column:
    """Area of a number of reach cells."""
    return cells * F.lit(REACH_CELL_KM2)


def slope_factor(rise: Column, run: Column) -> Column:
    """Walking speed on a slope against the flat."""
    s = F.when(run >= 10, rise / run).otherwise(0.0)
    return F.exp(F.lit(-3.5) * (F.abs(s + 0.05) - 0.05))
