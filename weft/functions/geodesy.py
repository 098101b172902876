"""Positions on the WGS84 ellipsoid and in local frames."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-axis in metres and flattening.
A, FLATTENING = 6_378_137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
#: Metres in a degree at the equator, for local plane frames.
DEGREE_M = 111_320.0


def to_ecef(lat: Column, lon: Column, alt: Column) -> Column:
    """Struct x, y, z in metres."""
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return F.struct(((n + alt) * F.cos(p) * F.cos(q)).alias("x"), ((n + alt) * F.cos(p) * F.sin(q)).alias("y"), ((n * (1 - E2) + alt) * F.sin(p)).alias("z"))


def from_ecef(x: Column, y: Column, z: Column) -> Column:
    """Struct lat, lon, alt by the closed form with a reduced latitude; good to a micrometre near the ground."""
    flat = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, flat * B)
    s, c = F.sin(theta), F.cos(theta)
    lat = F.atan2(z + (E2 / (1 - E2)) * B * s * s * s, flat - E2 * A * c * c * c)
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    alt = F.when(F.abs(F.cos(lat)) > 1e-9, flat / F.cos(lat) - n).otherwise(F.abs(z) - n * (1 - E2))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), alt.alias("alt"))


def to_enu(lat: Column, lon: Column, alt: Column, origin: tuple[float, float, float]) -> Column:
    """Struct east, north, up in metres from an origin (lat, lon, alt)."""
    p, q = math.radians(origin[0]), math.radians(origin[1])
    n0 = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
    x0, y0, z0 = (n0 + origin[2]) * math.cos(p) * math.cos(q), (n0 + origin[2]) * math.cos(p) * math.sin(q), (n0 * (1 - E2) + origin[2]) * math.sin(p)
    at = to_ecef(lat, lon, alt)
    dx, dy, dz = at["x"] - x0, at["y"] - y0, at["z"] - z0
    return F.struct(
        (dy * math.cos(q) - dx * math.sin(q)).alias("east"),
        (dz * math.cos(p) - (dx * math.cos(q) + dy * math.sin(q)) * math.sin(p)).alias("north"),
        ((dx * math.cos(q) + dy * math.sin(q)) * math.cos(p) + dz * math.sin(p)).alias("up"),
    )


def enu_to_ned(enu: Column) -> Column:
    return F.struct(enu["north"].alias("north"), enu["east"].alias("east"), (-enu["up"]).alias("down"))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def local_plane(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Struct x, y in metres of an equirectangular frame around a point."""
    return F.struct(((lon - lon0) * (DEGREE_M * math.cos(math.radians(lat0)))).alias("x"), ((lat - lat0) * DEGREE_M).alias("y"))


def travel_joules(lon: Column, lat: Column, lon0: float, lat0: float, joules_per_metre: float = 50.0) -> Column:
    """Energy to drive from a point, by degrees alone (good enough for choosing among near targets)."""
    return F.sqrt(F.pow((lon - lon0) * DEGREE_M, 2) + F.pow((lat - lat0) * DEGREE_M, 2)) * joules_per_metre
