"""Positions on the ellipsoid as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84.
SEMI_MAJOR = 6378137.0
ECCENTRICITY_SQUARED = 6.69437999014e-3


def ecef(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a point on the ellipsoid (height 0), in metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(SEMI_MAJOR) / F.sqrt(F.lit(1.0) - F.lit(ECCENTRICITY_SQUARED) * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * F.lit(1.0 - ECCENTRICITY_SQUARED) * F.sin(phi)


def chord(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Straight-line distance of two earth-centred points."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))


def lon180(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def lon360(lon: Column) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def intersection(p: tuple[Column, Column, Column, Column], q: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """(lon, lat) where the lines through two points each cross; p and q are (lon0, lat0, lon1, lat1). Null for parallels."""
    slope_p = F.try_divide(p[3] - p[1], p[2] - p[0])
    slope_q = F.try_divide(q[3] - q[1], q[2] - q[0])
    x = F.try_divide((q[1] - slope_q * q[0]) - (p[1] - slope_p * p[0]), slope_p - slope_q)
    return x, p[1] + slope_p * (x - p[0])


def chord_weights(at: tuple[Column, Column, Column], a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Weights of the two ends of a segment at a position, all earth-centred; they add to 1 only between the ends."""
    whole = chord(a, b)
    return F.try_divide(chord(at, b), whole), F.try_divide(chord(a, at), whole)


def segment_weights(x: tuple[Column, Column], p: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """The same for positions as (lon, lat)."""
    return chord_weights(ecef(x[1], x[0]), ecef(p[1], p[0]), ecef(p[3], p[2]))
