"""Universal transverse Mercator to and from degrees on WGS 84, by Krüger's series, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXIS, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
FALSE_EAST, FALSE_NORTH = 500_000.0, 10_000_000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = SCALE * AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)
# The series' coefficients, to the fourth power of the third flattening.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def central_meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def zone_of(lon: Column) -> Column:
    """The zone of a longitude, without the exceptions of Norway and Svalbard."""
    return F.least(F.greatest(F.floor((lon + 180.0) / 6.0) + 1, F.lit(1)), F.lit(60))


def to_degrees(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude; null if anything is null. Good to a nanometre within a zone."""
    xi = (northing - F.when(south, FALSE_NORTH).otherwise(0.0)) / RADIUS
    eta = (easting - FALSE_EAST) / RADIUS
    up, along = xi, eta
    for j, b in enumerate(BETA, 1):
        up = up - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        along = along - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(up) / F.cosh(along))
    lat = conformal
    for j, c in enumerate(DELTA, 1):
        lat = lat + c * F.sin(2 * j * conformal)
    known = south.isNotNull()
    lon = central_meridian(zone) + F.degrees(F.atan2(F.sinh(along), F.cos(up)))
    return F.when(known, lon), F.when(known, F.degrees(lat))


def from_degrees(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone; south of the equator with its false northing."""
    phi, away = F.radians(lat), F.radians(lon - central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    up, along = xi, eta
    for j, a in enumerate(ALPHA, 1):
        up = up + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        along = along + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return FALSE_EAST + RADIUS * along, RADIUS * up + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)


def centre_degrees(row: Column, col: Column, west: Column, north: Column, pixel: float, zone: Column, south: Column) -> tuple[Column, Column]:
    """The place of a cluster whose pixels have these mean row and column, in an image whose corner is west and north in metres."""
    return to_degrees(west + (col + 0.5) * pixel, north - (row + 0.5) * pixel, zone, south)
