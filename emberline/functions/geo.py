"""Positions on the analysis grid, and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The region and the grid.
WEST, SOUTH, EAST, NORTH = 108.0, -45.0, 160.0, 1.0
CELL = 0.05
COLUMNS, ROWS = 1040, 920
KM_PER_LON, KM_PER_LAT = 111.32, 110.57


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance, with the cosine of the mean latitude."""
    dx = (lon1 - lon2) * KM_PER_LON * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat1 - lat2) * KM_PER_LAT
    return F.sqrt(dx * dx + dy * dy)


def in_region(lon: Column, lat: Column) -> Column:
    """Closed box, for detections and vertices."""
    return lon.between(WEST, EAST) & lat.between(SOUTH, NORTH)


def in_grid(lon: Column, lat: Column) -> Column:
    """Half-open box, for soundings."""
    return (lon >= WEST) & (lon < EAST) & (lat >= SOUTH) & (lat < NORTH)


def cell_row(lat: Column) -> Column:
    return F.least(F.greatest(((NORTH - lat) / CELL).cast("long"), F.lit(0)), F.lit(ROWS - 1))


def cell_col(lon: Column) -> Column:
    return F.least(F.greatest(((lon - WEST) / CELL).cast("long"), F.lit(0)), F.lit(COLUMNS - 1))


def cell_lon(col: Column) -> Column:
    return F.lit(WEST) + (col + 0.5) * CELL


def cell_lat(row: Column) -> Column:
    return F.lit(NORTH) - (row + 0.5) * CELL


def any_vertex_in(coords: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a vertex of coords (array of lon and lat) lies in the closed box; false for none."""
    return F.exists(coords, lambda p: p["lon"].between(west, east) & p["lat"].between(south, north))


def vertex_mean(coords: Column, name: str) -> Column:
    """Mean of the vertices' lon or lat; null for none. A ring's closing vertex counts."""
    total = F.aggregate(coords, F.lit(0.0), lambda a, p: a + p[name])
    return F.try_divide(total, F.size(coords))
