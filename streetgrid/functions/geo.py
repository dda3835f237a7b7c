"""Coordinates as column expressions: distances, headings, projections, tiles and cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii and metres in a degree; the projection is a named choice everywhere. Fixed values.
MEAN_RADIUS, MERCATOR_RADIUS = 6_371_008.8, 6_378_137.0
METRES_LAT, METRES_LON = 110_540.0, 111_320.0
HEADINGS = (0, 90, 180, 270)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def heading_error(target: Column, actual: Column) -> Column:
    """Smallest angle between two headings in degrees."""
    return F.abs(F.pmod(actual - target + 180, F.lit(360.0)) - 180)


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a centre, flat."""
    return (lon - lon0) * METRES_LON * F.cos(F.radians(lat0)), (lat - lat0) * METRES_LAT


def equirectangular_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Flat metres around a centre on the sphere of the equator's radius."""
    return MERCATOR_RADIUS * F.radians(lon - lon0) * F.cos(F.radians(lat0)), MERCATOR_RADIUS * F.radians(lat - lat0)


def mercator_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-mercator metres, stretched by 1 / cos(lat)."""
    return MERCATOR_RADIUS * F.radians(lon), MERCATOR_RADIUS * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def tile_x(lon: Column, zoom: int) -> Column:
    return ((lon + 180) / 360 * 2.0**zoom).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    p = F.radians(lat)
    return ((1 - F.ln(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * 2.0**zoom).cast("int")


def grid_cell(lat: Column, lon: Column, lat0: Column, lon0: Column, km: float) -> tuple[Column, Column]:
    """Cell (x, y) of a grid of ``km`` from a south-west corner."""
    x = (lon - lon0) * METRES_LON * F.cos(F.radians(lat0)) / 1000
    return F.floor(x / km), F.floor((lat - lat0) * METRES_LON / 1000 / km)


def block_cell(lat: Column, lon: Column, lat0: Column, cell_m: float) -> tuple[Column, Column]:
    """Cell (x, y) of absolute blocks of ``cell_m``; null without coordinates."""
    return F.floor(lon * METRES_LON * F.cos(F.radians(lat0)) / cell_m), F.floor(lat * METRES_LAT / cell_m)


def bbox_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Area of a box by its middle lines."""
    mid_lat, mid_lon = (south + north) / 2, (west + east) / 2
    return haversine_m(mid_lat, west, mid_lat, east) * haversine_m(south, mid_lon, north, mid_lon) / 1e6


def metres_to_lat(m: Column) -> Column:
    return m / METRES_LON


def metres_to_lon(m: Column, lat: Column) -> Column:
    return m / (METRES_LON * F.cos(F.radians(lat)))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def tile_boxes(west: Column, south: Column, east: Column, north: Column, step: float) -> Column:
    """Boxes (west, south, east, north) of at most ``step`` degrees that cover an area, row by row from the south; the last of each row
    and column are cut at the area's edge. An area without extent has none."""
    starts = lambda a, b: F.when(b > a, F.transform(F.sequence(F.lit(0), F.ceil((b - a) / step).cast("int") - 1), lambda i: a + i * step)).otherwise(F.array().cast("array<double>"))
    box = lambda y, x: F.struct(x.alias("west"), y.alias("south"), F.least(x + step, east).alias("east"), F.least(y + step, north).alias("north"))
    return F.flatten(F.transform(starts(south, north), lambda y: F.transform(starts(west, east), lambda x: box(y, x))))
