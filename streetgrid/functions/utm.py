"""Transverse Mercator and UTM on the WGS84 ellipsoid, both ways, as column expressions and as SQL.

Krüger's series to the fourth order of the third flattening: well under a millimetre inside a zone and beyond it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid, the scale on the central meridian and the false origin. Fixed values.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, NORTH_SOUTHERN = 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECCENTRIC = 2 * math.sqrt(_N) / (1 + _N)
#: Coefficients of the series by powers of the third flattening. Fixed values.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACKWARD = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def zone(lon: Column) -> Column:
    """Number of the UTM zone of a longitude (without the exceptions around Norway)."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def meridian(zone: Column | int) -> Column:
    """Central meridian of a zone."""
    return (F.lit(zone) if isinstance(zone, int) else zone) * 6 - 183.0


def utm_xy(lat: Column, lon: Column, lon0: Column, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing around a central meridian; null for null."""
    s, d = F.sin(F.radians(lat)), F.radians(lon - lon0)
    t = F.sinh(F.atanh(s) - _ECCENTRIC * F.atanh(_ECCENTRIC * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * _RECTIFYING * x, (NORTH_SOUTHERN if south else 0.0) + SCALE * _RECTIFYING * y


def utm_latlon(x: Column, y: Column, lon0: Column, south: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude of easting and northing."""
    xi, eta = (y - (NORTH_SOUTHERN if south else 0.0)) / (SCALE * _RECTIFYING), (x - EAST) / (SCALE * _RECTIFYING)
    a, b = xi, eta
    for j, c in enumerate(_BACKWARD, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(lat), lon0 + F.degrees(F.atan2(F.sinh(b), F.cos(a)))


def utm_sql(lat: str, lon: str, lon0: str) -> tuple[str, str]:
    """SQL of ``utm_xy`` in the northern hemisphere."""
    number = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    s, d = f"sin(radians({lat}))", f"radians({lon} - ({lon0}))"
    t = f"sinh(atanh({s}) - {number(_ECCENTRIC)} * atanh({number(_ECCENTRIC)} * {s}))"
    xi, eta = f"atan2({t}, cos({d}))", f"atanh(sin({d}) / sqrt(1 + power({t}, 2)))"
    x, y = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        x += f" + {number(a)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
        y += f" + {number(a)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
    return f"(5e5 + {number(SCALE * _RECTIFYING)} * ({x}))", f"({number(SCALE * _RECTIFYING)} * ({y}))"
