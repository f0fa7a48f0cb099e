"""Coordinate systems by closed formulas, as column expressions: geographic WGS84 (4326),
geocentric (4978), web Mercator (3857), UTM on WGS84 (32601 to 32660 north, 32701 to 32760 south), and
the French conformal conics (3942 to 3950, 2154)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoids.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_F = 1 / 298.257222101


class UnknownSystem(ValueError):
    """There is no formula for this pair of systems."""


class SourceSystemMissing(ValueError):
    """A target system is given without a source system."""


def to_ecef(lon: Column, lat: Column, height: Column) -> list[Column]:
    """Degrees and metres to geocentric x, y, z."""
    e2 = WGS84_F * (2 - WGS84_F)
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(e2) * F.sin(la) * F.sin(la))
    return [(n + height) * F.cos(la) * F.cos(lo), (n + height) * F.cos(la) * F.sin(lo), (n * (1 - e2) + height) * F.sin(la)]


def from_ecef(x: Column, y: Column, z: Column) -> list[Column]:
    """Geocentric to degrees and metres, by Bowring's formula and one correction."""
    a, f = WGS84_A, WGS84_F
    b, e2 = a * (1 - f), f * (2 - f)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    lat = F.atan2(z + F.lit(e2 / (1 - e2) * b) * F.pow(F.sin(t), 3), p - F.lit(e2 * a) * F.pow(F.cos(t), 3))
    n = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin(lat) * F.sin(lat))
    height = p * F.cos(lat) + z * F.sin(lat) - F.lit(a * a) / n
    return [F.degrees(F.atan2(y, x)), F.degrees(lat), height]


def _conic(epsg: int) -> tuple[float, float, float, float, float, float]:
    """lat0, lon0, lat1, lat2, x0, y0.  CC42 to CC50 have a parallel each, 0.75 degrees around it."""
    if epsg == 2154:
        return 46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0
    if 3942 <= epsg <= 3950:
        at = epsg - 3900
        return float(at), 3.0, at - 0.75, at + 0.75, 1700000.0, (at - 41) * 1e6 + 200000.0
    raise UnknownSystem(f"EPSG:{epsg}")


def _cone(epsg: int) -> tuple[float, float, float, float, float, float, float]:
    """n, a*F, rho0, lon0, x0, y0, e of a Lambert conformal conic with two parallels."""
    lat0, lon0, lat1, lat2, x0, y0 = _conic(epsg)
    e = math.sqrt(GRS80_F * (2 - GRS80_F))
    r = math.radians

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p: float) -> float:
        s = e * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    n = (math.log(m(r(lat1))) - math.log(m(r(lat2)))) / (math.log(t(r(lat1))) - math.log(t(r(lat2))))
    big = WGS84_A * m(r(lat1)) / (n * t(r(lat1)) ** n)
    return n, big, big * t(r(lat0)) ** n, r(lon0), x0, y0, e


def conic_forward(epsg: int, lon: Column, lat: Column) -> list[Column]:
    n, big, rho0, lon0, x0, y0, e = _cone(epsg)
    p = F.radians(lat)
    s = F.sin(p) * e
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho, turn = F.lit(big) * F.pow(t, F.lit(n)), (F.radians(lon) - lon0) * n
    return [F.lit(x0) + rho * F.sin(turn), F.lit(y0 + rho0) - rho * F.cos(turn)]


def conic_inverse(epsg: int, x: Column, y: Column) -> list[Column]:
    n, big, rho0, lon0, x0, y0, e = _cone(epsg)
    dx, dy = x - x0, F.lit(rho0 + y0) - y
    t = F.pow(F.sqrt(dx * dx + dy * dy) / big, F.lit(1 / n))
    lat = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(6):
        s = F.sin(lat) * e
        lat = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return [F.degrees(F.atan2(dx, dy) / n + lon0), F.degrees(lat)]


def mercator_forward(lon: Column, lat: Column) -> list[Column]:
    """Web Mercator: the sphere of the ellipsoid's larger axis."""
    return [F.radians(lon) * WGS84_A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * WGS84_A]


def mercator_inverse(x: Column, y: Column) -> list[Column]:
    return [F.degrees(x / WGS84_A), F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)]


#: Krueger's series to the fourth power of the third flattening.
_N = WGS84_F / (2 - WGS84_F)
_MERIDIAN = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_TO_PLANE = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_FROM_PLANE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_UTM_SCALE, _UTM_EAST, _UTM_SOUTH = 0.9996, 500000.0, 10000000.0


def _utm(epsg: int) -> tuple[float, float] | None:
    """Central meridian (radians) and false northing of a UTM zone; None if it is none."""
    zone, south = (epsg - 32600, 0.0) if epsg < 32700 else (epsg - 32700, _UTM_SOUTH)
    return (math.radians(6 * zone - 183), south) if 1 <= zone <= 60 else None


def _e() -> float:
    return math.sqrt(WGS84_F * (2 - WGS84_F))


def _asinh(c: Column) -> Column:
    return F.log(c + F.sqrt(c * c + 1))


def utm_forward(epsg: int, lon: Column, lat: Column) -> list[Column]:
    """By the conformal sphere and a series in the plane; millimetres within a zone."""
    lon0, north = _utm(epsg)
    e, p, turn = _e(), F.radians(lat), F.radians(lon) - lon0
    s = F.sin(p) * e
    sphere = F.sinh(_asinh(F.tan(p)) - F.log((1 + s) / (1 - s)) * (e / 2))  # the conformal latitude's tangent
    xi, eta = F.atan2(sphere, F.cos(turn)), _asinh(F.sin(turn) / F.sqrt(sphere * sphere + F.cos(turn) * F.cos(turn)))
    x, y = eta, xi
    for j, a in enumerate(_TO_PLANE, 1):
        x = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        y = y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    k = _UTM_SCALE * _MERIDIAN
    return [x * k + _UTM_EAST, y * k + north]


def utm_inverse(epsg: int, x: Column, y: Column) -> list[Column]:
    lon0, north = _utm(epsg)
    k = _UTM_SCALE * _MERIDIAN
    xi, eta = (y - north) / k, (x - _UTM_EAST) / k
    u, v = xi, eta
    for j, b in enumerate(_FROM_PLANE, 1):
        u = u - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        v = v - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    sphere = F.sin(u) / F.sqrt(F.sinh(v) * F.sinh(v) + F.cos(u) * F.cos(u))
    e, lat = _e(), F.atan(sphere)
    for _ in range(5):  # the latitude whose conformal latitude this is
        s = F.sin(lat) * e
        lat = F.atan(F.sinh(_asinh(sphere) + F.log((1 + s) / (1 - s)) * (e / 2)))
    return [F.degrees(F.atan2(F.sinh(v), F.cos(u)) + lon0), F.degrees(lat)]


def reproject(x: Column, y: Column, z: Column, source: str | int, target: str | int) -> list[Column]:
    """x, y, z from one EPSG system to another, by way of longitude and latitude."""
    source, target = int(source), int(target)
    if source == target:
        return [x, y, z]
    if source == 4326:
        lon, lat, h = x, y, z
    elif source == 4978:
        lon, lat, h = from_ecef(x, y, z)
    else:
        (lon, lat), h = _from_plane(source, x, y), z
    if target == 4326:
        return [lon, lat, h]
    if target == 4978:
        return to_ecef(lon, lat, h)
    return [*_to_plane(target, lon, lat), h]


def _to_plane(epsg: int, lon: Column, lat: Column) -> list[Column]:
    if epsg == 3857:
        return mercator_forward(lon, lat)
    return utm_forward(epsg, lon, lat) if _utm(epsg) else conic_forward(epsg, lon, lat)


def _from_plane(epsg: int, x: Column, y: Column) -> list[Column]:
    if epsg == 3857:
        return mercator_inverse(x, y)
    return utm_inverse(epsg, x, y) if _utm(epsg) else conic_inverse(epsg, x, y)
