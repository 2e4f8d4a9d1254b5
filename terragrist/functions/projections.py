"""Longitudes and latitudes of projected coordinates, as Column arithmetic and in numpy from the same formulas.

The formulas are the published ones of the geodetic parameter registry's guidance notes. Latitudes come from conformal or authalic ones by their series in
the third flattening, good to well under a millimetre. Datums are taken as equal to WGS 84.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Numpy:
    sin, cos, sinh, cosh, exp, sqrt, asin, atan, atan2, pow, mod = np.sin, np.cos, np.sinh, np.cosh, np.exp, np.sqrt, np.arcsin, np.arctan, np.arctan2, np.power, np.mod

    @staticmethod
    def unless_zero(x, y):
        return y / np.where(x == 0, 1.0, x)

    @staticmethod
    def between(x, low, high):
        return np.clip(x, low, high)


class _Columns:
    sin, cos, sinh, cosh, exp, sqrt, asin, atan, atan2 = F.sin, F.cos, F.sinh, F.cosh, F.exp, F.sqrt, F.asin, F.atan, F.atan2

    @staticmethod
    def pow(x, y):
        return F.pow(x, F.lit(y))

    @staticmethod
    def mod(x, y):
        return F.pmod(x, F.lit(y))

    @staticmethod
    def unless_zero(x, y):
        return y / F.when(x == 0, 1.0).otherwise(x)

    @staticmethod
    def between(x, low, high):
        return F.when(x < low, low).when(x > high, high).otherwise(x)


@dataclass(frozen=True)
class Projection:
    """Angles in degrees, lengths in units of `axis`; `method` is one of the keys of _INVERSE."""

    method: str
    lat0: float = 0.0
    lon0: float = 0.0
    lat1: float | None = None
    lat2: float | None = None
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    axis: float = 6378137.0
    inverse_flattening: float = 298.257223563

    def __post_init__(self) -> None:
        if self.method not in _INVERSE:
            raise ValueError(f"projection method {self.method!r} is not known, only {sorted(_INVERSE)}")

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening if self.inverse_flattening else 0.0

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    def lonlat(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Degrees as Columns."""
        return self._degrees(x.cast("double"), y.cast("double"), _Columns)

    def points(self, xy: np.ndarray) -> np.ndarray:
        """(longitude, latitude) rows of (x, y) rows."""
        return np.stack(self._degrees(xy[:, 0], xy[:, 1], _Numpy), axis=1)

    def _degrees(self, x, y, m):
        lon, lat = _INVERSE[self.method](self, x - self.east, y - self.north, m)
        lon = lon * (180 / math.pi) + self.lon0
        return m.mod(lon + 180.0, 360.0) - 180.0, lat * (180 / math.pi)

    # of the ellipsoid at a latitude in radians, as plain numbers
    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.e * math.sin(lat)) ** 2)

    def _t(self, lat: float) -> float:
        s = self.e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) * ((1 + s) / (1 - s)) ** (self.e / 2)

    def _q(self, lat: float) -> float:
        s, e = math.sin(lat), self.e
        return (1 - e**2) * (s / (1 - (e * s) ** 2) + (math.log((1 + e * s) / (1 - e * s)) / (2 * e) if e else s))

    def _of_conformal(self, chi, m):
        n = self.f / (2 - self.f)
        return chi + _sines(
            chi, (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630), m
        )

    def _of_authalic(self, beta, m):
        n = self.f / (2 - self.f)
        return beta + _sines(
            beta, (4 * n / 3 + 4 * n**2 / 45 - 16 * n**3 / 35 - 2582 * n**4 / 14175, 46 * n**2 / 45 + 152 * n**3 / 945 - 11966 * n**4 / 14175, 3044 * n**3 / 2835 + 3802 * n**4 / 14175, 6059 * n**4 / 4725), m
        )


def _sines(angle, weights, m):
    out = weights[0] * m.sin(2 * angle)
    for k, w in enumerate(weights[1:], 2):
        out = out + w * m.sin(2 * k * angle)
    return out


def _radians(*degrees: float) -> list[float]:
    return [math.radians(d) for d in degrees]


def _pseudo_mercator(p: Projection, x, y, m):
    return x / p.axis, math.pi / 2 - 2 * m.atan(m.exp(-y / p.axis))


def _mercator(p: Projection, x, y, m):
    k = p._m(math.radians(p.lat1)) if p.lat1 is not None else p.scale
    chi = math.pi / 2 - 2 * m.atan(m.exp(-y / (p.axis * k)))
    return x / (p.axis * k), p._of_conformal(chi, m)


def _transverse_mercator(p: Projection, x, y, m):
    n = p.f / (2 - p.f)
    radius = p.scale * p.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    chi0 = math.pi / 2 - 2 * math.atan(p._t(math.radians(p.lat0)))
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    xi = y / radius + (chi0 + sum(a * math.sin(2 * k * chi0) for k, a in enumerate(alpha, 1)))
    eta = x / radius
    xi_, eta_ = xi, eta
    for k, b in enumerate(beta, 1):
        xi_ = xi_ - b * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
        eta_ = eta_ - b * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
    chi = m.asin(m.between(m.sin(xi_) / m.cosh(eta_), -1.0, 1.0))
    return m.atan2(m.sinh(eta_), m.cos(xi_)), p._of_conformal(chi, m)


def _lambert_conic(p: Projection, x, y, m):
    lat0, lat1, lat2 = _radians(p.lat0, p.lat0 if p.lat1 is None else p.lat1, p.lat2 if p.lat2 is not None else p.lat0 if p.lat1 is None else p.lat1)
    n = math.sin(lat1) if lat1 == lat2 else math.log(p._m(lat1) / p._m(lat2)) / math.log(p._t(lat1) / p._t(lat2))
    size = p.scale * p.axis * p._m(lat1) / (n * p._t(lat1) ** n)
    sign, y = math.copysign(1.0, n), size * p._t(lat0) ** n - y
    rho = sign * m.sqrt(x * x + y * y)
    chi = math.pi / 2 - 2 * m.atan(m.pow(rho / size, 1 / n))
    return m.atan2(sign * x, sign * y) / n, p._of_conformal(chi, m)


def _polar_stereographic(p: Projection, x, y, m):
    south = (p.lat0 if p.lat1 is None else p.lat1) < 0
    e = p.e
    if p.lat1 is None or abs(p.lat1) == 90:
        size = 2 * p.axis * p.scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    else:
        at = math.radians(abs(p.lat1))
        size = p.axis * p._m(at) / p._t(at)
    chi = math.pi / 2 - 2 * m.atan(m.sqrt(x * x + y * y) / size)
    return (m.atan2(x, y), -p._of_conformal(chi, m)) if south else (m.atan2(x, -y), p._of_conformal(chi, m))


def _azimuthal_equal_area(p: Projection, x, y, m):
    lat0 = math.radians(p.lat0)
    pole = p._q(math.pi / 2)
    radius = p.axis * math.sqrt(pole / 2)
    if abs(p.lat0) == 90:
        sign = math.copysign(1.0, p.lat0)
        beta = m.asin(m.between(1 - (x * x + y * y) / (p.axis**2 * pole), -1.0, 1.0))
        return m.atan2(x, -sign * y), sign * p._of_authalic(beta, m)
    beta0 = math.asin(p._q(lat0) / pole)
    d = p.axis * p._m(lat0) / (radius * math.cos(beta0))
    x, y = x / d, d * y
    rho = m.sqrt(x * x + y * y)
    c = 2 * m.asin(m.between(rho / (2 * radius), -1.0, 1.0))
    beta = m.asin(m.between(m.cos(c) * math.sin(beta0) + m.unless_zero(rho, y * m.sin(c) * math.cos(beta0)), -1.0, 1.0))
    return m.atan2(x * m.sin(c), rho * math.cos(beta0) * m.cos(c) - y * math.sin(beta0) * m.sin(c)), p._of_authalic(beta, m)


def _albers(p: Projection, x, y, m):
    lat0, lat1, lat2 = _radians(p.lat0, p.lat1, p.lat2 if p.lat2 is not None else p.lat1)
    m1, q1 = p._m(lat1), p._q(lat1)
    n = math.sin(lat1) if lat1 == lat2 else (m1**2 - p._m(lat2) ** 2) / (p._q(lat2) - q1)
    c = m1**2 + n * q1
    y = p.axis * math.sqrt(c - n * p._q(lat0)) / n - y
    q = (c - (x * x + y * y) * (n / p.axis) ** 2) / n
    sign = math.copysign(1.0, n)
    return m.atan2(sign * x, sign * y) / n, p._of_authalic(m.asin(m.between(q / p._q(math.pi / 2), -1.0, 1.0)), m)


_INVERSE = {
    "popular visualisation pseudo mercator": _pseudo_mercator,
    "mercator": _mercator,
    "transverse mercator": _transverse_mercator,
    "lambert conic conformal": _lambert_conic,
    "polar stereographic": _polar_stereographic,
    "lambert azimuthal equal area": _azimuthal_equal_area,
    "albers equal area": _albers,
}

#: Systems in degrees, longitude first; fixed codes.
DEGREES = {"EPSG:4326", "EPSG:4979", "EPSG:4258", "EPSG:4269", "OGC:CRS84", "OGC:CRS84H", "OGC:CRS83", "CRS84", "WGS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84", "URN:OGC:DEF:CRS:OGC::CRS84", "URN:OGC:DEF:CRS:EPSG::4326"}

_GRS80 = 298.257222101
#: Parameters by code of the public registry; fixed values.
SYSTEMS = {
    2154: Projection("lambert conic conformal", 46.5, 3, 49, 44, 1, 700000, 6600000, inverse_flattening=_GRS80),
    3031: Projection("polar stereographic", -90, 0, -71),
    3032: Projection("polar stereographic", -90, 70, -71, None, 1, 6000000, 6000000),
    3034: Projection("lambert conic conformal", 52, 10, 35, 65, 1, 4000000, 2800000, inverse_flattening=_GRS80),
    3035: Projection("lambert azimuthal equal area", 52, 10, None, None, 1, 4321000, 3210000, inverse_flattening=_GRS80),
    3395: Projection("mercator"),
    3413: Projection("polar stereographic", 90, -45, 70),
    3857: Projection("popular visualisation pseudo mercator"),
    3976: Projection("polar stereographic", -90, 0, -70),
    3995: Projection("polar stereographic", 90, 0, 71),
    5070: Projection("albers equal area", 23, -96, 29.5, 45.5, inverse_flattening=_GRS80),
    32661: Projection("polar stereographic", 90, 0, None, None, 0.994, 2000000, 2000000),
    32761: Projection("polar stereographic", -90, 0, None, None, 0.994, 2000000, 2000000),
}


def _by_code(code: int) -> Projection:
    if code in SYSTEMS:
        return SYSTEMS[code]
    series, zone = divmod(code, 100)
    # UTM on WGS 84 north and south, ETRS89 and NAD83
    if series in (326, 327) and 1 <= zone <= 60 or series == 258 and 28 <= zone <= 38 or series == 269 and 1 <= zone <= 23:
        return Projection("transverse mercator", 0, 6 * zone - 183, None, None, 0.9996, 500000, 1e7 if series == 327 else 0, inverse_flattening=298.257223563 if series in (326, 327) else _GRS80)
    raise ValueError(f"EPSG:{code} is not supported")


#: Names of parameters in a described system.
_PARAMETERS = {
    "latitude of natural origin": "lat0", "latitude of false origin": "lat0", "longitude of natural origin": "lon0", "longitude of false origin": "lon0", "longitude of origin": "lon0",
    "latitude of 1st standard parallel": "lat1", "latitude of standard parallel": "lat1", "latitude of 2nd standard parallel": "lat2", "scale factor at natural origin": "scale",
    "false easting": "east", "easting at false origin": "east", "false northing": "north", "northing at false origin": "north",
}


def _ellipsoid(of: Mapping) -> tuple[float, float]:
    body = (of.get("datum") or of.get("datum_ensemble") or {}).get("ellipsoid") or {}
    value = lambda v: float(v["value"] * v["unit"]["conversion_factor"] if isinstance(v, Mapping) else v)
    axis = value(body.get("semi_major_axis", body.get("radius", 6378137.0)))
    if "radius" in body:
        return axis, 0.0
    if "semi_minor_axis" in body:
        b = value(body["semi_minor_axis"])
        return axis, axis / (axis - b) if axis != b else 0.0
    return axis, float(body.get("inverse_flattening", 298.257223563))


def _described(crs: Mapping) -> Projection | None:
    """A system spelled out by its method and parameters."""
    kind = crs.get("type")
    if kind in ("GeographicCRS", "GeodeticCRS"):
        return None
    if kind == "BoundCRS":
        return projection_of(crs["source_crs"])
    if kind != "ProjectedCRS":
        raise ValueError(f"reference system {crs.get('name')!r} of type {kind!r} is not supported")
    conversion = crs["conversion"]
    name = conversion["method"]["name"].lower().replace("_", " ")
    method = next((m for m in sorted(_INVERSE, key=len, reverse=True) if name.startswith(m)), name)
    if name == "transverse mercator (south orientated)" or name.startswith("lambert conic conformal (2sp "):
        method = name
    units = [a.get("unit", "metre") for a in (crs.get("coordinate_system") or {}).get("axis", [])] or ["metre"]
    metres = float(units[0]["conversion_factor"]) if isinstance(units[0], Mapping) else 1.0
    axis, inverse = _ellipsoid(crs["base_crs"])
    given: dict[str, float] = {}
    for p in conversion.get("parameters", ()):
        at, unit = _PARAMETERS.get(p["name"].lower()), p.get("unit")
        if at is None:
            raise ValueError(f"parameter {p['name']!r} is not supported")
        factor = float(unit["conversion_factor"]) if isinstance(unit, Mapping) else 1.0
        if at in ("east", "north"):
            factor /= metres
        elif at != "scale" and isinstance(unit, Mapping):
            factor = math.degrees(factor)
        given[at] = float(p["value"]) * factor
    return Projection(method, axis=axis / metres, inverse_flattening=inverse, **given)


def projection_of(crs: str | int | Mapping | None) -> Projection | None:
    """The projection of a code (3035, "EPSG:3035", a urn), or of a description as GeoParquet files carry it; None for degrees and where nothing is said.

    A described system is taken by its code if that is known here, else by its method and parameters. Raises ValueError for others.
    """
    if crs is None or isinstance(crs, str) and not crs.strip():
        return None
    if isinstance(crs, int):
        return None if f"EPSG:{crs}" in DEGREES else _by_code(crs)
    if isinstance(crs, str):
        text = crs.strip()
        if text.startswith("{"):
            return projection_of(json.loads(text))
        name = text.upper().replace(" ", "")
        if name in DEGREES:
            return None
        code = name.rpartition(":")[2]
        if not code.isdigit() or "EPSG" not in name and name != code:
            raise ValueError(f"reference system {crs!r} is not supported")
        return projection_of(int(code))
    said = crs.get("id") or {}
    name = f"{said.get('authority')}:{said.get('code')}".upper()
    if name in DEGREES:
        return None
    if str(said.get("authority")).upper() == "EPSG":
        try:
            return _by_code(int(said["code"]))
        except (ValueError, KeyError):
            if "type" not in crs:
                raise
    return _described(crs)


def lonlat(x: Column | str, y: Column | str, crs: str | int | Mapping | None) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of coordinate columns, in generated code."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    projection = projection_of(crs)
    return (x, y) if projection is None else projection.lonlat(x, y)
