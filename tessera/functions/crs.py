"""Coordinate reference systems: WGS-84 and its UTM zones, as column expressions.

Transverse Mercator by the Krueger series in the third flattening, to the sixth
order; accurate to well under a millimetre within a zone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import let, point

#: Fixed values of the WGS-84 ellipsoid and the UTM grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0
WGS84_NAMES = {"EPSG:4326", "WGS84", "CRS84"}

_n = FLATTENING / (2 - FLATTENING)
_e = ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
RECTIFYING = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180 - 127 * _n**5 / 288 + 7891 * _n**6 / 37800,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440 + 281 * _n**5 / 630 - 1983433 * _n**6 / 1935360,
    61 * _n**3 / 240 - 103 * _n**4 / 140 + 15061 * _n**5 / 26880 + 167603 * _n**6 / 181440,
    49561 * _n**4 / 161280 - 179 * _n**5 / 168 + 6601661 * _n**6 / 7257600,
    34729 * _n**5 / 80640 - 3418889 * _n**6 / 1995840,
    212378941 * _n**6 / 319334400,
)
BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360 - 81 * _n**5 / 512 + 96199 * _n**6 / 604800,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440 + 46 * _n**5 / 105 - 1118711 * _n**6 / 3870720,
    17 * _n**3 / 480 - 37 * _n**4 / 840 - 209 * _n**5 / 4480 + 5569 * _n**6 / 90720,
    4397 * _n**4 / 161280 - 11 * _n**5 / 504 - 830251 * _n**6 / 7257600,
    4583 * _n**5 / 161280 - 108847 * _n**6 / 3991680,
    20648693 * _n**6 / 638668800,
)


def is_wgs84(crs: str) -> bool:
    return crs.upper().replace(" ", "") in WGS84_NAMES


def is_wgs84_column(crs: Column) -> Column:
    return F.upper(F.replace(crs, F.lit(" "), F.lit(""))).isin(*sorted(WGS84_NAMES))


def utm_zone(crs: str) -> tuple[int, bool]:
    """Zone number and whether it is southern, of ``EPSG:326zz`` or ``EPSG:327zz``."""
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", crs.upper().replace(" ", ""))
    if not m or not 1 <= int(m[2]) <= 60:
        raise ValueError(f"unsupported coordinate system: {crs}")
    return int(m[2]), m[1] == "7"


def _series(xi: Column, eta: Column, factors: tuple[float, ...]) -> tuple[Column, Column]:
    dx, dy = F.lit(0.0), F.lit(0.0)
    for k, a in enumerate(factors, 1):
        dx = dx + F.sin(2.0 * k * xi) * F.cosh(2.0 * k * eta) * a
        dy = dy + F.cos(2.0 * k * xi) * F.sinh(2.0 * k * eta) * a
    return dx, dy


def to_utm(p: Column, crs: str) -> Column:
    """A point of longitude x and latitude y in metres of the zone."""
    zone, south = utm_zone(crs)
    return _to_zone(p, F.lit(6.0 * zone - 183.0), F.lit(FALSE_NORTHING_SOUTH if south else 0.0))


def _to_zone(p: Column, meridian: Column, north: Column) -> Column:
    def project(v: Column) -> Column:
        t = F.sinh(F.atanh(F.sin(v["lat"])) - F.atanh(F.sin(v["lat"]) * _e) * _e)
        q = F.struct(F.atan2(t, F.cos(v["lon"])).alias("xi"), F.asinh(F.sin(v["lon"]) / F.sqrt(t * t + F.cos(v["lon"]) * F.cos(v["lon"]))).alias("eta"))

        def place(w: Column) -> Column:
            dx, dy = _series(w["xi"], w["eta"], ALPHA)
            return point((w["eta"] + dy) * (SCALE * RECTIFYING) + FALSE_EASTING, (w["xi"] + dx) * (SCALE * RECTIFYING) + north)

        return let(q, place)

    return let(F.struct((F.radians(p["x"]) - F.radians(meridian)).alias("lon"), F.radians(p["y"]).alias("lat")), project)


def from_utm(p: Column, crs: str) -> Column:
    """Metres of the zone as a point of longitude x and latitude y."""
    zone, south = utm_zone(crs)
    return _from_zone(p, F.lit(6.0 * zone - 183.0), F.lit(FALSE_NORTHING_SOUTH if south else 0.0))


def _from_zone(p: Column, meridian: Column, north: Column) -> Column:
    q = F.struct(
        ((p["y"] - north) / (SCALE * RECTIFYING)).alias("xi"), ((p["x"] - FALSE_EASTING) / (SCALE * RECTIFYING)).alias("eta")
    )

    def back(w: Column) -> Column:
        dx, dy = _series(w["xi"], w["eta"], BETA)
        return let(F.struct((w["xi"] - dx).alias("xi"), (w["eta"] - dy).alias("eta")), place)

    def place(w: Column) -> Column:
        t0 = F.sin(w["xi"]) / F.sqrt(F.sinh(w["eta"]) * F.sinh(w["eta"]) + F.cos(w["xi"]) * F.cos(w["xi"]))
        lon = F.degrees(F.atan2(F.sinh(w["eta"]), F.cos(w["xi"]))) + meridian
        return point(lon, F.degrees(F.atan(_geographic(t0))))

    return let(q, back)


def _geographic(t0: Column) -> Column:
    """Tangent of the latitude from that of the conformal latitude, by Newton steps."""

    def improve(t: Column, _: Column) -> Column:
        s = F.sinh(F.atanh(t / F.sqrt(t * t + 1.0) * _e) * _e)
        c = t * F.sqrt(s * s + 1.0) - s * F.sqrt(t * t + 1.0)
        step = (t0 - c) / F.sqrt(c * c + 1.0) * (t * t * (1 - _e**2) + 1.0) / ((1 - _e**2) * F.sqrt(t * t + 1.0))
        return t + step

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), t0, improve)


def reproject(ring: Column, source: str, target: str) -> Column:
    """Every vertex of a ring from one system to another; unknown systems raise."""
    if source.upper().replace(" ", "") == target.upper().replace(" ", ""):
        return ring
    geographic = ring if is_wgs84(source) else F.transform(ring, lambda p: from_utm(p, source))
    return geographic if is_wgs84(target) else F.transform(geographic, lambda p: to_utm(p, target))


def _system(crs: Column) -> Column:
    """``wgs84, meridian, north`` of a system that a column names; null for null, an error for an unknown one."""
    name = F.upper(F.replace(crs, F.lit(" "), F.lit("")))
    zone = F.regexp_extract(name, r"^EPSG:32[67](\d\d)$", 1).try_cast("int")
    wgs84 = name.isin(*sorted(WGS84_NAMES))
    known = wgs84 | zone.between(1, 60)
    stop = F.raise_error(F.concat(F.lit("unsupported coordinate system: "), crs)).cast("double")
    meridian = F.when(known, F.coalesce(6.0 * zone - 183.0, F.lit(0.0))).otherwise(stop)
    north = F.when(F.substring(name, 8, 1) == "7", F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    return F.when(crs.isNotNull(), F.struct(wgs84.alias("wgs84"), meridian.alias("meridian"), north.alias("north"), name.alias("name")))


def reproject_between(ring: Column, source: Column, target: Column) -> Column:
    """Every vertex of a ring from the system that one column names to that of another.

    One expression serves any mix of systems, row by row; a null system gives
    null, an unknown one an error.
    """

    def moved(v: Column) -> Column:
        s, t = v["s"], v["t"]
        there = F.when(s["wgs84"], v["r"]).otherwise(F.transform(v["r"], lambda p: _from_zone(p, s["meridian"], s["north"])))
        back = let(there, lambda g: F.when(t["wgs84"], g).otherwise(F.transform(g, lambda p: _to_zone(p, t["meridian"], t["north"]))))
        return F.when(s["name"] == t["name"], v["r"]).when(s.isNotNull() & t.isNotNull(), back)

    return let(F.struct(_system(source).alias("s"), _system(target).alias("t"), ring.alias("r")), moved)
