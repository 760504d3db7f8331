"""Coordinates of projected systems as longitude and latitude (WGS 84), as Columns.

Known are EPSG codes 4326 and 4258 (as they are), 3857, the UTM zones of WGS 84 (326xx, 327xx) and ETRS 89 (258xx), and
28992 with its datum shift (half a metre or better, as the shift has no grid).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    axis: float
    flattening: float

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)


#: Ellipsoids.
WGS84, GRS80, BESSEL = Ellipsoid(6_378_137.0, 1 / 298.257223563), Ellipsoid(6_378_137.0, 1 / 298.257222101), Ellipsoid(6_377_397.155, 1 / 299.1528128)
#: Shift of the Amersfoort datum to WGS 84 (metres, seconds of arc, parts per million; position vectors turn).
AMERSFOORT = (565.2369, 50.0087, 465.658, -0.406857330322398, 0.350732676542563, -1.8703473836068, 4.0812)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat(value: Column, step: Callable[[Column], Column], times: int) -> Column:
    for _ in range(times):
        value = let(value, step)
    return value


def _place(lon: Column, lat: Column) -> Column:
    """From radians."""
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))


def from_transverse_mercator(x: Column, y: Column, on: Ellipsoid, lon0: float, lat0: float, scale: float, false_x: float, false_y: float) -> Column:
    """struct(lon, lat) on the projection's own datum, by series in the third flattening to its fourth power."""
    f, e = on.flattening, math.sqrt(on.e2)
    n = f / (2 - f)
    size = on.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    back = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4)
    forth = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    low = math.radians(lat0)
    first = math.atan(math.sinh(math.asinh(math.tan(low)) - e * math.atanh(e * math.sin(low))))
    origin = size * (first + sum(h * math.sin(2 * k * first) for k, h in enumerate(forth, 1)))
    made = F.struct(((y - false_y + scale * origin) / (size * scale)).alias("n"), ((x - false_x) / (size * scale)).alias("e"))

    def sphere(p: Column) -> Column:
        north = p["n"] - sum(h * F.sin(2 * k * p["n"]) * F.cosh(2 * k * p["e"]) for k, h in enumerate(back, 1))
        east = p["e"] - sum(h * F.cos(2 * k * p["n"]) * F.sinh(2 * k * p["e"]) for k, h in enumerate(back, 1))
        return F.struct(north.alias("n"), east.alias("e"))

    def geographic(p: Column) -> Column:
        beta = F.asin(F.sin(p["n"]) / F.cosh(p["e"]))

        def latitude(q: Column) -> Column:
            return F.atan(F.sinh(_repeat(q, lambda s: q + e * F.atanh(e * F.tanh(s)), 4)))

        return _place(math.radians(lon0) + F.asin(F.tanh(p["e"]) / F.cos(beta)), let(F.asinh(F.tan(beta)), latitude))

    return let(let(made, sphere), geographic)


def from_oblique_stereographic(x: Column, y: Column, on: Ellipsoid, lon0: float, lat0: float, scale: float, false_x: float, false_y: float) -> Column:
    """struct(lon, lat) on the projection's own datum, by way of the conformal sphere."""
    e2, low, first = on.e2, math.radians(lat0), math.radians(lon0)
    e, s = math.sqrt(e2), math.sin(low)
    radius = on.axis * math.sqrt(1 - e2) / (1 - e2 * s * s)
    n = math.sqrt(1 + e2 * math.cos(low) ** 4 / (1 - e2))
    w = ((1 + s) / (1 - s) * ((1 - e * s) / (1 + e * s)) ** e) ** n
    part = (w - 1) / (w + 1)
    c = (n + s) * (1 - part) / ((n - s) * (1 + part))
    middle = math.asin((c * w - 1) / (c * w + 1))
    g = 2 * radius * scale * math.tan(math.pi / 4 - middle / 2)
    h = 4 * radius * scale * math.tan(middle) + g
    dx, dy = x - false_x, y - false_y
    turns = F.struct(F.atan(dx / (h + dy)).alias("i"), F.atan(dx / (g - dy)).alias("k"), dx.alias("dx"), dy.alias("dy"))

    def sphere(t: Column) -> Column:
        j = t["k"] - t["i"]
        high = middle + 2 * F.atan((t["dy"] - t["dx"] * F.tan(j / 2)) / (2 * radius * scale))
        return F.struct(high.alias("chi"), ((j + 2 * t["i"]) / n + first).alias("lon"))

    def geographic(p: Column) -> Column:
        psi = F.log((1 + F.sin(p["chi"])) / (c * (1 - F.sin(p["chi"])))) / (2 * n)

        def latitude(q: Column) -> Column:
            def step(a: Column) -> Column:
                own = F.log(F.tan(a / 2 + math.pi / 4) * F.pow((1 - e * F.sin(a)) / (1 + e * F.sin(a)), e / 2))
                return a - (own - q) * F.cos(a) * (1 - e2 * F.pow(F.sin(a), 2)) / (1 - e2)

            return _repeat(2 * F.atan(F.exp(q)) - math.pi / 2, step, 5)

        return _place(p["lon"], let(psi, latitude))

    return let(let(turns, sphere), geographic)


def shifted(place: Column, on: Ellipsoid, shift: tuple[float, ...], to: Ellipsoid = WGS84) -> Column:
    """A struct(lon, lat) of one datum on another, at height 0: seven parameters between geocentric coordinates."""
    tx, ty, tz = shift[:3]
    rx, ry, rz = (math.radians(s / 3600) for s in shift[3:6])
    m = 1 + shift[6] * 1e-6

    def geocentric(p: Column) -> Column:
        lon, lat = F.radians(p["lon"]), F.radians(p["lat"])
        v = on.axis / F.sqrt(1 - on.e2 * F.pow(F.sin(lat), 2))
        return F.struct((v * F.cos(lat) * F.cos(lon)).alias("x"), (v * F.cos(lat) * F.sin(lon)).alias("y"), (v * (1 - on.e2) * F.sin(lat)).alias("z"))

    def turned(p: Column) -> Column:
        return F.struct((tx + m * (p["x"] - rz * p["y"] + ry * p["z"])).alias("x"), (ty + m * (rz * p["x"] + p["y"] - rx * p["z"])).alias("y"), (tz + m * (-ry * p["x"] + rx * p["y"] + p["z"])).alias("z"))

    def geographic(p: Column) -> Column:
        flat = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        step = lambda a: F.atan2(p["z"] + to.e2 * to.axis * F.sin(a) / F.sqrt(1 - to.e2 * F.pow(F.sin(a), 2)), flat)
        return _place(F.atan2(p["y"], p["x"]), _repeat(F.atan2(p["z"], flat * (1 - to.e2)), step, 5))

    return let(let(let(place, geocentric), turned), geographic)


def to_lonlat(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lon, lat) of coordinates in the system of a code (a whole number or text); null for an unknown code or a
    missing coordinate. Coordinates of geographic codes are longitude, latitude."""
    code = epsg.try_cast("int") if hasattr(epsg, "try_cast") else epsg.cast("int")
    zone, x, y = code % 100, x.cast("double"), y.cast("double")
    mercator = _place(x / WGS84.axis, 2 * F.atan(F.exp(y / WGS84.axis)) - math.pi / 2)

    def utm(on: Ellipsoid, false_y: float) -> Column:
        """As if in the zone around longitude 0, then turned."""
        made = from_transverse_mercator(x, y, on, 0.0, 0.0, 0.9996, 500_000.0, false_y)
        return let(made, lambda p: F.struct((p["lon"] + (zone * 6 - 183)).alias("lon"), p["lat"].alias("lat")))

    known = (zone >= 1) & (zone <= 60)
    rd = shifted(from_oblique_stereographic(x, y, BESSEL, 5 + 23 / 60 + 15.5 / 3600, 52 + 9 / 60 + 22.178 / 3600, 0.9999079, 155_000.0, 463_000.0), BESSEL, AMERSFOORT)
    found = F.when(code.isin(4326, 4258), F.struct(x.alias("lon"), y.alias("lat"))).when(code == 3857, mercator).when(code == 28992, rd)
    found = found.when(known & (F.floor(code / 100) == 326), utm(WGS84, 0.0)).when(known & (F.floor(code / 100) == 327), utm(WGS84, 10_000_000.0)).when((zone >= 28) & (zone <= 38) & (F.floor(code / 100) == 258), utm(GRS80, 0.0))
    return F.when(x.isNotNull() & y.isNotNull(), found)
