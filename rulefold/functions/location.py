"""Hierarchical location ids (Zcountry/section/place), predicates over them, and the nearest sensor."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.session import stored

COUNTRY = 100
EARTH_RADIUS = 6_371_008.8
#: The id that ends a name.
PATTERN = rf"^.*Z{COUNTRY}/(\d+)/(\d+)$"


def last_part(urn: Column) -> Column:
    return F.element_at(F.split(urn, ":"), -1)


def section(urn: Column) -> Column:
    """Section of the id a name ends with; null if it does not parse."""
    return _number(urn, 1)


def place(urn: Column) -> Column:
    return _number(urn, 2)


def _number(urn: Column, group: int) -> Column:
    found = F.regexp_extract(last_part(urn), PATTERN, group)
    return F.when(found != "", found.cast("bigint"))


@dataclass(frozen=True)
class Location:
    """A set of places: ids (section, place or None for any), or everything."""

    ids: frozenset[tuple[int, int | None]] = frozenset()
    everything: bool = False

    def __add__(self, other: Location) -> Location:
        return Location(self.ids | other.ids, self.everything or other.everything)

    def contains(self, urn: Column) -> Column:
        """Never null: a name that does not parse lies in no location but `anywhere`."""
        if self.everything:
            return F.lit(True)
        sections = [s for s, p in self.ids if p is None]
        own = sorted((s, p) for s, p in self.ids if p is not None)
        test = F.lit(False)
        if sections:
            test = test | section(urn).isin(sorted(sections))
        for s, p in own:
            test = test | ((section(urn) == s) & (place(urn) == p))
        return F.coalesce(test, F.lit(False))

    def urns(self) -> list[str]:
        """The ids as text, sorted; a whole section ends in 'any'."""
        return sorted(f"Z{COUNTRY}/{s}/{'any' if p is None else p}" for s, p in self.ids)

    def __str__(self) -> str:
        return "any" if self.everything else " + ".join(self.urns()) or "nowhere"


anywhere = Location(everything=True)


@dataclass(frozen=True)
class _Id:
    section: int | None = None

    def __truediv__(self, part: int | str) -> _Id | Location:
        if self.section is None:
            return _Id(int(part))
        return Location(frozenset([(self.section, None if part == "any" else int(part))]))


Z100 = _Id()


def parse(text: str) -> Location | None:
    """A location from text such as Z100/6/979 or Z100/6/any, with anything before it; None if it is none."""
    parts = text.rsplit("/", 2)
    if len(parts) != 3 or not parts[0].endswith(f"Z{COUNTRY}") or not parts[1].isdigit():
        return None
    return Z100 / parts[1] / parts[2] if parts[2].isdigit() or parts[2] == "any" else None


def sensor_uuid(text: str) -> str:
    """A sensor id in canonical form; short groups are padded on the left."""
    sizes = (8, 4, 4, 4, 12)
    parts = text.strip().lower().split("-")
    if len(parts) != len(sizes):
        raise ValueError(f"not a uuid: {text}")
    return str(uuid.UUID("-".join(p.rjust(n, "0") for p, n in zip(parts, sizes, strict=True))))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres (haversine on the mean sphere); enough to order sensors by nearness."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(a))


#: Half axis in metres and flattening of the WGS 84 ellipsoid.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
#: Steps of the geodesic's iteration; each gains two digits or more unless the points are nearly antipodal.
GEODESIC_STEPS = 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres along the WGS 84 ellipsoid (Vincenty's inverse formula, right to a millimetre); null for nearly
    antipodal points, for which its iteration does not settle, and where a coordinate is null."""
    f, axis = FLATTENING, AXIS * (1 - FLATTENING)
    reduced = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    place = F.struct(reduced(lat1).alias("u"), reduced(lat2).alias("v"), F.radians(lon2 - lon1).alias("l"))

    def along(p: Column) -> Column:
        su, cu, sv, cv = F.sin(p["u"]), F.cos(p["u"]), F.sin(p["v"]), F.cos(p["v"])

        def arc(x: Column) -> Column:
            """On the auxiliary sphere, at a difference x of longitudes: the arc, its sine and cosine, and the azimuth's."""
            sine = F.sqrt(F.pow(cv * F.sin(x), 2) + F.pow(cu * sv - su * cv * F.cos(x), 2))
            both = F.struct(sine.alias("s"), (su * sv + cu * cv * F.cos(x)).alias("c"), F.coalesce(F.try_divide(cu * cv * F.sin(x), sine), F.lit(0.0)).alias("a"))
            return _let(both, lambda b: F.struct(b["s"].alias("s"), b["c"].alias("c"), b["a"].alias("a"), F.atan2(b["s"], b["c"]).alias("arc"), (1 - b["a"] * b["a"]).alias("q")))

        def middle(b: Column) -> Column:
            return F.when(b["q"] > 1e-15, b["c"] - F.try_divide(2 * su * sv, b["q"])).otherwise(0.0)

        def onward(b: Column) -> Column:
            k = f / 16 * b["q"] * (4 + f * (4 - 3 * b["q"]))
            m = middle(b)
            return p["l"] + (1 - k) * f * b["a"] * (b["arc"] + k * b["s"] * (m + k * b["c"] * (2 * m * m - 1)))

        step = lambda state, _: F.struct(_let(arc(state["x"]), onward).alias("x"), state["x"].alias("was"))
        start = F.struct(p["l"].alias("x"), F.lit(None).cast("double").alias("was"))
        last = F.aggregate(F.sequence(F.lit(1), F.lit(GEODESIC_STEPS)), start, step)

        def length(b: Column) -> Column:
            w = b["q"] * (AXIS**2 - axis**2) / axis**2
            big = 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768))
            small = w / 1024 * (256 + w * (w * (74 - 47 * w) - 128))
            m = middle(b)
            shift = small * b["s"] * (m + small / 4 * (b["c"] * (2 * m * m - 1) - small / 6 * m * (4 * b["s"] * b["s"] - 3) * (4 * m * m - 3)))
            return axis * big * (b["arc"] - shift)

        return _let(last, lambda e: F.when(F.abs(e["x"] - e["was"]) < 1e-11, _let(arc(e["x"]), length)))

    return _let(place, along)


#: Sensors up to which a scan of all of them is cheaper than cells.
FEW_SENSORS = 64
#: Most sensors of a cell of the finest grid, and the finest grid's level (cells of 2 / 2 ** level radii, 3 m).
CELL_SENSORS, FINEST = 16, 22


def nearest_sensor(points: DataFrame, sensors: DataFrame, key: str, most_sensors: int | None = None) -> DataFrame:
    """(key, sensor) for each point (key, lon, lat): the sensor (sensor, lon, lat, ord) at the least distance, among
    equals the one of least ord. Points and sensors without a place get and give none.

    Up to FEW_SENSORS travel to the points as one array in a broadcast row; more are searched by nearest_by_grid(). With
    `most_sensors` a larger number of sensors is an error.
    """
    if most_sensors is not None and (n := sensors.count()) > most_sensors:
        raise ValueError(f"{n} sensors, where {most_sensors} are the most")
    few = sensors.select("ord", "sensor", "lon", "lat").filter("lon is not null and lat is not null").limit(FEW_SENSORS + 1).collect()
    if len(few) > FEW_SENSORS:
        return nearest_by_grid(points, sensors, key)
    here = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, "lon", "lat").distinct()
    if not few:
        return here.select(key, F.lit(None).cast(sensors.schema["sensor"].dataType).alias("sensor")).limit(0)
    one = sensors.agg(F.sort_array(F.collect_list(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("ord", "sensor", F.col("lon").alias("x"), F.col("lat").alias("y"))))).alias("all"))
    near = F.transform("all", lambda s: F.struct(distance(F.col("lon"), F.col("lat"), s["x"], s["y"]).alias("d"), s["ord"].alias("ord"), s["sensor"].alias("sensor")))
    return here.crossJoin(F.broadcast(one)).select(key, F.array_min(near)["sensor"].alias("sensor"))


def _on_sphere(df: DataFrame) -> DataFrame:
    """df with the place of lon and lat on the unit sphere: px, py, pz."""
    lon, lat = F.radians("lon"), F.radians("lat")
    return df.withColumns({"px": F.cos(lat) * F.cos(lon), "py": F.cos(lat) * F.sin(lon), "pz": F.sin(lat)})


def _cell(axis: str, level: int) -> Column:
    """Number of the cell that a coordinate is in; cells are cubes, halved in width with each level."""
    return F.floor((F.col(axis) + 1) * 2.0 ** (level - 1))


def _level(places: DataFrame) -> int:
    """The coarsest level whose cells have CELL_SENSORS at most, or the finest one."""
    low, high = 2, FINEST
    while low < high:
        level = (low + high) // 2
        most = places.groupBy(*(_cell(a, level) for a in ("px", "py", "pz"))).count().agg(F.max("count")).first()[0]
        low, high = (level + 1, high) if (most or 0) > CELL_SENSORS else (low, level)
    return low


def nearest_by_grid(points: DataFrame, sensors: DataFrame, key: str) -> DataFrame:
    """nearest_sensor() for any number of sensors: each place that is asked for meets, once, the sensors of its cell and of
    the 26 around it, on a grid of cubes over the unit sphere so fine that a cell has CELL_SENSORS at most. A place is done
    once its nearest sensor is nearer than anything outside those cells can be; the others go on with cells four times
    as wide. Both sides meet by an equal join on cells. What is left at four cells an axis (places with no sensor within
    a quarter of the globe or so) looks at all sensors.

    A sensor outside the cells is at least as far, in a straight line, as the nearest of their faces. Cubes have no poles
    and no date line, so a place there is done as soon as any other.
    """
    sphere = _on_sphere(sensors.select("ord", "sensor", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).filter("lon is not null and lat is not null"))
    places = stored(sphere, "places")
    level = _level(places)
    here = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).distinct()
    left = stored(_on_sphere(here.select("lon", "lat").distinct()), "asked")
    there = places.select("ord", "sensor", F.col("lon").alias("x"), F.col("lat").alias("y"), "px", "py", "pz")
    cells, done = ["cx", "cy", "cz"], None
    while True:
        if whole := level <= 2:
            found = left.crossJoin(there.drop("px", "py", "pz"))
        else:
            around = left.select("lon", "lat", *(F.array(*(_cell(a, level) + i for i in (-1, 0, 1))).alias(c) for a, c in zip(("px", "py", "pz"), cells, strict=True)))
            for c in cells:
                around = around.withColumn(c, F.explode(c))
            found = around.join(there.select("ord", "sensor", "x", "y", *(_cell(a, level).alias(c) for a, c in zip(("px", "py", "pz"), cells, strict=True))), cells)
        best = found.groupBy("lon", "lat").agg(F.min(F.struct(distance(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")).alias("d"), "ord", "sensor")).alias("best"))
        if whole:
            sure = best.select("lon", "lat", "best.sensor")
            done = sure if done is None else done.unionByName(sure)
            return here.join(done, ["lon", "lat"]).select(key, "sensor")
        size = 2.0 ** (1 - level)
        inside = [F.pmod(F.col(a) + 1, F.lit(size)) for a in ("px", "py", "pz")]
        reach = 2 * EARTH_RADIUS * F.asin((F.least(*inside, *(size - i for i in inside)) + size) / 2)
        judged = stored(left.join(best, ["lon", "lat"], "left").withColumn("done", F.coalesce(F.col("best.d") < reach * (1 - 1e-6), F.lit(False))), "nearest")
        sure = judged.filter("done").select("lon", "lat", "best.sensor")
        done = sure if done is None else done.unionByName(sure)
        left = judged.filter(~F.col("done")).select(*left.columns)
        if left.isEmpty():
            return here.join(done, ["lon", "lat"]).select(key, "sensor")
        level = max(2, level - 2)
