"""The grid search for sensors against a scan of all of them: poles, the date line, ties, crowds, one place with many."""

import math
import random

import pytest

from pyspark.sql import functions as F

from rulefold.functions import location as L

POINTS, SENSORS = "id bigint, lon double, lat double", "sensor string, ord bigint, lon double, lat double"


def far(a, b):
    half_lat, half_lon = math.radians(b[1] - a[1]) / 2, math.radians(b[0] - a[0]) / 2
    return math.asin(min(1, math.sqrt(math.sin(half_lat) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(half_lon) ** 2)))


@pytest.mark.parametrize("crowd", [0, 120])
def test_grid_agrees_with_a_scan(spark, crowd):
    rng = random.Random(9)
    world = lambda: (rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1))))
    port = lambda: (4 + rng.gauss(0, 0.05), 52 + rng.gauss(0, 0.03))
    edges = [(179.99, 10.0), (-179.99, -10.0), (0.0, 89.9), (90.0, -89.9), (180.0, 0.0), (-180.0, 0.0)]
    places = [world() for _ in range(40)] + [port() for _ in range(150)] + edges + [(4.0, 52.0)] * crowd
    asked = [world() for _ in range(60)] + [port() for _ in range(60)] + [(-180.0, 9.0), (180.0, -9.0), (12.0, 90.0), (-12.0, -90.0), (170.0, 89.0), (4.0, 52.0)]
    sensors = spark.createDataFrame([*((f"s{i}", i, x, y) for i, (x, y) in enumerate(places)), ("none", -1, None, 1.0)], SENSORS)
    points = spark.createDataFrame([*((i, x, y) for i, (x, y) in enumerate(asked)), (999, None, 2.0)], POINTS)
    got = {r.id: int(r.sensor[1:]) for r in L.nearest_by_grid(points, sensors, "id").collect()}
    assert sorted(got) == list(range(len(asked)))
    for i, a in enumerate(asked):
        best = min(far(a, b) for b in places)
        assert far(a, places[got[i]]) <= best + 1e-12
    assert got[len(asked) - 1] == (196 if crowd else got[len(asked) - 1])  # the first of those that stand in one place
    assert {r.id: int(r.sensor[1:]) for r in L.nearest_sensor(points, sensors, "id").collect()} == got


def test_poles_are_no_scan_of_all(spark, monkeypatch):
    """Places at and near the poles are done by cells, and one place that many points share is searched once."""
    rng = random.Random(5)
    places = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(600)]
    asked = [(x, y) for y in (90.0, -90.0, 89.5, -89.5) for x in (-180.0, 0.0, 77.0)]
    sensors = spark.createDataFrame([(f"s{i}", i, x, y) for i, (x, y) in enumerate(places)], SENSORS)
    points = spark.createDataFrame([(i, *asked[i % len(asked)]) for i in range(10 * len(asked))], POINTS)
    kept, store = {}, L.stored

    def seen(df, name):
        kept.setdefault(name, []).append(made := store(df, name))
        return made

    monkeypatch.setattr(L, "stored", seen)
    got = {r.id: int(r.sensor[1:]) for r in L.nearest_by_grid(points, sensors, "id").collect()}
    assert sorted(got) == list(range(10 * len(asked)))
    assert all(far(asked[i % len(asked)], places[n]) <= min(far(asked[i % len(asked)], b) for b in places) + 1e-12 for i, n in got.items())
    assert kept["nearest"][0].count() == len(asked)
    assert kept["nearest"][-1].filter("not done").isEmpty()  # so none was left for the scan


def test_few_or_no_sensors(spark):
    points = spark.createDataFrame([(1, 4.0, 52.0)], POINTS)
    assert L.nearest_sensor(points, spark.createDataFrame([("a", 1, None, 2.0)], SENSORS), "id").count() == 0
    assert [r.sensor for r in L.nearest_sensor(points, spark.createDataFrame([("a", 2, 4.0, 52.5), ("b", 1, 4.0, 51.5), ("c", 0, None, 52.0)], SENSORS), "id").collect()] in (["a"], ["b"])
    assert L.nearest_by_grid(points.limit(0), spark.createDataFrame([], SENSORS), "id").count() == 0


def test_geodesics_have_published_lengths(spark):
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    rows = [
        # Flinders Peak to Buninyong, as published with the inverse formula
        (1, dms(144, 25, 29.52440), dms(-37, 57, 3.72030), dms(143, 55, 35.38390), dms(-37, 39, 10.15610)),
        (2, 0.0, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0, 90.0), (4, 5.0, 52.0, 5.0, 52.0), (5, 0.0, 0.0, 180.0, 0.0), (6, None, 1.0, 2.0, 3.0), (7, 179.5, 10.0, -179.5, 10.0),
    ]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    got = {r.id: r.m for r in df.select("id", L.geodesic(*(F.col(c) for c in "abcd")).alias("m")).collect()}
    assert got[1] == pytest.approx(54972.271, abs=0.001)
    assert got[2] == pytest.approx(L.AXIS * math.pi / 180, abs=0.001)  # along the equator
    assert got[3] == pytest.approx(10_001_965.729, abs=0.001)  # the quarter meridian
    assert got[4] == 0 and got[5] is None and got[6] is None
    assert got[7] == pytest.approx(109639.35, abs=1)
