"""Projections against published coordinates."""

import pytest
from pyspark.sql import functions as F

from rulefold.functions import projection as P


def one(spark, place):
    r = spark.range(1).select(place.alias("p")).first().p
    return r and (r.lon, r.lat)


def test_published_places(spark):
    airy = P.Ellipsoid(6_377_563.396, 1 / 299.3249646)
    grid = P.from_transverse_mercator(F.lit(577274.99), F.lit(69740.50), airy, -2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0)
    assert one(spark, grid) == pytest.approx((0.5, 50.5), abs=2e-7)  # a centimetre or two
    stereographic = P.from_oblique_stereographic(F.lit(196105.283), F.lit(557057.739), P.BESSEL, 5 + 23 / 60 + 15.5 / 3600, 52 + 9 / 60 + 22.178 / 3600, 0.9999079, 155_000.0, 463_000.0)
    assert one(spark, stereographic) == pytest.approx((6.0, 53.0), abs=2e-8)


@pytest.mark.parametrize(
    ("x", "y", "code", "lon", "lat", "near"),
    [
        (155_000.0, 463_000.0, "28992", 5 + 23 / 60 + 13.93 / 3600, 52 + 9 / 60 + 18.62 / 3600, 3e-6), (500_000.0, 0.0, "32631", 3.0, 0.0, 1e-12), (166021.443, 0.0, "32631", 0.0, 0.0, 1e-8), (500_000.0, 10_000_000.0, "32731", 3.0, 0.0, 1e-12),
        (500_000.0, 4982950.400, "25831", 3.0, 45.0, 1e-8), (20037508.342789244, 0.0, "3857", 180.0, 0.0, 1e-9), (4.0, 52.0, "4326", 4.0, 52.0, 0),
    ],
)
def test_codes(spark, x, y, code, lon, lat, near):
    assert one(spark, P.to_lonlat(F.lit(x), F.lit(y), F.lit(code))) == pytest.approx((lon, lat), abs=near)


def test_unknown_codes_and_missing_coordinates_have_none(spark):
    rows = spark.createDataFrame([(1.0, 2.0, "9999"), (1.0, 2.0, None), (None, 2.0, "4326"), (1.0, 2.0, "32600"), (1.0, 2.0, "x")], "x double, y double, c string")
    assert [r.p for r in rows.select(P.to_lonlat(F.col("x"), F.col("y"), F.col("c")).alias("p")).collect()] == [None] * 5
