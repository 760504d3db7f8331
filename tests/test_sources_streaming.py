"""Ingestion from files and incremental evaluation."""

import datetime as dt
import json

import os

import pytest
from pyspark.sql import functions as F

from rulefold.operators.relation import Relation
from rulefold.sources import ingest
from rulefold.streaming.incremental import SnapshotQuery, stateful_filter, stateful_join

SCHEMA = "k string, seq bigint, op string, v bigint"
LOG = [("A", 1, "U", 10), ("B", 2, "U", 5), ("A", 3, "U", 11), ("C", 4, "U", 7), ("B", 5, "D", None), ("C", 6, "U", 3), ("A", 7, "U", 2)]


def batches(tmp_path, spark, rows, name="in"):
    """A file stream that gives one file a batch."""
    folder = tmp_path / name
    folder.mkdir()
    for i in range(0, len(rows), 3):
        file = folder / f"{i:03d}.json"
        file.write_text("\n".join(json.dumps(dict(zip(("k", "seq", "op", "v"), r, strict=True))) for r in rows[i : i + 3]))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def folded(df):
    return {r["k"]: r["v"] for r in Relation.from_changelog(df, ["k"], ["seq"]).df.collect()}


def test_snapshots_agree_with_the_batch_result(spark, tmp_path):
    query = SnapshotQuery(str(tmp_path / "out"), ["k"], ["seq"], lambda r: r.map(v=F.col("v")).filter(F.col("v") <= 10))
    query.start(batches(tmp_path, spark, LOG), str(tmp_path / "cp")).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "out/derived").iterdir())
    assert {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/out/derived/{last}").collect()} == {"A": 2, "C": 3}
    state = {}
    for i in range(last + 1):
        for r in spark.read.parquet(f"{tmp_path}/out/changes/{i}").collect():
            if r.op == "U":
                state[r.k] = r.v
            else:
                del state[r.k]
    assert state == {"A": 2, "C": 3}
    query.process(spark.createDataFrame([], SCHEMA), last)  # the same batch again, with nothing new
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/out/derived/{last}").collect()} <= {"A", "B", "C"}


def test_stateful_filter_deletes_what_stops_matching(spark, tmp_path):
    stream = stateful_filter(batches(tmp_path, spark, LOG), ["k"], F.col("v") <= 10)
    q = stream.writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("filtered")
    assert folded(got) == {"A": 2, "C": 3}
    assert [(r.op, r.v) for r in got.filter("k = 'A'").orderBy("seq").collect()] == [("U", 10), ("D", 11), ("U", 2)]


@pytest.mark.parametrize("outer", [False, True])
def test_stateful_join_agrees_with_the_batch_join(spark, tmp_path, outer):
    big = 2**53 + 1
    left = [*LOG, ("D", 1, "U", big), ("E", 1, "U", 7)]
    right = [("A", 1, "U", 1), ("C", 2, "U", 3), ("A", 8, "D", None), ("B", 9, "U", 4), ("D", 3, "U", big + 2), ("F", 1, "U", None)]
    a = batches(tmp_path, spark, left, "l").withColumnRenamed("v", "a")
    b = batches(tmp_path, spark, right, "r").withColumnRenamed("v", "b")
    name = f"joined_{outer}".lower()
    q = stateful_join(a, b, "k", outer=outer).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    # sides arrive in batches of their own: the last row of each key is its state
    rows = Relation.from_changelog(spark.table(name).withColumn("n", F.monotonically_increasing_id()), ["k"], ["n"]).df.collect()
    sides = [Relation.from_changelog(spark.createDataFrame(log, SCHEMA), ["k"], ["seq"]) for log in (left, right)]
    sides = [r.map(**{n: F.col("v")}) for r, n in zip(sides, "ab", strict=True)]
    want = (sides[0].outer_join(sides[1]) if outer else sides[0].join(sides[1])).df.collect()
    assert {r.k: (r.a, r.b) for r in rows} == {r.k: (r.a, r.b) for r in want}
    assert {r.k: (r.a, r.b) for r in rows}["D"] == (big, big + 2)
    with pytest.raises(ValueError):
        stateful_join(a, a, "k")


def test_observations(spark, tmp_path):
    def feature(name, kind="Point", coordinates=(4.0, 52.0)):
        return {"id": name, "location": name, "geometry": {"type": kind, "coordinates": list(coordinates), "spatialReference": {"wkid": "4326"}}}

    def result(time, **values):
        return {"phenomenonTime": time, "parameters": [{"name": k, "value": v} for k, v in values.items()]}

    body = {"_embedded": {"observations": [
        {"featureOfInterest": feature("s1"), "result": [result("2024-01-01T00:00:00Z", H10=120.0, HW=200.0, LW=-50.0, XX=1.0)]},
        {"featureOfInterest": feature("s2"), "result": [result("2024-01-01T00:00:00Z", PH10=80.0)]},
        {"featureOfInterest": feature("s3", "Line"), "result": [result("2024-01-01T00:00:00Z", H10=1.0)]},
    ]}}
    (tmp_path / "o.json").write_text(json.dumps(body))
    rows = ingest.read_observations(spark, str(tmp_path / "o.json"))
    assert sorted((r.sensor, r.measure, round(r.value, 3)) for r in rows.collect()) == [("s1", "tide.height", 1.2), ("s1", "tide.high_water", 2.0), ("s1", "tide.low_water", -0.5), ("s2", "tide.height", 0.8)]
    whole = ingest.publish(rows, ["tide.height", "tide.high_water", "tide.low_water"]).df.collect()
    assert [r.sensor for r in whole] == ["s1"] and whole[0].height[0].value == 1.2


def test_visits_lookups_and_berths(spark):
    now = dt.datetime(2024, 1, 5)
    day = lambda n: dt.datetime(2024, 1, n)
    ship = ("n", "1", 20.0, 100.0, "c")
    visits = [
        ("e", "past in, later in", "NLRTM", ship, [(day(1), day(2), True, False, ["a"]), (day(6), day(7), True, True, ["b", "c"])]),
        ("e", "out", "NLRTM", ship, [(day(1), day(2), True, True, ["d"])]),
        ("e", "none", "NLRTM", ship, [(day(1), day(2), True, False, ["d"])]),
        ("e", "port", "BEANR", ship, [(day(6), day(7), True, False, ["d"])]),
        ("e", "no mmsi", "NLRTM", ("n", None, 20.0, 100.0, "c"), [(day(6), day(7), True, False, ["d"])]),
    ]
    got = ingest.classify_visits(spark.createDataFrame(visits, ingest.VISIT), F.lit(now)).collect()
    assert sorted((r.id, r.direction, r.place) for r in got) == [("out", "Outbound", "d"), ("past in, later in", "Inbound", "b"), ("past in, later in", "Inbound", "c")]
    vessels = spark.createDataFrame([("1", day(6)), ("2", day(4))], "mmsi string, time timestamp")
    answers = spark.createDataFrame([("1", "X", 7.0, 1), ("1", "X", 8.0, 2), ("3", "Y", 1.0, 1)], ingest.AIS)
    assert [(r.mmsi, r.draught) for r in ingest.with_draught(vessels, answers).collect()] == [("1", 8.0)]
    assert [r.mmsi for r in ingest.active(Relation(vessels, ("mmsi",)), F.lit(now)).df.collect()] == ["1"]
    messages = [('{"urn":"u","type":"Berth","length":1}', 1), ('{"urn":"u","type":"Berth","length":2}', 2), ('{"urn":"w","type":"Buoy"}', 3), ("{", 4)]
    got = ingest.berths(spark.createDataFrame(messages, "value string, seq int"), "urn string, type string, length double").df.collect()
    assert [(r.urn, r.length) for r in got] == [("u", 2.0)]
    assert ingest.kafka_options("h:1", "t", "earliest", {"keystore.location": "f"})["kafka.ssl.keystore.location"] == "f"
