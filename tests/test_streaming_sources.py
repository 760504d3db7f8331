"""Refreshes from polled files and batched lookups: restarts, incomplete and unchanged refreshes, failing requests."""

import datetime as dt
import json
import time

import pytest

from rulefold.sources import ingest
from rulefold.streaming import sources
from tests.test_keyed_streaming import at, feed, file_stream, folded, run

pytestmark = pytest.mark.usefixtures("small_state")

WIND = ["wind.velocity", "wind.direction"]


def response(folder, name, sensors):
    def one(sensor, code, points):
        place = {"id": sensor, "location": sensor, "geometry": {"type": "Point", "coordinates": [4.0, 52.0]}}
        return {"featureOfInterest": place, "result": [{"phenomenonTime": f"2024-01-01T00:{m:02d}:00Z", "parameters": [{"name": code, "value": v}]} for m, v in points]}

    folder.mkdir(exist_ok=True)
    body = {"_embedded": {"observations": [one(*s) for s in sensors]}}
    (folder / f".{name}").write_text(json.dumps(body))
    (folder / f".{name}").rename(folder / name)


def test_a_refresh_is_one_upsert_a_sensor_if_complete_and_new(spark, tmp_path):
    polls = [
        ("p1.json", [("a", "WV10", [(0, 1.5), (10, 2.0)]), ("a", "WD10", [(0, 90.0)]), ("b", "WV10", [(0, 3.0)])]),
        ("p2.json", [("a", "WD10", [(0, 90.0)]), ("a", "WV10", [(10, 2.0), (0, 1.5)]), ("b", "WV10", [(0, 3.0)]), ("b", "WD10", [(5, 10.0), (5, 20.0)])]),
        ("p3.json", [("a", "WV10", [(20, 9.0)]), ("b", "WD10", [(5, 11.0)])]),
        ("p4.json", [("a", "WV10", [(20, 9.0)]), ("a", "WD10", [(20, 0.1)]), ("a", "XX", [(20, 0.1)])]),
    ]
    seen = []
    for name, sensors in polls:
        response(tmp_path / "polls", name, sensors)
        stream = sources.refreshes(ingest.poll_responses(spark, str(tmp_path / "polls")), WIND)
        got = run(stream, tmp_path, "out")  # each poll goes on from the checkpoint, no file is read twice
        seen.append(sorted(r.sensor for r in got.collect()))
    assert seen == [["a"], ["a", "b"], ["a", "b"], ["a", "a", "b"]]
    rows = {r.sensor: r for r in folded(got, ["sensor"]).collect()}
    minute = lambda m: dt.datetime(2024, 1, 1, 0, m)
    assert [tuple(p) for p in rows["a"].velocity] == [(minute(20), 9.0)] and [tuple(p) for p in rows["a"].direction] == [(minute(20), 0.1)]
    assert [tuple(p) for p in rows["b"].velocity] == [(minute(0), 3.0)] and [tuple(p) for p in rows["b"].direction] == [(minute(5), 20.0)]
    assert [len(r.velocity) for r in got.orderBy("version").collect()] == [2, 1, 1]


def test_publish_latest_is_one_row_a_sensor_bounded_by_the_horizon(spark):
    rows = [("a", m, at(3600 * h), float(h)) for h in range(100) for m in WIND] + [("b", "wind.velocity", at(0), 1.0), ("c", "wind.velocity", at(0), 1.0), ("c", "wind.direction", at(10**6), 1.0), (None, "x", None, 0.0)]
    got = ingest.publish_latest(spark.createDataFrame(rows, "sensor string, measure string, time timestamp, value double"), WIND, "10 hours").df.collect()
    assert [r.sensor for r in got] == ["a"] and [p.value for p in got[0].velocity] == [float(h) for h in range(90, 100)] == [p.value for p in got[0].direction]


def flaky(folder):
    """Fails at its first request, knows even ids, and notes each request in a file."""

    def lookup(ids):
        n = len(list(folder.iterdir()))
        (folder / f"{n:04d}").write_text(json.dumps(ids))
        if n == 0:
            raise ConnectionError("down")
        return {i: {"draught": int(i) + 0.5, "mmsi": f"m{i}"} for i in reversed(ids) if int(i) % 2 == 0}

    return lookup


@pytest.mark.parametrize("tries", [1, 3])
def test_lookups_in_batches_survive_a_failure(spark, tmp_path, tries):
    requests = tmp_path / "requests"
    requests.mkdir()
    schema = "visit bigint, ship bigint"
    feed(spark, tmp_path / "in", [(1, 4), (2, 3), (3, 4), (4, None), (5, 6)], schema)
    stream = sources.looked_up(file_stream(spark, tmp_path / "in", schema), "ship", flaky(requests), "draught double, mmsi string", every=200, most=3, tries=tries)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        fed = False
        while time.time() < until:
            got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")) if (tmp_path / "out/_spark_metadata").exists() else None
            n = got.count() if got is not None else 0
            if n >= 5 and not fed:
                feed(spark, tmp_path / "in", [(10 + i, 10 + i) for i in range(7)], schema)
                fed = True
            if n >= 12:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    rows = {r.visit: r for r in got.collect()}
    assert len(rows) == 12 == got.count()
    assert rows[4].fault == "no id"
    if tries == 1:  # quarantined
        assert {rows[v].fault for v in (1, 2, 3, 5)} == {"ConnectionError: down"}
    else:
        assert [(rows[v].draught, rows[v].mmsi, rows[v].fault) for v in (1, 3, 5, 2)] == [(4.5, "m4", None)] * 2 + [(6.5, "m6", None), (None, None, "no answer")]
    assert all((rows[10 + i].draught == 10.5 + i) == (i % 2 == 0) for i in range(7))
    asked = [json.loads(p.read_text()) for p in sorted(requests.iterdir())]
    assert max(map(len, asked)) == 3 and all(len(set(a)) == len(a) for a in asked)
    with pytest.raises(ValueError):
        sources.looked_up(file_stream(spark, tmp_path / "in", schema), "ship", flaky(requests), "visit bigint")


