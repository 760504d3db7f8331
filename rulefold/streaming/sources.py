"""What arrives by requests: refreshes of sensor series, and identities that are looked up in batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rulefold.streaming.keyed import VERSION, packed, unpacked, version


class _Refresh(StatefulProcessor):
    """By sensor: the series of its last complete refresh."""

    def __init__(self, measures: Sequence[str]) -> None:
        self.measures = list(measures)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "version string, own string")

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        polls: dict[str, dict[str, dict[int, float]]] = {}
        for r in rows:
            points = polls.setdefault(r.version, {}).setdefault(r.measure, {})
            points[r.micros] = max(r.value, points.get(r.micros, r.value))
        last, own = self.held.get() or (None, None)
        for poll in sorted(polls):
            found = polls[poll]
            if last is not None and poll < last or any(m not in found for m in self.measures):
                continue
            made = json.dumps({m: [{"time": t, "value": v} for t, v in sorted(found[m].items())] for m in self.measures})
            if made != own:
                yield Row(k=key[0], version=poll, own=made)
            last, own = poll, made
        if last is not None:
            self.held.update((last, own))

    def close(self) -> None:
        pass


def refreshes(readings: DataFrame, measures: Sequence[str], poll: Sequence[str] = ("poll",), sensor: str = "sensor") -> DataFrame:
    """The changelog of sensors and their series from a stream of readings (sensor, measure, time, value, poll columns):
    sensor, op, version, an array of (time, value) in time order for each measure, named as what follows its last dot.

    A poll whose readings of a sensor lack one of the measures changes nothing for it, nor does one with the series it
    has already; each other poll gives one upsert. Sensors are never deleted. Readings of one poll and sensor come in
    one micro-batch (they are one file); of two of a measure and time the larger value counts; null times and values go.
    """
    wanted = readings.filter(F.col("measure").isin(list(measures)) & F.col("time").isNotNull() & F.col("value").isNotNull())
    rows = wanted.select(packed([F.col(sensor)]).alias("k"), version(readings, poll).alias(VERSION), "measure", F.unix_micros(F.col("time").cast("timestamp")).alias("micros"), F.col("value").cast("double").alias("value"))
    made = rows.groupBy("k").transformWithState(_Refresh(measures), "k string, version string, own string", "Append", "None")
    point = T._parse_datatype_string("array<struct<time: bigint, value: double>>")
    out = made.select(*unpacked("k", [readings.schema[sensor]]), F.lit("U").alias("op"), VERSION, *unpacked("own", [T.StructField(m, point) for m in measures]))
    series = lambda m: F.transform(F.col(f"`{m}`"), lambda p: F.struct(F.timestamp_micros(p["time"]).alias("time"), p["value"].alias("value")))
    return out.select(sensor, "op", VERSION, *(series(m).alias(m.rsplit(".", 1)[-1]) for m in measures))


#: (ids) -> answers by id; an id that has none is left out. Runs on executors.
Lookup = Callable[[list[str]], dict[str, dict]]


class _Batches(StatefulProcessor):
    """By shard: elements that wait for the next request."""

    def __init__(self, lookup: Lookup, every: int, most: int, tries: int) -> None:
        self.lookup, self.every, self.most, self.tries = lookup, every, most, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string, own string, failed int")
        self.armed = handle.getValueState("armed", "ms bigint")

    def _arm(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.armed.update((ms,))

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        new = []
        for r in rows:
            if r.id is None:
                yield Row(own=r.own, answer=None, fault="no id")
            else:
                new.append((r.id, r.own, 0))
        if new:
            self.waiting.appendList(new)
            if self.armed.get() is None:
                self._arm(timer.getCurrentProcessingTimeInMs() + self.every)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        rows = [tuple(r) for r in self.waiting.get()]
        ids = list(dict.fromkeys(r[0] for r in rows))[: self.most]
        asked = set(ids)
        rest = [r for r in rows if r[0] not in asked]
        try:
            answers = self.lookup(ids)
        except Exception as e:
            for i, own, failed in rows:
                if i in asked and failed + 1 >= self.tries:
                    yield Row(own=own, answer=None, fault=f"{type(e).__name__}: {e}")
                elif i in asked:
                    rest.append((i, own, failed + 1))
        else:
            for i, own, _ in rows:
                if i in asked:
                    there = answers.get(i) is not None
                    yield Row(own=own, answer=json.dumps(answers[i]) if there else None, fault=None if there else "no answer")
        if rest:
            self.waiting.put(rest)
            self._arm(timerValues.getCurrentProcessingTimeInMs() + self.every)
        else:
            self.waiting.clear()
            self.armed.clear()

    def close(self) -> None:
        pass


def looked_up(elements: DataFrame, key: str, lookup: Lookup, answer: str, every: int = 1500, most: int = 500, tries: int = 3, shards: int = 1) -> DataFrame:
    """Elements of a stream with what a lookup service answers for their key: their columns, the columns of `answer` (a
    schema of what a JSON object can hold), and `fault` (null, or why there is no answer).

    Elements wait up to `every` milliseconds and go out in one request of at most `most` distinct keys; a shard has one
    request in flight. Answers are matched by key, never by place. A request that fails is made again with the next ones;
    after `tries` failures its elements come out with the error as fault. Elements survive a restart, and a request may
    be made again after one. Null keys come out with a fault at once.
    """
    fields = T._parse_datatype_string(answer).fields
    own = elements.schema.fields
    taken = {f.name.lower() for f in own} | {"fault"}
    if both := taken & {f.name.lower() for f in fields} or taken & {"fault"} & {f.name.lower() for f in own}:
        raise ValueError(f"elements have {sorted(both)}")
    name = F.col(f"`{key}`").cast("string")
    rows = elements.select(F.pmod(F.xxhash64(name), F.lit(shards)).cast("int").alias("shard"), name.alias("id"), packed([F.col(f"`{f.name}`") for f in own]).alias("own"))
    made = rows.groupBy("shard").transformWithState(_Batches(lookup, every, most, tries), "own string, answer string, fault string", "Append", "ProcessingTime")
    return made.select(*unpacked("own", own), *unpacked("answer", fields), "fault")
