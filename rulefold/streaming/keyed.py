"""Operators with keyed state over streams of changes, as chains of transformWithState steps.

A change has key columns, `op` ('U' or 'D'), order columns and values. Inside the operators keys and values travel as
JSON text and the order as `version`, text that sorts as the order columns do, so state holds text (in places compressed) and whole numbers
alone and every type comes back as it was. What the operators return is a changelog of the same form with the column
`version`, which orders it and may be the order of a next operator; folded by it, a result equals the batch operator's
on the folded inputs at the end of each micro-batch. Changes of a key that are older than the last one seen are ignored,
of several in one micro-batch the last one counts.

State is held in RocksDB (`with_rocksdb` sets that for a session) and written as changes of each micro-batch. Each access
to it from Python is a message to the JVM, of which a task makes about a thousand a second. So joins by foreign keys and
differences hold the rows of many keys in one bucket, which is read and written at once: a batch reads the buckets that
it touches and writes the rows that it changes. Their rows go to Python and back, and to state, as texts with a line for
each: to convert a row by itself, or each element of a list, takes far longer. JSON text has no line breaks, nor have
versions.
"""

from __future__ import annotations

import functools
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERSION = "version"
#: Options that keep JSON text exact to the microsecond.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_LEAST_LONG = -(2**63)
#: Parts of a hot key that state is dealt to.
SHARDS = 8
#: Buckets of keys in joins by foreign keys and differences (a task holds the rows of one in memory at a time), and the
#: most rows of a text of state.
BUCKETS, PART_ROWS = 4096, 10_000
#: Lists by bucket of an Arrow batch.
LISTS = 512
#: Settings of a session that with_rocksdb makes. Else each of an executor's stores has 64 MB and more for what it writes,
#: and an Arrow batch has 10,000 texts of many rows each.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
#: What state holds in place of the values of a row that has gone; no JSON text.
GONE = "-"
#: Bytes of changes that a task puts into lists by bucket at a time.
GATHERED = 1 << 25


def with_rocksdb(spark: SparkSession) -> None:
    """Let the session keep state in RocksDB, within bounds of memory, and write it to checkpoints as changes."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def packed(columns: Sequence[Column]) -> Column:
    """Columns as one text (of any type that JSON can hold: no maps with other keys than text)."""
    return F.to_json(F.struct(*columns), _EXACT) if columns else F.lit("{}")


def unpacked(text: str, fields: Sequence[T.StructField]) -> list[Column]:
    """The columns that packed() put into a text column."""
    made = F.from_json(text, T.StructType([T.StructField(f.name, f.dataType) for f in fields]), _EXACT)
    return [made[f.name].alias(f.name) for f in fields]


def version(df: DataFrame, order: Sequence[str]) -> Column:
    """Text that sorts as the order columns do, none first: whole numbers, times (to the microsecond), or versions."""
    parts = []
    for c in order:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            parts.append(F.coalesce(F.col(c), F.lit("")))
            continue
        whole = F.unix_micros(F.col(c).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(c).cast("bigint")
        parts.append(F.coalesce(F.lpad(F.hex(whole.bitwiseXOR(F.lit(_LEAST_LONG))), 16, "0"), F.lit("0" * 16)))
    return F.concat(*parts)


def _fields(df: DataFrame, *without: str) -> list[T.StructField]:
    gone = {c.lower() for c in without}
    return [f for f in df.schema.fields if f.name.lower() not in gone]


def _columns(fields: Sequence[T.StructField]) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in fields]


def _apart(a: Sequence[T.StructField], b: Sequence[T.StructField]) -> None:
    if both := {f.name.lower() for f in a} & {f.name.lower() for f in b}:
        raise ValueError(f"both sides have {sorted(both)}")


def _last(rows: Iterator[Row]) -> Row | None:
    best = None
    for r in rows:
        if best is None or (r.version, r.op) >= (best.version, best.op):
            best = r
    return best


def _bucket(buckets: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias("bucket")


def _listed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    bucket = table["bucket"].to_numpy()
    at = np.argsort(bucket.astype(np.min_scalar_type(bucket.max())), kind="stable")  # small numbers are sorted by radix
    bucket = bucket[at]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = pa.array(np.append(first, len(bucket)), pa.int32())
    columns = [pa.array(bucket[first]) if c == "bucket" else pa.ListArray.from_arrays(ends, table[c].combine_chunks().take(at)) for c in table.column_names]
    yield pa.RecordBatch.from_arrays(columns, names=table.column_names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of what is read, with a list for each column."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= GATHERED:
            yield from _listed(held)
            held, size = [], 0
    if held:
        yield from _listed(held)


def _in_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _gathered, of text without nulls, with a text for each list."""
    for b in _gathered(batches):
        for i in range(0, b.num_rows, LISTS):
            part = b.slice(i, LISTS)
            yield pa.RecordBatch.from_arrays([c if n == "bucket" else pc.binary_join(c, "\n") for n, c in zip(b.schema.names, part.columns, strict=True)], names=b.schema.names)


def _joined(values: Sequence[str | None]) -> str:
    return "\n".join([v or "" for v in values])


def _split(text: str) -> list[str | None]:
    return [v or None for v in text.split("\n")]


@functools.cache
def _change(names: tuple[str, ...]) -> type:
    return namedtuple("Change", names)


class _ByBucket(StatefulProcessor):
    """Changes of a bucket come and go as lists; `changed` maps rows to tuples of the columns OUT."""

    OUT = ("k", "op", "version", "own")

    def changed(self, rows: Iterator) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        made = list(self.changed(self._each(rows)))
        for i in range(0, len(made), PART_ROWS):
            yield Row(**dict(zip(self.OUT, map(list, zip(*made[i : i + PART_ROWS], strict=True)), strict=True)))

    @staticmethod
    def _each(rows: Iterator[Row]) -> Iterator:
        for r in rows:
            names = tuple(c for c in r.__fields__ if c != "bucket")
            yield from map(_change(names)._make, zip(*(r[c] for c in names), strict=True))

    def close(self) -> None:
        pass


class _Lines(StatefulProcessor):
    """A processor of lists, which come and go as text with a line for each element; an empty line is null."""

    def __init__(self, processor: _ByBucket) -> None:
        self.processor = processor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.processor.init(handle)

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        lists = (Row(**{c: r[c] if c == "bucket" else _split(r[c]) for c in r.__fields__}) for r in rows)
        for made in self.processor.handleInputRows(key, lists, timer):
            yield Row(**{c: _joined(made[c]) for c in made.__fields__})

    def close(self) -> None:
        self.processor.close()


def _by_bucket(rows: DataFrame, processor: _ByBucket) -> DataFrame:
    """The columns OUT of a processor, over rows of text with a column `bucket`; no text is empty or has line breaks."""
    texts = rows.select(*(F.col(c) if c == "bucket" else F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns))
    made = texts.mapInArrow(_in_lines, texts.schema).groupBy("bucket").transformWithState(_Lines(processor), ", ".join(f"{c} string" for c in processor.OUT), "Append", "None")
    each = made.select(*(F.split(c, "\n").alias(c) for c in processor.OUT)).select(F.inline(F.arrays_zip(*processor.OUT)))
    return each.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in processor.OUT))


class _Held:
    """Rows of a bucket by key: version, whether it is there, and its text if it is. State has the changes of each
    micro-batch as compressed lines (keys, then versions, then texts) and their bytes, put together once most are
    outdated. A row of None is one that has gone."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.parts = handle.getListState(name, "bytes int, lines binary")

    def read(self) -> dict[str, tuple]:
        rows, self.written = {}, 0
        for size, lines in self.parts.get():
            found = pa.decompress(bytes(lines), size, "zstd", asbytes=True).decode().split("\n")
            n = len(found) // 3
            self.written += n
            rows.update(zip(found[:n], zip(found[n : 2 * n], found[2 * n :], strict=True), strict=True))
        return {k: (version, own != "", own or None) for k, (version, own) in rows.items() if own != GONE}

    @staticmethod
    def _part(items: list[tuple]) -> tuple[int, bytes]:
        lines = _joined([k for k, _ in items] + [r and r[0] for _, r in items] + [r[2] if r else GONE for _, r in items]).encode()
        return len(lines), pa.compress(lines, "zstd", asbytes=True)

    def write(self, changed: dict[str, tuple | None], rows: dict[str, tuple]) -> None:
        """Rows have the changes already."""
        if not changed:
            return
        outdated = self.written + len(changed) > 2 * len(rows) + 64
        items = list((rows if outdated else changed).items())
        parts = [self._part(items[i : i + PART_ROWS]) for i in range(0, len(items), PART_ROWS)]
        if not outdated:
            self.parts.appendList(parts)
        elif parts:
            self.parts.put(parts)
        else:
            self.parts.clear()


def _lasts(rows: Iterator) -> dict:
    """The last change of each k."""
    best = {}
    for r in rows:
        old = best.get(r.k)
        if old is None or (r.version, r.op) >= (old.version, old.op):
            best[r.k] = r
    return best


# Foreign keys


class _Moves(_ByBucket):
    """By left key: which foreign key its row has. A row that leaves one tells it: 'M' for a move, 'D' for a delete."""

    OUT = ("foreign", "k", "op", "version", "own")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = _Held(handle, "held")  # version, there, foreign

    def changed(self, rows: Iterator) -> Iterator[tuple]:
        held, changed = self.held.read(), {}
        for k, new in _lasts(rows).items():
            old = held.get(k)
            if old and new.version < old[0]:
                continue
            there = new.op == "U"
            foreign = new.foreign if there else None
            if old and old[1] and (not there or old[2] != foreign):
                yield old[2], k, "M" if there else "D", new.version, None
            if there:
                yield foreign, k, "U", new.version, new.own
            held[k] = changed[k] = (new.version, there, foreign)
        self.held.write(changed, held)


class _Foreign(_ByBucket):
    """By foreign key and shard: the row it names, and the rows that name it."""

    OUT = ("k", "op", "version", "own", "other")

    def __init__(self, outer: bool) -> None:
        self.outer = outer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.right = _Held(handle, "right")  # by foreign key: version, there, other
        self.left = _Held(handle, "left")  # by foreign key and k: version, True, own

    def changed(self, rows: Iterator) -> Iterator[tuple]:
        news: dict[str, dict] = {}
        for r in rows:
            of = news.setdefault(self._place(r.foreign, r.shard), {})
            old = of.get(r.k)
            if old is None or (r.version, r.op) >= (old.version, old.op):
                of[r.k] = r
        rights, lefts = self.right.read(), self.left.read()
        naming: dict[str, list[str]] = {place: [] for place, of in news.items() if None in of}
        if naming:
            for at in lefts:
                place, _, k = at.partition("\t")
                if place in naming:
                    naming[place].append(k)
        new_rights, new_lefts = {}, {}
        for place, of in news.items():
            right, changes = of.pop(None, None), of
            held = rights.get(place) or (None, False, None)
            was, changed = held[1], False
            if right is not None and (held[0] is None or right.version >= held[0]):
                before = held[1:]
                held = (right.version, right.op == "U", right.own if right.op == "U" else None)
                changed = held[1:] != before
                rights[place] = new_rights[place] = held
            now = held[1]
            for k, r in changes.items():
                at = f"{place}\t{k}"
                known = at in lefts
                if r.op == "U":
                    lefts[at] = new_lefts[at] = (r.version, True, r.own)
                    if now or self.outer:
                        yield self._out(k, "U", r.version + (held[0] or ""), r.own, held[2])
                    elif known and was:
                        yield self._out(k, "D", r.version + held[0])
                elif known:
                    del lefts[at]
                    new_lefts[at] = None
                    if r.op == "D" and (was or self.outer) or r.op == "M" and was and not self.outer:
                        yield self._out(k, "D", r.version)
            if changed:
                for k in naming[place]:
                    if k not in changes:
                        version, _, own = lefts[f"{place}\t{k}"]
                        if now or self.outer:
                            yield self._out(k, "U", version + held[0], own, held[2])
                        else:
                            yield self._out(k, "D", version + held[0])
        self.right.write(new_rights, rights)
        self.left.write(new_lefts, lefts)

    @staticmethod
    def _place(foreign: str, shard: str) -> str:
        """Text without tabs, as JSON text has none."""
        return f"{shard} {foreign}"

    @staticmethod
    def _out(k: str, op: str, version: str, own: str | None = None, other: str | None = None) -> tuple:
        return k, op, version, own, other


def foreign_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], foreign: str, right_key: str, order: Sequence[str] = ("seq",), right_order: Sequence[str] = ("seq",),
    how: str = "inner", shards: int = SHARDS, buckets: int = BUCKETS,
) -> DataFrame:
    """The changelog of each left row with the right row that its column `foreign` names, from two streaming changelogs:
    keys, op, version, values of the left (with `foreign`) and of the right (without its key). Rows that name nothing,
    or nothing that is there, are not in the result; with how="left" they are, with nulls.

    Two steps: the first, by left key, tells a foreign key that a row has left it; the second, by foreign key, holds
    the right row and the rows that name it. Rows of one foreign key are dealt to `shards` parts, each of which gets the
    right row, so that a foreign key with most of the rows is not one task. State is dealt to `buckets` buckets, the rows
    of one being in memory at a time; those of a part of a foreign key are in one bucket, so a key that tens of millions
    of rows name needs more shards. Names of values must differ.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    own, other = _fields(left, *keys, "op", *order), _fields(right, right_key, "op", *right_order)
    _apart([*own, *_fields(left.select(*keys))], other)
    named = packed([F.col(foreign).cast(right.schema[right_key].dataType).alias("k")])
    rows = left.select(packed([F.col(k) for k in keys]).alias("k"), named.alias("foreign"), "op", version(left, order).alias(VERSION), packed(_columns(own)).alias("own"))
    step = _by_bucket(rows.withColumn("bucket", _bucket(buckets, "k")), _Moves())
    if how == "inner":
        step = step.filter("foreign <> '{}'")
    shard = F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int")
    rights = right.filter(F.col(right_key).isNotNull()).select(
        packed([F.col(right_key).alias("k")]).alias("foreign"), F.lit(None).cast("string").alias("k"), "op", version(right, right_order).alias(VERSION), packed(_columns(other)).alias("own")
    )
    rights = rights.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = step.select("foreign", shard.alias("shard"), "k", "op", VERSION, "own").unionByName(rights)
    both = both.withColumns({"bucket": _bucket(buckets, "foreign", "shard"), "shard": F.col("shard").cast("string")})
    made = _by_bucket(both, _Foreign(how == "left"))
    return made.select(*unpacked("k", _fields(left.select(*keys))), "op", VERSION, *unpacked("own", own), *unpacked("other", other))


# What differs


class _Differences(_ByBucket):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = _Held(handle, "held")  # version, there, own

    def changed(self, rows: Iterator) -> Iterator[tuple]:
        held, changed = self.held.read(), {}
        for k, new in _lasts(rows).items():
            old = held.get(k) or (None, False, None)
            if old[0] is not None and new.version < old[0]:
                continue
            there = new.op == "U"
            own = new.own if there else None
            if there != old[1] or own != old[2]:
                yield k, new.op, new.version, own
            held[k] = changed[k] = (new.version, there, own)
        self.held.write(changed, held)


def differences(changes: DataFrame, keys: Sequence[str], order: Sequence[str] = (VERSION,), buckets: int = BUCKETS) -> DataFrame:
    """The changes that change something: an upsert of the values a key has already, and a delete of a key that is not
    there, go; of several in one micro-batch only the last one counts, so nothing in between is seen."""
    own = _fields(changes, *keys, "op", *order)
    rows = changes.select(packed([F.col(k) for k in keys]).alias("k"), "op", version(changes, order).alias(VERSION), packed(_columns(own)).alias("own"))
    made = _by_bucket(rows.withColumn("bucket", _bucket(buckets, "k")), _Differences())
    return made.select(*unpacked("k", _fields(changes.select(*keys))), "op", VERSION, *unpacked("own", own))


# A relation with the latest element


class _Zip(StatefulProcessor):
    """By shard: its rows and the latest element."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.element = handle.getValueState("element", "version string, own string")
        self.table = handle.getMapState("table", "k string", "version string, there boolean, own string")

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        new, changes = None, {}
        for r in rows:
            if r.k is None:
                new = r if new is None or r.version >= new.version else new
            elif r.k not in changes or (r.version, r.op) >= (changes[r.k].version, changes[r.k].op):
                changes[r.k] = r
        held = self.element.get()
        was = held is not None
        fresh = new is not None and (held is None or new.version >= held[0])
        if fresh:
            held = (new.version, new.own)
            self.element.update(held)
        for k, r in changes.items():
            old = self.table.getValue((k,))
            if old and r.version < old[0]:
                continue
            there = r.op == "U"
            self.table.updateValue((k,), (r.version, there, r.own if there else None))
            if held and there and not fresh:
                yield Row(k=k, op="U", version=r.version + held[0], own=r.own, other=held[1])
            elif was and not there and old and old[1]:
                yield Row(k=k, op="D", version=r.version + held[0], own=None, other=None)
        if fresh:
            for (k,), (version, there, own) in self.table.iterator():
                if there:
                    yield Row(k=k, op="U", version=version + held[0], own=own, other=held[1])

    def close(self) -> None:
        pass


def zip_latest(relation: DataFrame, stream: DataFrame, keys: Sequence[str], order: Sequence[str] = ("seq",), stream_order: Sequence[str] = ("seq",), shards: int = SHARDS) -> DataFrame:
    """The changelog of every row of a relation with the latest element of a stream: keys, op, version, values of the
    row, columns of the element without its order; nothing until there is an element. Rows are dealt to `shards` parts
    by their key; every part gets the element and emits its rows again when it changes."""
    own, other = _fields(relation, *keys, "op", *order), _fields(stream, *stream_order)
    _apart([*own, *_fields(relation.select(*keys))], other)
    rows = relation.select(packed([F.col(k) for k in keys]).alias("k"), "op", version(relation, order).alias(VERSION), packed(_columns(own)).alias("own"))
    rows = rows.select(F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("shard"), "*")
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    elements = stream.select(each, F.lit(None).cast("string").alias("k"), F.lit("U").alias("op"), version(stream, stream_order).alias(VERSION), packed(_columns(other)).alias("own"))
    made = rows.unionByName(elements).groupBy("shard").transformWithState(_Zip(), "k string, op string, version string, own string, other string", "Append", "None")
    return made.select(*unpacked("k", _fields(relation.select(*keys))), "op", VERSION, *unpacked("own", own), *unpacked("other", other))


# In the order of event time


class _InOrder(StatefulProcessor):
    """By key: rows wait until the watermark has passed them, then go through `step` in their order. `step` maps
    (what is held: two texts or nulls, row) to (what is held next, what is given out: two texts, or nothing)."""

    def __init__(self, step: Callable) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros bigint, version string, side int, own string")
        self.held = handle.getValueState("held", "a string, b string")
        self.wake = handle.getValueState("wake", "ms bigint")

    def _wake_at(self, micros: int) -> None:
        ms = -(-micros // 1000)
        wake = self.wake.get()
        if wake is None or wake[0] > ms:
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        passed = timer.getCurrentWatermarkInMs() * 1000
        new = [(r.micros, r.version, r.side, r.own) for r in rows if r.micros > passed]
        if new:
            self.waiting.appendList(new)
            self._wake_at(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        ready = sorted((r[1], r[2], r[3]) for r in rows if r[0] <= passed)
        rest = [tuple(r) for r in rows if r[0] > passed]
        held = tuple(self.held.get() or (None, None))
        for version, side, own in ready:
            held, given = self.step(held, side, own)
            if given:
                yield Row(**{"k": key[0], "version": version, "a": given[0], "b": given[1]})
        if ready:
            self.held.update(held)
        self.wake.clear()
        if rest:
            self.waiting.put(rest)
            self._wake_at(min(r[0] for r in rest))
        elif rows:
            self.waiting.clear()

    def close(self) -> None:
        pass


def _latest_step(held, side, own):
    held = (own, held[1]) if side == 0 else (held[0], own)
    return held, held if None not in held else None


def _lookup_step(held, side, own):
    if side == 0:
        return (own, None), None
    return held, (own, held[0]) if held[0] is not None else None


def _in_order(sides: Sequence[DataFrame], step: Callable, group: Sequence[str]) -> DataFrame:
    rows = sides[0]
    for s in sides[1:]:
        rows = rows.unionByName(s)
    rows = rows.withColumn("micros", F.unix_micros("time"))
    return rows.groupBy(*group).transformWithState(_InOrder(step), "k string, version string, a string, b string", "Append", "EventTime")


def _timed(df: DataFrame, partition: Sequence[str], time: str, order: Sequence[str], side: int, own: Column) -> DataFrame:
    k = packed([F.col(c) for c in partition])
    return df.select(k.alias("k"), F.col(time).cast("timestamp").alias("time"), version(df, [time, *order]).alias(VERSION), F.lit(side).alias("side"), own.alias("own"))


def combine_latest(left: DataFrame, right: DataFrame, time: str, order: Sequence[str], left_value: str, right_value: str, partition: Sequence[str] = (), delay: str = "1 hour") -> DataFrame:
    """The latest values of both sides whenever either changes, once both have one, in the order of event time: partition,
    version, left_value, right_value. Rows may come in any order within `delay` of the latest time seen; later ones go.

    A row waits until the watermark has passed it, so results equal those of the batch operator. Without a partition all
    rows are one sequence, which is one task. Rows of null value are no change and go.
    """
    given = [f for f in _fields(left) if f.name == left_value] + [f for f in _fields(right) if f.name == right_value]
    sides = [
        _timed(df.filter(F.col(v).isNotNull()), partition, time, order, side, packed([F.col(v)])).withWatermark("time", delay)
        for side, (df, v) in enumerate(((left, left_value), (right, right_value)))
    ]
    made = _in_order(sides, _latest_step, ["k"])
    return made.select(*unpacked("k", _fields(left.select(*partition))), VERSION, *unpacked("a", given[:1]), *unpacked("b", given[1:]))


def lookup_asof(elements: DataFrame, log: DataFrame, keys: Sequence[str], time: str, order: Sequence[str] = (), delay: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """Each element with the row its key had at its time: the last change at or before it. Elements whose key has no row
    then are dropped. Columns: keys, time, order and values of the element, values of the row, version.

    Elements and changes may come in any order within `delay` of the latest time seen; later ones go. An element waits
    until the watermark has passed it. Elements of one key are dealt to `shards` parts, each of which follows the key's
    changes, so that a key with most of the elements is not one task.
    """
    row = _fields(log, *keys, time, *order, "op")
    own = [f for f in _fields(elements) if f.name not in keys]
    _apart(_fields(elements), row)
    asked = _timed(elements, keys, time, order, 1, packed(_columns(own)))
    asked = asked.withColumn("shard", F.pmod(F.xxhash64(VERSION, "own"), F.lit(shards)).cast("int"))
    changes = _timed(log, keys, time, order, 0, F.when(F.col("op") == "U", packed(_columns(row))))
    changes = changes.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    made = _in_order([asked.withWatermark("time", delay), changes.withWatermark("time", delay)], _lookup_step, ["k", "shard"])
    return made.select(*unpacked("k", _fields(elements.select(*keys))), *unpacked("a", own), *unpacked("b", row), VERSION)


# Rows that leave by time


class _Expiring(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "version string, there boolean, until bigint")

    @staticmethod
    def _due(until: int) -> int:
        return until // 1000 + 1  # the first millisecond after it

    def _now(self, timer) -> int:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        new = _last(rows)
        old = self.held.get()
        if old and new.version < old[0]:
            return
        was = bool(old and old[1])
        if was:
            self.handle.deleteTimer(self._due(old[2]))
        there = new.op == "U" and new.until is not None and self._due(new.until) > self._now(timer)
        if there:
            self.handle.registerTimer(self._due(new.until))
            yield Row(k=key[0], op="U", version=new.version, own=new.own)
        elif was:
            yield Row(k=key[0], op="D", version=new.version, own=None)
        self.held.update((new.version, there, new.until if there else None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        version, there, until = self.held.get() or (None, False, None)
        if there and self._due(until) <= self._now(timerValues):
            self.held.update((version, False, None))
            yield Row(k=key[0], op="D", version=version + "~", own=None)  # after its upsert, before any later change

    def close(self) -> None:
        pass


class _ByWatermark(_Expiring):
    def _now(self, timer) -> int:
        return timer.getCurrentWatermarkInMs()


class _ByClock(_Expiring):
    def _now(self, timer) -> int:
        return timer.getCurrentProcessingTimeInMs()


def expiring(changes: DataFrame, keys: Sequence[str], until: str, order: Sequence[str] = ("seq",), clock: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """The changelog of a relation whose rows leave once their time `until` (a timestamp; its last moment counts) is past:
    a timer emits the delete, no change is needed. An upsert whose time is past already, or null, is a delete.

    Time is the clock of the machines, or with `clock` (an event-time column of the changes) the latest time seen less
    `delay`; changes older than that are dropped by Spark, so a late one needs a delay that covers it.
    """
    own = _fields(changes, *keys, "op", *order)
    rows = changes if clock is None else changes.withColumn("__clock", F.col(clock).cast("timestamp")).withWatermark("__clock", delay)
    rows = rows.select(
        packed([F.col(k) for k in keys]).alias("k"), "op", version(changes, order).alias(VERSION), F.unix_micros(F.col(until).cast("timestamp")).alias("until"),
        packed(_columns(own)).alias("own"), *(["__clock"] if clock else []),
    )
    step, mode = (_ByClock(), "ProcessingTime") if clock is None else (_ByWatermark(), "EventTime")
    made = rows.groupBy("k").transformWithState(step, "k string, op string, version string, own string", "Append", mode)
    return made.select(*unpacked("k", _fields(changes.select(*keys))), "op", VERSION, *unpacked("own", own))
