"""Operators with keyed state against the batch operators, on shuffled and late changes, batch by batch and over restarts."""

import datetime as dt
import decimal
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rulefold.operators import streams
from rulefold.operators.relation import Relation, last_changes
from rulefold.streaming import keyed, replay

pytestmark = pytest.mark.usefixtures("small_state")

LEFT = "k string, n int, op string, seq bigint, fk bigint, a string"
RIGHT = "id bigint, op string, seq bigint, b bigint"
BIG = 2**53 + 1


def file_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def feed(spark, folder, rows, schema):
    """One more micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, tmp_path, name):
    """Use up what there is; the same name goes on from its checkpoint."""
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def folded(df, keys):
    return Relation.from_changelog(df, keys, ["version"]).df.drop("version")


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def changes(rng, n, first):
    """Left and right changes: moves between foreign keys, deletes, null foreign keys, some older than others."""
    left = [(rng.choice("ABCDEFGH"), rng.choice([1, None]), rng.choice("UUUD"), first + i, rng.choice([1, 2, 3, 4, 5, None]), rng.choice(["x", "y", None])) for i in range(n)]
    right = [(rng.choice([1, 2, 3, 4, None]), rng.choice("UUD"), first + i, rng.choice([None, BIG, BIG + 1, 3])) for i in range(n // 2)]
    left = [(k, m, op, s, *((fk, a) if op == "U" else (None, None))) for k, m, op, s, fk, a in left]
    right = [(k, op, s, b if op == "U" else None) for k, op, s, b in right]
    rng.shuffle(left)
    rng.shuffle(right)
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
def test_foreign_join_agrees_with_the_batch_join_batch_by_batch(spark, tmp_path, how):
    rng = random.Random(7)
    lefts, rights = [], []
    for batch in range(4):
        left, right = changes(rng, 14, 20 * batch)
        if batch == 2:
            left.append(("A", 1, "U", 1, 3, "late"))  # older than what A has
        if batch == 3:
            right = [(1, "D", 99, None)]
        feed(spark, tmp_path / "l", left, LEFT)
        feed(spark, tmp_path / "r", right, RIGHT)
        lefts += left
        rights += right
        joined = keyed.foreign_join(file_stream(spark, tmp_path / "l", LEFT), file_stream(spark, tmp_path / "r", RIGHT), ["k", "n"], "fk", "id", how=how, shards=3)
        got = run(joined, tmp_path, how)  # each batch restarts from the checkpoint
        a = Relation.from_changelog(spark.createDataFrame(lefts, LEFT), ["k", "n"], ["seq"])
        b = Relation.from_changelog(spark.createDataFrame(rights, RIGHT).filter("id is not null"), ["id"], ["seq"]).df.select(F.col("id").alias("fk"), "b")
        want = a.df.drop("seq").join(b, "fk", how).select("k", "n", "fk", "a", "b")
        assert table(folded(got, ["k", "n"]).select("k", "n", "fk", "a", "b")) == table(want)
    first = got.groupBy("k", "n").agg(F.min_by("op", "version").alias("op")).filter("op = 'D'")
    assert first.count() == 0  # deletes come only for rows that were there
    with pytest.raises(ValueError):
        keyed.foreign_join(file_stream(spark, tmp_path / "l", LEFT), file_stream(spark, tmp_path / "l", LEFT), ["k"], "fk", "fk")


def test_foreign_join_holds_buckets_not_keys(spark, tmp_path):
    """Rows of state are as many as the buckets touched, over upserts that outdate them; a key needs none of its own."""
    for batch in range(3):
        feed(spark, tmp_path / "l", [(f"k{i}", 1, "D" if batch == 2 and i % 3 == 0 else "U", 1000 * batch + i, (i + batch) % 40, "x") for i in range(300)], LEFT)
        feed(spark, tmp_path / "r", [(i, "U", 1000 * batch + i, i + batch) for i in range(40)], RIGHT)
    joined = keyed.foreign_join(file_stream(spark, tmp_path / "l", LEFT), file_stream(spark, tmp_path / "r", RIGHT), ["k", "n"], "fk", "id", shards=1, buckets=4)
    q = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 4 * 2 * 3
    got = folded(spark.read.schema(joined.schema).parquet(str(tmp_path / "out")), ["k", "n"])
    assert table(got.select("k", "fk", "b")) == sorted(((f"k{i}", (i + 2) % 40, (i + 2) % 40 + 2) for i in range(300) if i % 3), key=repr)


def test_left_join_holds_buckets_not_keys(spark, tmp_path):
    """Also of rows that name nothing that is there, as right rows leave."""
    feed(spark, tmp_path / "l", [(f"k{i}", 1, "U", i, i % 40, "x") for i in range(300)], LEFT)
    feed(spark, tmp_path / "r", [(i, "U", i, i) for i in range(40)], RIGHT)
    feed(spark, tmp_path / "l", [("k0", 1, "D", 1000, None, None)], LEFT)
    feed(spark, tmp_path / "r", [(i, "D", 1000 + i, None) for i in range(20)], RIGHT)
    joined = keyed.foreign_join(file_stream(spark, tmp_path / "l", LEFT), file_stream(spark, tmp_path / "r", RIGHT), ["k", "n"], "fk", "id", how="left", shards=1, buckets=4)
    got = run_in_few_rows(joined, tmp_path, 4 * 2 * 2)
    assert table(folded(got, ["k", "n"]).select("k", "fk", "b")) == sorted(((f"k{i}", i % 40, i % 40 if i % 40 >= 20 else None) for i in range(1, 300)), key=repr)


def run_in_few_rows(stream, tmp_path, most):
    """What the stream gives; rows of state are `most` at most."""
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= most
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_values_of_every_type_come_back(spark, tmp_path):
    schema = "k bigint, op string, seq bigint, d double, f float, m decimal(30,10), t timestamp, u date, x binary, l array<bigint>, s struct<a: int, b: string>, o boolean, z timestamp_ntz"
    at = dt.datetime(2024, 1, 1, 12, 30, 15, 123456)
    rows = [
        (BIG, "U", 1, math.inf, 0.1, decimal.Decimal("12345678901234567890.0123456789"), at, at.date(), b"\x00\xff", [BIG, None], (1, 'q"\n'), True, at),
        (2, "U", 2, -0.1, None, None, None, None, None, None, None, None, None), (3, "U", 3, 5e-324, 1e30, None, at, None, b"", [], (None, ""), False, None),
    ]
    feed(spark, tmp_path / "in", rows, schema)
    got = run(keyed.differences(file_stream(spark, tmp_path / "in", schema), ["k"], ["seq"]), tmp_path, "out")
    assert table(got.drop("version")) == table(spark.createDataFrame(rows, schema).drop("seq"))


def test_differences_see_nothing_in_between(spark, tmp_path):
    schema = "k string, op string, seq bigint, v int"
    batches = [
        [("A", "U", 1, 1), ("A", "U", 2, 2), ("B", "D", 3, None), ("C", "U", 4, 7)],
        [("A", "U", 5, 9), ("A", "U", 6, 2), ("C", "U", 7, 7), ("C", "U", 2, 8)],
        [("A", "D", 8, None), ("B", "U", 9, 1), ("B", "D", 10, None), ("C", "D", 11, None), ("C", "U", 12, 5)],
    ]
    for rows in batches:
        feed(spark, tmp_path / "in", rows, schema)
        got = run(keyed.differences(file_stream(spark, tmp_path / "in", schema), ["k"], ["seq"]), tmp_path, "out")
    assert [(r.k, r.op, r.v) for r in got.orderBy("version").collect()] == [("A", "U", 2), ("C", "U", 7), ("A", "D", None), ("C", "U", 5)]


def test_differences_hold_buckets_not_keys(spark, tmp_path):
    schema = "k string, op string, seq bigint, v int"
    for batch in range(2):
        feed(spark, tmp_path / "in", [(f"k{i}", "U", 1000 * batch + i, i * (batch if i % 2 else 1)) for i in range(300)], schema)
    got = run_in_few_rows(keyed.differences(file_stream(spark, tmp_path / "in", schema), ["k"], ["seq"], buckets=4), tmp_path, 4 * 2)
    assert got.count() == 300 + 150  # the odd ones change
    assert table(folded(got, ["k"]).select("k", "v")) == sorted(((f"k{i}", i) for i in range(300)), key=repr)


def test_zip_latest_agrees_at_the_end_of_each_batch(spark, tmp_path):
    rng = random.Random(2)
    schema, other = "k bigint, op string, seq bigint, v bigint", "seq bigint, e string"
    rows, elements = [], []
    for batch in range(4):
        new = [(rng.randint(1, 6), op, 10 * batch + i, rng.randint(0, 3) if op == "U" else None) for i in range(8) for op in [rng.choice("UUD")]]
        rng.shuffle(new)
        more = [] if batch in (0, 2) else [(100 * batch + i, rng.choice("pq")) for i in range(3)]
        feed(spark, tmp_path / "l", new, schema)
        feed(spark, tmp_path / "r", more, other)
        rows += new
        elements += more
        zipped = keyed.zip_latest(file_stream(spark, tmp_path / "l", schema), file_stream(spark, tmp_path / "r", other), ["k"], shards=3)
        got = run(zipped, tmp_path, "out")
        base = Relation.from_changelog(spark.createDataFrame(rows, schema), ["k"], ["seq"])
        want = base.map(v=F.col("v")).zip_latest(spark.createDataFrame(elements, other), ["seq"]).df.drop("seq")
        assert table(folded(got, ["k"])) == table(want)
    assert want.count() > 0


def shuffled(rng, rows, reach):
    """Rows (time, ...) a little out of order."""
    return sorted(rows, key=lambda r: r[0] + dt.timedelta(seconds=rng.uniform(0, reach)))


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


CLOSING = at(10**6)


def test_lookup_asof_agrees_for_late_and_unordered_input(spark, tmp_path):
    rng = random.Random(4)
    log_schema, element_schema = "time timestamp, seq bigint, k string, op string, v bigint", "time timestamp, seq bigint, k string, e int"
    log = [(at(rng.randint(0, 900) + rng.choice([0, 0.000001])), i, rng.choice("AB"), op, BIG + i if op == "U" else None) for i in range(60) for op in [rng.choice("UUUD")]]
    elements = [(at(rng.randint(0, 900)), rng.randint(0, 60), rng.choice("ABC"), i) for i in range(60)]
    a, b = shuffled(rng, log, 60), shuffled(rng, elements, 60)
    for i in range(4):
        cut = [[r for r in rows if 250 * i <= (r[0] - at(0)).total_seconds() + (0 if r[1] % 2 else 60) < 250 * (i + 1)] for rows in (a, b)]
        feed(spark, tmp_path / "l", cut[0], log_schema)
        feed(spark, tmp_path / "e", cut[1], element_schema)
        got = run(keyed.lookup_asof(file_stream(spark, tmp_path / "e", element_schema), file_stream(spark, tmp_path / "l", log_schema), ["k"], "time", ["seq"], delay="3 minutes", shards=2), tmp_path, "out")
    feed(spark, tmp_path / "l", [(CLOSING, 0, "Z", "U", 0)], log_schema)
    feed(spark, tmp_path / "e", [(CLOSING, 0, "Z", 0)], element_schema)
    got = run(keyed.lookup_asof(file_stream(spark, tmp_path / "e", element_schema), file_stream(spark, tmp_path / "l", log_schema), ["k"], "time", ["seq"], delay="3 minutes", shards=2), tmp_path, "out")
    want = streams.lookup_asof(spark.createDataFrame(elements, element_schema), spark.createDataFrame(log, log_schema), ["k"], ["time", "seq"]).select("k", "time", "seq", "e", "v")
    assert table(got.select("k", "time", "seq", "e", "v")) == table(want) and want.count() > 20
    # what comes after the watermark goes, and harms nothing
    feed(spark, tmp_path / "e", [(at(5), 0, "A", 77)], element_schema)
    feed(spark, tmp_path / "l", [(at(5), 0, "A", "U", 5)], log_schema)
    again = run(keyed.lookup_asof(file_stream(spark, tmp_path / "e", element_schema), file_stream(spark, tmp_path / "l", log_schema), ["k"], "time", ["seq"], delay="3 minutes", shards=2), tmp_path, "out")
    assert again.filter("e = 77").count() == 0


@pytest.mark.parametrize("partition", [[], ["k"]])
def test_combine_latest_agrees_on_shuffled_input(spark, tmp_path, partition):
    rng = random.Random(6)
    schemas = ["time timestamp, seq bigint, k string, a int", "time timestamp, seq bigint, k string, b string"]
    left = [(at(rng.randint(0, 600)), 2 * i, rng.choice("AB"), rng.choice([1, 2, 3, None])) for i in range(40)]
    right = [(at(rng.randint(0, 600)), 2 * i + 1, rng.choice("AB"), rng.choice(["p", "q"])) for i in range(40)]
    sides = [shuffled(rng, left, 60), shuffled(rng, right, 60)]
    combined = None
    for i in range(4):
        for name, rows, schema in zip("lr", sides, schemas, strict=True):
            new = [r for r in rows if 160 * i <= (r[0] - at(0)).total_seconds() + (60 if r[1] % 3 else 0) < 160 * (i + 1 if i < 3 else 9)]
            feed(spark, tmp_path / name, new if i < 3 else [*new, (CLOSING, 0, None, None)], schema)
        if combined is None:
            streams_in = [file_stream(spark, tmp_path / n, s) for n, s in zip("lr", schemas, strict=True)]
            combined = keyed.combine_latest(*streams_in, "time", ["seq"], "a", "b", partition, delay="3 minutes")
        got = run(combined, tmp_path, "out")
    feed(spark, tmp_path / "l", [(CLOSING, 1, "Z", 1)], schemas[0])
    feed(spark, tmp_path / "r", [(CLOSING, 2, "Z", "z")], schemas[1])
    got = run(combined, tmp_path, "out")
    frames = [spark.createDataFrame(rows, s) for rows, s in zip((left, right), schemas, strict=True)]
    want = streams.combine_latest(frames[0].filter("a is not null"), frames[1], ["time", "seq"], "a", "b", partition)
    assert table(got.drop("version")) == table(want.select(*partition, "a", "b")) and want.count() > 20


def test_rows_leave_when_their_time_is_past(spark, tmp_path):
    schema = "ts timestamp, seq bigint, k string, op string, until timestamp"
    batches = [
        [(at(0), 1, "A", "U", at(100)), (at(0), 2, "B", "U", at(50)), (at(0), 3, "C", "U", None), (at(1), 4, "D", "U", at(500))],
        [(at(60), 5, "A", "U", at(70)), (at(60), 6, "E", "U", at(50.5)), (at(60), 7, "D", "D", None)],
        [(at(90), 8, "F", "U", at(90)), (at(90), 9, "G", "U", at(10))],
        [(at(91), 10, "H", "U", at(1000)), (at(91), 3, "H", "D", None)],
    ]
    for i, rows in enumerate(batches):
        feed(spark, tmp_path / "in", rows, schema)
        got = run(keyed.expiring(file_stream(spark, tmp_path / "in", schema), ["k"], "until", clock="ts"), tmp_path, "out")
        there = {r.k for r in folded(got, ["k"]).collect()}
        now = rows[0][0]
        log = [r for b in batches[: i + 1] for r in b]
        want = last_changes(spark.createDataFrame(log, schema), ["k"], ["seq"]).filter((F.col("op") == "U") & (F.col("until") >= F.lit(now)))
        assert there == {r.k for r in want.collect()}, i
    assert [(r.k, r.op) for r in got.filter("k = 'B'").orderBy("version").collect()] == [("B", "U"), ("B", "D")]
    assert got.filter("k in ('C', 'G')").count() == 0


def test_replay_keeps_all_rows(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 7 > 0, F.col("id")))
    assert table(replay.results(replay.as_stream(df, "v", 3).select("id", "v"))) == table(df)
    assert replay.results(replay.as_stream(df.limit(0), "v")).count() == 0


def test_changes_of_a_bucket_come_as_one_row_of_lists():
    """In their order, nulls included, and back."""
    changes = pa.table({"k": ["a", "b", None, "d", "e"], "shard": [1, 2, 3, 4, 5], "bucket": pa.array([7, 8, 7, 7, 8], pa.int32())})
    (made,) = keyed._gathered(iter(changes.to_batches(max_chunksize=2)))
    rows = [Row(**r) for r in made.to_pylist()]
    assert made.schema.names == changes.schema.names
    assert [(r.bucket, r.k, r.shard) for r in rows] == [(7, ["a", None, "d"], [1, 3, 4]), (8, ["b", "e"], [2, 5])]
    assert [(c.k, c.shard) for c in keyed._ByBucket._each(iter(rows[:1]))] == [("a", 1), (None, 3), ("d", 4)]
    assert list(keyed._gathered(iter([]))) == []


def test_differences_of_a_bucket_go_out_as_lists():
    """Of PART_ROWS rows at most."""

    class Held:
        def read(self):
            return {"1": ["0", True, "x"]}

        def write(self, changed, rows):
            assert len(changed) == n

    n = keyed.PART_ROWS + 2
    differences = keyed._Differences()
    differences.held = Held()
    rows = [Row(bucket=0, k=[str(i) for i in range(n)], op=["U"] * n, version=["1"] * n, own=["x"] * n)]
    made = list(differences.handleInputRows((0,), iter(rows), None))
    assert [len(r.k) for r in made] == [keyed.PART_ROWS, 1]
    assert [k for r in made for k in r.k] == [str(i) for i in range(n) if i != 1]  # which has these values already


def test_buckets_travel_as_lines():
    """One text for each column of a bucket, an empty line for null, there and back."""
    texts = pa.table({"k": ["a", "b", "", "d"], "version": ["1", "1", "2", "3"], "bucket": pa.array([7, 8, 7, 7], pa.int32())})
    made = [r for b in keyed._in_lines(iter(texts.to_batches(max_chunksize=2))) for r in b.to_pylist()]
    assert made == [{"k": "a\n\nd", "version": "1\n2\n3", "bucket": 7}, {"k": "b", "version": "1", "bucket": 8}]

    class Echo(keyed._ByBucket):
        OUT = ("k", "version")

        def init(self, handle):
            pass

        def changed(self, rows):
            return ((r.k, r.version) for r in rows)

    (out,) = keyed._Lines(Echo()).handleInputRows((7,), iter([Row(**made[0])]), None)
    assert out.asDict() == {"k": "a\n\nd", "version": "1\n2\n3"}


def test_rows_of_a_bucket_are_held_as_lines():
    """Those that are not there keep their version, those that have gone do not come back."""

    class Handle(list):
        def getListState(self, *_):  # noqa: N802
            return self

        get, appendList, put = list.__iter__, list.extend, lambda self, parts: self.__setitem__(slice(None), parts)

    handle = Handle()
    held = keyed._Held(handle, "held")
    rows = held.read()
    for changed in ({"a": ("1", True, "x"), "b": ("1", True, "é"), "c": ("2", False, None)}, {"a": None, "b": ("3", True, "z")}):
        rows = {k: r for k, r in (rows | changed).items() if r}
        held.write(changed, rows)
        assert held.read() == rows
    assert rows == {"b": ("3", True, "z"), "c": ("2", False, None)} and len(handle) == 2
