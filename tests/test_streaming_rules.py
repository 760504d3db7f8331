"""Rule sets over changing records against the batch evaluation of the folded tables, batch by batch."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rulefold.functions.units import metres
from rulefold.operators.relation import Relation
from rulefold.plans import compile as C
from rulefold.plans.rules import INBOUND, berth, require, vessel, when
from rulefold.streaming import keyed
from rulefold.streaming import rules as R
from rulefold.streaming.rules import Record, deny_changes
from tests.test_keyed_streaming import feed, file_stream, folded, run, table

pytestmark = pytest.mark.usefixtures("small_state")

RULES = [when(vessel.direction.is_(INBOUND), require(berth.draught >= vessel.draught)), require(vessel.draught <= metres(9))]
VESSELS = "id bigint, op string, seq bigint, to bigint, vessel struct<draught: double, direction: string, destination: string>"
BERTHS = "urn bigint, op string, seq bigint, draught double, length double, width double"


def vessel_change(rng, key, seq):
    return (key, "U", seq, rng.choice([1, 2, 3, 7, None]), (float(rng.randint(4, 11)), rng.choice(["Inbound", "Outbound"]), "urn:x:Z100/1/1")) if rng.random() < 0.8 else (key, "D", seq, None, None)


def berth_change(rng, key, seq):
    return (key, "U", seq, float(rng.randint(4, 11)), 1.0, 1.0) if rng.random() < 0.7 else (key, "D", seq, None, None, None)


def denials(spark, vessels, berths):
    a = Relation.from_changelog(spark.createDataFrame(vessels, VESSELS), ["id"], ["seq"]).df.drop("seq")
    b = Relation.from_changelog(spark.createDataFrame(berths, BERTHS), ["urn"], ["seq"]).df.drop("seq")
    return C.deny_events(C.with_berth(a, b, "to", "urn"), RULES).select("id", "reasons")


def test_deny_changes_agree_with_full_snapshots_batch_by_batch(spark, tmp_path):
    rng = random.Random(8)
    vessels, berths, before, some = [], [], set(), 0
    for batch in range(4):
        v = [vessel_change(rng, rng.randint(1, 16), 100 * batch + i) for i in range(16)]
        b = [berth_change(rng, rng.randint(1, 4), 100 * batch + i) for i in range(5 if batch != 2 else 0)]
        rng.shuffle(v)
        feed(spark, tmp_path / "v", v, VESSELS)
        feed(spark, tmp_path / "b", b, BERTHS)
        vessels += v
        berths += b
        record = Record(file_stream(spark, tmp_path / "b", BERTHS), "urn", "to")
        changes = deny_changes(file_stream(spark, tmp_path / "v", VESSELS), RULES, ["id"], {"berth": record})
        got = run(changes, tmp_path, "out")
        old = Relation(denials(spark, vessels[: -len(v)], berths[: len(berths) - len(b)]), ("id",)) if batch else Relation.empty(spark, "id bigint, reasons array<string>", ["id"])
        now = denials(spark, vessels, berths)
        assert table(folded(got, ["id"])) == table(now)
        # just the differences of the two snapshots are published
        seen = {r.version + str(r.id) for r in got.collect()}
        new = got.filter((F.concat("version", F.col("id").cast("string"))).isin(list(seen - before)))
        assert table(new.select("id", "op", "reasons")) == table(old.changes_to(Relation(now, ("id",))))
        before = seen
        some += now.count()
    assert some > 8
    with pytest.raises(ValueError):
        deny_changes(file_stream(spark, tmp_path / "v", VESSELS), RULES, ["id"])


def state_bytes(folder):
    return {p: p.stat().st_size for p in Path(folder).rglob("*.changelog")}


def test_what_is_written_follows_what_changes(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    spark.conf.set(name, "true")
    try:
        rng = random.Random(1)
        first = [(k, "U", k, k % 40, (float(rng.randint(4, 11)), "Inbound", "urn:x:Z100/1/1")) for k in range(1500)]
        written = []
        for v, b in ((first, [(k, "U", k, 7.0, 1.0, 1.0) for k in range(40)]), ([(3, "U", 5000, 3, (5.0, "Inbound", "urn:x:Z100/1/1"))], []), ([], [(5, "U", 5000, 4.5, 1.0, 1.0)])):
            old = state_bytes(tmp_path / "out-cp")
            feed(spark, tmp_path / "v", v, VESSELS)
            feed(spark, tmp_path / "b", b, BERTHS)
            record = Record(file_stream(spark, tmp_path / "b", BERTHS), "urn", "to")
            got = run(deny_changes(file_stream(spark, tmp_path / "v", VESSELS), RULES, ["id"], {"berth": record}), tmp_path, "out")
            written.append(sum(n for p, n in state_bytes(tmp_path / "out-cp").items() if p not in old))
        assert 0 < written[1] < written[0] / 20 and 0 < written[2] < written[0] / 5
        assert got.filter("id % 40 <> 5").groupBy("id").count().filter("count > 2").count() == 0
    finally:
        spark.conf.set(name, "false")


def test_two_records_chain(spark, tmp_path):
    feed(spark, tmp_path / "v", [(1, "U", 1, 1, 2, (5.0,)), (2, "U", 2, 1, None, (5.0,)), (3, "U", 3, 9, 2, (5.0,))], "id bigint, op string, seq bigint, a bigint, b bigint, vessel struct<draught: double>")
    feed(spark, tmp_path / "a", [(1, "U", 1, 4.0)], "urn bigint, op string, seq bigint, draught double")
    feed(spark, tmp_path / "b", [(2, "U", 1, 3.0)], "ref bigint, op string, seq bigint, height double")
    from rulefold.plans.rules import tide

    rules = [require(berth.draught >= vessel.draught), require(tide.height >= vessel.draught)]
    records = {"berth": Record(file_stream(spark, tmp_path / "a", "urn bigint, op string, seq bigint, draught double"), "urn", "a"), "tide": Record(file_stream(spark, tmp_path / "b", "ref bigint, op string, seq bigint, height double"), "ref", "b")}
    # rules look at the vessel's destination; a column of another name serves where none restricts
    vessels = file_stream(spark, tmp_path / "v", "id bigint, op string, seq bigint, a bigint, b bigint, vessel struct<draught: double>").withColumn("vessel", F.struct("vessel.draught", F.lit("x").alias("destination")))
    got = folded(run(deny_changes(vessels, rules, ["id"], records), tmp_path, "out"), ["id"])
    assert {r.id: len(r.reasons) for r in got.collect()} == {1: 2, 2: 1, 3: 1}
    assert keyed.VERSION == "version"


def test_fields_that_no_rule_mentions_are_not_held(spark):
    mentioned = C.fields(RULES)
    assert mentioned == {("vessel", "direction"), ("vessel", "draught"), ("berth", "draught")}
    df = spark.createDataFrame([(1, (5.0, "Inbound", "urn:x:Z100/1/1")), (2, None)], "id bigint, vessel struct<draught: double, direction: string, destination: string>")
    made = df.select("id", R._record(df, "vessel", "vessel", mentioned)).orderBy("id")
    assert made.schema["vessel"].dataType.names == ["draught", "direction"]
    assert [r.vessel and tuple(r.vessel) for r in made.collect()] == [(5.0, "Inbound"), None]
