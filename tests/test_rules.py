"""Units, expressions, locations, time series, rules, rule tables and the minimiser."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rulefold.functions import location as L
from rulefold.functions import timeseries as S
from rulefold.functions import units as U
from rulefold.functions.expr import const, named, text
from rulefold.functions.location import Z100
from rulefold.plans import compile as C
from rulefold.plans import ruletable
from rulefold.plans.minimise import implies, is_complement, minimise
from rulefold.plans.rules import berth, key, require, restrict, size, vessel, when, wind


def test_dimension_table():
    assert U.quotient(U.LENGTH, U.TIME) == U.VELOCITY and U.product(U.VELOCITY, U.TIME) == U.LENGTH
    assert U.quotient(U.LENGTH, U.LENGTH) == U.SCALAR and U.product(U.SCALAR, U.MASS) == U.MASS
    assert U.product(U.ANGULAR_VELOCITY, U.TIME) == U.ANGLE
    for bad in (lambda: U.product(U.TIME, U.ANGULAR_VELOCITY), lambda: U.quotient(U.SCALAR, U.TIME), lambda: U.product(U.LENGTH, U.LENGTH)):
        with pytest.raises(U.DimensionError):
            bad()
    with pytest.raises(U.DimensionError):
        vessel.draught <= U.knots(3)
    with pytest.raises(U.DimensionError):
        when(vessel.draught)
    assert U.knots(1).value == pytest.approx(0.514444, abs=1e-6)


def test_text_has_just_the_parentheses_it_needs():
    a, b, c = vessel.draught, berth.draught, vessel.beam
    assert text((a + b) * const(2) <= c) == "(vessel.draught + berth.draught) * 2 <= vessel.beam"
    assert text(a - (b - c) <= c) == "vessel.draught - (berth.draught - vessel.beam) <= vessel.beam"
    assert text(~((a < b) | (b < c)) & (a < c)) == "not (vessel.draught < berth.draught or berth.draught < vessel.beam) and vessel.draught < vessel.beam"
    assert text(named("deep", a <= b)) == "deep" and text(abs(-a)) == "abs(-vessel.draught)"
    with pytest.raises(TypeError):
        bool(a < b)


def test_locations(spark):
    df = spark.createDataFrame([("urn:x:Z100/6/979",), ("urn:Z100/6/1",), ("urn:Z100/7/x",), ("nothing",), (None,)], "u string")

    def inside(where):
        return [r.u for r in df.filter(where.contains(F.col("u"))).collect()]

    assert inside(Z100 / 6 / "any") == ["urn:x:Z100/6/979", "urn:Z100/6/1"]
    assert inside(Z100 / 6 / 979 + Z100 / 9 / "any") == ["urn:x:Z100/6/979"]
    assert len(inside(L.anywhere)) == 5 and inside(L.Location()) == []
    assert L.parse("abc Z100/6/any") == Z100 / 6 / "any" and L.parse("Z100/6/9") == Z100 / 6 / 9 and L.parse("Z100/x/9") is None
    assert L.sensor_uuid("ABC-1-2-3-4") == "00000abc-0001-0002-0003-000000000004"


def test_nearest_sensor_ties_go_to_the_first_listed(spark):
    sensors = spark.createDataFrame([("b", 4.0, 52.0, 1), ("a", 4.0, 52.0, 0), ("c", 9.0, 52.0, 2)], "sensor string, lon double, lat double, ord int")
    points = spark.createDataFrame([(1, 4.1, 52.0), (2, 8.9, 52.0), (3, None, 52.0)], "id int, lon double, lat double")
    assert {r.id: r.sensor for r in L.nearest_sensor(points, sensors, "id").collect()} == {1: "a", 2: "c"}
    assert L.nearest_sensor(points, sensors.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        L.nearest_sensor(points, sensors, "id", most_sensors=1)


T0 = dt.datetime(2024, 1, 1)


def _predict(points, minutes, circular=False):
    """The rule by hand: strict bracket, else nearest by whole minutes up to 60, the earlier among equals."""
    points = sorted(points)
    for (t0, v0), (t1, v1) in zip(points, points[1:], strict=False):
        if t0 < minutes < t1:
            return v0 + (v1 - v0) / (t1 - t0) * (minutes - t0)
    near = sorted(((abs(minutes - t), t, v) for t, v in points), key=lambda x: (x[0], x[1]))
    return near[0][2] if near and near[0][0] <= 60 else None


def test_interpolation_against_the_rule(spark):
    rng = random.Random(2)
    series, asked, want = [], [], {}
    for k in range(12):
        points = [(t, float(rng.randint(0, 99))) for t in rng.sample(range(0, 600, 5), rng.randint(0, 4))]
        series += [(k, T0 + dt.timedelta(minutes=t), v) for t, v in points]
        for _ in range(12):
            t = rng.randrange(-90, 720, 5)
            want[len(asked)] = _predict(points, t)
            asked.append((k, T0 + dt.timedelta(minutes=t), len(asked)))
    s = spark.createDataFrame(series, "k int, time timestamp, value double")
    q = spark.createDataFrame(asked, "k int, time timestamp, id int")
    long = {r.id: r.value for r in S.interpolate(q, s, "k").collect()}
    arrays = s.groupBy("k").agg(S.combine(F.collect_list(F.struct("time", "value"))).alias("s"))
    short = {r.id: r.v for r in q.join(arrays, "k", "left").select("id", S.predict_array(F.coalesce("s", F.expr("cast(array() as array<struct<time:timestamp,value:double>>)")), F.col("time")).alias("v")).collect()}
    for i, w in want.items():
        assert (long[i] is None) == (w is None) == (short[i] is None)
        assert w is None or (long[i] == pytest.approx(w) and short[i] == pytest.approx(w))


def test_angles_may_go_the_short_way(spark):
    s = spark.createDataFrame([(1, T0, 350.0), (1, T0 + dt.timedelta(minutes=20), 10.0)], "k int, time timestamp, value double")
    q = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=5))], "k int, time timestamp")
    assert S.interpolate(q, s, "k").first().value == pytest.approx(265.0)
    assert S.interpolate(q, s, "k", circular=True).first().value == pytest.approx(355.0)


KINDS = "id int, vessel struct<draught:double,beam:double,length:double,direction:string,type:string,destination:string>, berth struct<draught:double>, wind struct<velocity:double>"


def fleet(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = (rng.uniform(0, 20), float(rng.randint(10, 50)), float(rng.randint(50, 400)), rng.choice(["Inbound", "Outbound", None]), rng.choice(["A12", "A13"]), f"urn:Z100/{rng.randint(5, 8)}/{rng.randint(1, 3)}")
        rows.append((i, v, (rng.uniform(5, 15),) if rng.random() < 0.7 else None, (rng.uniform(0, 30),) if rng.random() < 0.5 else None))
    return spark.createDataFrame(rows, KINDS)


def test_absent_records_give_no_result(spark):
    rule = require((wind.velocity <= U.metres_per_second(10)) | (vessel.beam > U.metres(0)))
    got = C.evaluate(fleet(spark), [rule])
    assert got.filter("wind is null").count() == 0 and got.filter("wind is not null").count() > 0
    assert C.sources([rule]) == {"wind", "vessel"}


def test_bodies_and_reasons(spark):
    rules = [restrict(Z100 / 6 / "any", when(vessel.beam > U.metres(30))), require(vessel.draught <= U.metres(10)), require(vessel.length <= U.metres(100))]
    got = {r.id: r for r in C.evaluate(fleet(spark), rules).collect()}
    for r in got.values():
        want = [t for t, bad in (("vessel.draught <= 10 m", r.vessel.draught > 10), ("vessel.length <= 100 m", r.vessel.length > 100)) if bad]
        assert r.reasons == want and r.allow == (not want)
    only_empty = C.evaluate(fleet(spark), rules[:1]).collect()
    assert only_empty and all(r.allow and "/6/" in r.vessel.destination for r in only_empty)
    assert C.evaluate(fleet(spark), []).count() == 0
    assert rules[0].origin.startswith("test_rules.py:")


def random_rule(rng, depth=0):
    limits = [vessel.beam <= U.metres(rng.choice([20, 30, 40])), vessel.length <= U.metres(rng.choice([100, 200])), vessel.draught <= U.metres(rng.choice([8, 12])), vessel.length > U.metres(60), const(rng.random() < 0.7)]
    guards = [vessel.draught >= U.metres(6), vessel.draught < U.metres(6), vessel.type.is_("A12"), vessel.direction.is_("Inbound")]
    if depth == 3 or rng.random() < 0.35:
        return require(rng.choice(limits))
    body = [random_rule(rng, depth + 1) for _ in range(rng.randint(1, 3))]
    return when(rng.choice(guards), *body) if rng.random() < 0.5 else restrict(rng.choice([Z100 / 6 / "any", Z100 / 7 / "any", Z100 / 6 / 1]), *body)


@pytest.mark.parametrize("seed", range(6))
def test_minimiser_keeps_who_is_denied(spark, seed):
    rng = random.Random(seed)
    rule = restrict(L.anywhere, *(random_rule(rng) for _ in range(6)))
    small = minimise(rule, fresh_water=False)
    assert size(small) <= size(rule)
    vessels = fleet(spark, seed=seed)
    denied = [{r.id for r in C.deny_events(vessels, [x]).select("id").collect()} for x in (rule, small)]
    assert denied[0] == denied[1]


def test_rewrites():
    b = require(vessel.beam <= U.metres(20))
    merged = minimise(restrict(L.anywhere, restrict(Z100 / 6 / "any", b), restrict(Z100 / 7 / "any", b), restrict(Z100 / 7 / "any", b)))
    assert key(merged) == key(restrict(L.anywhere, restrict(Z100 / 6 / "any" + Z100 / 7 / "any", b)))
    assert str(minimise(restrict(L.anywhere, when(vessel.beam > U.metres(5), require(const(False)))))) == "restrict(any) {\n  require(not vessel.beam > 5 m)\n}"
    fresh = restrict(L.anywhere, require(ruletable.fresh_water_allowance.is_(2.5)), require(ruletable.contract_depth >= vessel.draught + U.metres(1)))
    assert "contract_depth >= 1.025 * (vessel.draught + 1 m)" in str(minimise(fresh))
    assert implies(vessel.beam <= U.metres(3), vessel.beam <= U.metres(4)) and not implies(vessel.beam <= U.metres(4), vessel.beam <= U.metres(3))
    assert implies(vessel.length > U.metres(3), vessel.length >= U.metres(3)) and not implies(vessel.length >= U.metres(3), vessel.length > U.metres(3))
    assert is_complement(vessel.beam < U.metres(3), vessel.beam >= U.metres(3)) and is_complement(~b.condition, b.condition)


def test_rule_table(spark, tmp_path):
    def line(**cells):
        return ";".join(cells.get(c, "") for c in ruletable.COLUMNS)

    good = line(FEATUREID="x Z100/6/9", RESTRICTION_TYPE="MAXIMUM_BEAM", VESSEL_TYPE="A12", VESSEL_DRAUGHT_FROM="6,5", VESSEL_DRAUGHT_TO="9", VESSEL_DIRECTION="INBOUND_OUTBOUND", RESTRICTION_VALUE="30,5", RESTRICTION_UNIT="METERS")
    all_types = line(RESTRICTION_TYPE="VESSEL_TYPE", VESSEL_TYPE="ALL", RESTRICTION_VALUE="0")
    bad = line(RESTRICTION_TYPE="OTHER", VESSEL_TYPE="Z", VESSEL_BEAM_TO="wide")
    file = tmp_path / "rules.csv"
    file.write_text("\n".join([";".join(ruletable.COLUMNS), good, all_types, bad]))
    table = ruletable.read(spark, str(file))
    corrupt = [r._corrupt for r in table.collect()]
    assert corrupt[:2] == [None, None] and all(w in corrupt[2] for w in ("VESSEL_BEAM_TO", "VESSEL_TYPE", "RESTRICTION_TYPE"))
    with pytest.raises(ValueError):
        ruletable.read(spark, str(file), strict=True)
    made = ruletable.rules(table)
    assert str(made).splitlines() == [
        "restrict(Z100/6/any) {",
        "  restrict(Z100/6/9) {",
        "    when(vessel.type is A12) {",
        "      when(vessel.direction is Inbound or vessel.direction is Outbound) {",
        "        when(vessel.draught >= 6.5 m) {",
        "          require(vessel.beam <= 30.5 m)",
        "        }",
        "      }",
        "    }",
        "  }",
        "  require(false)",
        "}",
    ]
    row = Row(**{c: None for c in ruletable.COLUMNS} | {"RESTRICTION_TYPE": "MAXIMUM_BEAM", "RESTRICTION_VALUE": "3", "RESTRICTION_UNIT": "FEET"})
    with pytest.raises(ValueError, match="no requirement"):
        ruletable.rule(row)


def test_rule_rows_and_limits_agree(spark):
    """Every restriction type with its unit, as a rule tree for each row and as limits in one job."""
    rows, fields = [], dict.fromkeys(ruletable.COLUMNS, "")
    for i, (kind, value, unit) in enumerate([("VESSEL_TYPE", "0", ""), ("VESSEL_TYPE", "1", ""), ("MINIMUM_UKC", "0,5", "METERS"), ("MINIMUM_UKC_LONG_TERM", "3", "METERS"), ("FRESH_WATER_ALLOWANCE", "2", "PERCENTAGE"),
                                             ("MAXIMUM_BEAM", "30", "METERS"), ("MAXIMUM_LENGTH", "200", "METERS"), ("MINIMUM_LENGTH", "120", "METERS"), ("MAXIMUM_BEAM", "30", "FEET"), ("VESSEL_TYPE", "2", "")]):
        for low, high, way, code, where in (("", "", "", "ALL", "x:Z100/6/any"), ("8,5", "", "INBOUND_OUTBOUND", "A12", "x:Z100/6/7"), ("", "12", "INBOUND", "", "nowhere"), ("9", "11", "", "A13", "x:Z100/7/any")):
            own = {"FEATUREID": where, "RESTRICTION_TYPE": kind, "VESSEL_TYPE": code, "VESSEL_DRAUGHT_FROM": low, "VESSEL_DRAUGHT_TO": high, "VESSEL_DIRECTION": way, "RESTRICTION_VALUE": value, "RESTRICTION_UNIT": unit}
            rows.append(tuple((fields | own).values()))
    typed = ruletable.typed(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ruletable.COLUMNS))).cache()
    ships = []
    for i in range(60):
        urn = f"urn:Z100/{6 + i % 2}/{7 + i % 3}"
        ships.append((i, urn, 6 + i % 2, 7 + i % 3, ["A12", "A13", None][i % 3], ["Inbound", "Outbound", None][i % 4 % 3], 6.0 + i % 8, 20.0 + i % 20, 100.0 + 3 * i, 10.0 + i % 6 if i % 5 else None, float(i % 4)))
    v = spark.createDataFrame(ships, "id int, urn string, section bigint, place bigint, type string, direction string, draught double, beam double, length double, contract_depth double, fresh_water_allowance double")
    for both in (False, True):
        made = ruletable.limits(typed, both_bounds=both)
        assert made.filter("fault is not null").count() == 8
        got = {r.id: (r.n_rules, r.n_denied) for r in ruletable.evaluate(v, made, "id").collect()}
        strict = ruletable.evaluate(v, ruletable.strictest(made), "id").collect()
        assert {r.id: r.allow for r in strict} == {k: not denied for k, (_, denied) in got.items()} and sum(r.n_rules for r in strict) < sum(n for n, _ in got.values()) + 1
        record = F.struct("type", "direction", "draught", "beam", "length", F.col("urn").alias("destination"))
        berths = F.when(F.col("contract_depth").isNotNull(), F.struct("contract_depth", "fresh_water_allowance"))
        ready = v.select("id", record.alias("vessel"), berths.alias("berth"))
        trees = []
        for row in typed.collect():
            try:
                trees.append(ruletable.rule(row, both))
            except ValueError:
                continue
        assert len(trees) == 32
        columns = [b.result() for t in trees for b in C.branches([t], F.col("vessel.destination"))]
        counts = ready.select("id", F.array_compact(F.array(*columns)).alias("r")).select("id", F.size("r").alias("n"), F.size(F.filter("r", lambda x: ~x["allow"])).alias("denied"))
        assert got == {r.id: (r.n, r.denied) for r in counts.collect() if r.n}


def test_interpolation_across_days(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    points = spark.createDataFrame([("a", day(1, 6), 10.0), ("a", day(9, 6), 50.0), ("b", day(3), 1.0)], "k string, time timestamp, value double")
    asked = spark.createDataFrame([("a", day(1)), ("a", day(3)), ("a", day(5, 6)), ("a", day(9, 6)), ("a", day(20)), ("b", day(2, 23)), ("b", day(3, 1)), ("c", day(3))], "k string, time timestamp")
    got = {(r.k, r.time): r.value for r in S.interpolate(asked, points, "k").collect()}
    assert got[("a", day(5, 6))] == 30.0 and got[("a", day(3))] == pytest.approx(10 + 40 * 42 / 192) and got[("a", day(9, 6))] == 50.0
    assert got[("b", day(2, 23))] == got[("b", day(3, 1))] == 1.0
    assert got[("a", day(1))] is got[("a", day(20))] is got[("c", day(3))] is None
