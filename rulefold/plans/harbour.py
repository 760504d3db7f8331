"""Queries of the harbour's fixed sensors, rule tables, messages and decoding, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.functions import location as L
from rulefold.functions import timeseries
from rulefold.functions.expr import const, void
from rulefold.functions.location import Z100
from rulefold.functions.units import BOOL, degrees, metres, metres_per_second
from rulefold.operators import streams
from rulefold.operators.relation import Relation
from rulefold.plans import catalog as K
from rulefold.plans import compile as C
from rulefold.plans import ruletable
from rulefold.plans.minimise import extract_common
from rulefold.plans.rules import berth, require, restrict, tidal_stream, tide, vessel, when
from rulefold.sources import ingest
from rulefold.sources.sensors import SENSORS, sensor_table

query = K.query


# Sensors


def _values(kind: str) -> str:
    rows = ", ".join(f"('{L.sensor_uuid(name)}', {lon}::double, {lat}::double, {i})" for i, (lon, lat, name) in enumerate(SENSORS[kind]))
    return f"(select * from (values {rows}) s(sensor, lon, lat, ord))"


def _nearest(kind: str) -> str:
    return f"""(select c_custkey, sensor from (select c_custkey, s.sensor, row_number() over (partition by c_custkey order by
2 * 6371008.8 * asin(sqrt(pow(sin(radians(s.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - b.lon) / 2), 2))), ord) rn
from (select c_custkey, 3.0::double + (c_custkey % 150) * 0.01::double lon, 51.4::double + (c_custkey % 60) * 0.01::double lat from customer where c_custkey % 7 <> 0) b,
{_values(kind)} s) where rn = 1)"""


def near(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return L.nearest_sensor(K.berth_places(spark, d), sensor_table(spark, kind), "c_custkey")


@query(" union all ".join(f"select c_custkey, '{k}' kind, sensor from {_nearest(k)}" for k in SENSORS))
def nearest_fixed_sensors(spark, d):
    return streams.merge(*(near(spark, d, k).select("c_custkey", F.lit(k).alias("kind"), "sensor") for k in SENSORS))


def readings(spark: SparkSession, d: str, kind: str, event: str) -> DataFrame:
    """Events of a type as readings of the sensors of a kind."""
    n = len(SENSORS[kind])
    events = K.table(spark, d, "events").filter(F.col("event_type") == event)
    places = sensor_table(spark, kind).select("sensor", "ord")
    return events.join(F.broadcast(places), events["user_id"] % n == places["ord"]).select("sensor", F.col("ts").alias("time"), "value", "event_id")


def _readings(kind: str, event: str) -> str:
    return f"(select s.sensor k, ts t, arg_max(value, event_id) v from events join {_values(kind)} s on user_id % {len(SENSORS[kind])} = s.ord where event_type = '{event}' group by 1, 2)"


def _asked(kind: str) -> str:
    return f"""(select sensor k, timestamp '2024-01-01' + to_minutes(o_orderkey % 43200) t, o_orderkey id, o_totalprice / 25000 draught, 5 + c_acctbal / 1000 bd
from orders join {_nearest(kind)} n on o_custkey = n.c_custkey join customer c on o_custkey = c.c_custkey)"""


def with_record(spark: SparkSession, d: str, record: str, events: dict[str, str]) -> DataFrame:
    fields = {name: readings(spark, d, record, event) for name, event in events.items()}
    return C.with_reading(K.vessels(spark, d), record, fields, near(spark, d, record), "o_orderkey", "o_custkey", "c_custkey", "vessel.time")


_TIDE = K._asof(K._asof(K._asof(_asked("tide"), _readings("tide", "view"), "height"), _readings("tide", "click"), "high"), _readings("tide", "purchase"), "low")


@query(f"""select id o_orderkey, 'berth.draught + tide.height >= vessel.draught + 30 m and tide.low_water <= tide.high_water' reasons from {_TIDE}
where height is not null and high is not null and low is not null and draught >= 5 and not (bd + height >= draught + 30 and low <= high)""")
def deny_events_tide(spark, d):
    rule = when(vessel.draught >= metres(5), require((berth.draught + tide.height >= vessel.draught + metres(30)) & (tide.low_water <= tide.high_water)))
    rows = with_record(spark, d, "tide", {"height": "view", "high_water": "click", "low_water": "purchase"})
    return C.deny_events(rows, [rule]).select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


_STREAM = K._asof(K._asof(_asked("tidal_stream"), _readings("tidal_stream", "view"), "rate"), _readings("tidal_stream", "click"), "dir")


@query(f"""select id o_orderkey, 'tidal_stream.rate <= 40 m/s or tidal_stream.direction > 60 deg' reasons from {_STREAM}
where rate is not null and dir is not null and not (rate <= 40 or dir > 60)""")
def deny_events_stream(spark, d):
    rule = require((tidal_stream.rate <= metres_per_second(40)) | (tidal_stream.direction > degrees(60)))
    return C.deny_events(with_record(spark, d, "tidal_stream", {"rate": "view", "direction": "click"}), [rule]).select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


_FIRST = K._asof(K._asof(K._PURCHASES, K._points("view", "user_id"), "x"), K._points("click", "user_id"), "y")


@query(f"select id, round(coalesce(x, y), 6) value from {_FIRST} where coalesce(x, y) is not null")
def interpolate_codes(spark, d):
    """Each code brackets within itself; the first one that predicts counts."""
    rows = K._purchases(spark, d)
    for kind, name in (("view", "x"), ("click", "y")):
        rows = timeseries.interpolate(rows, K.series(spark, d, kind, F.col("user_id")), "k", tie=["event_id"]).withColumnRenamed("value", name)
    return rows.select("id", F.round(timeseries.first_that_predicts(F.col("x"), F.col("y")), 6).alias("value")).filter("value is not null")


# Rule tables

#: Restriction types of the made-up cells, by part; the last is unknown.
_TYPES = [*ruletable.KINDS, "SOMETHING"]


def rule_cells(spark: SparkSession, d: str) -> DataFrame:
    """Parts as lines of a rule table, all text: decimal commas, empty and broken cells, unknown codes and units."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (k % len(_TYPES) + 1).cast("int"))
    own = {
        "FEATUREID": F.when(k % 50 == 49, "elsewhere").when(k % 10 == 9, F.concat(F.lit("urn:x:Z100/"), k % 25, F.lit("/"), k % 500)).otherwise(F.concat(F.lit("urn:x:Z100/"), k % 25, F.lit("/any"))),
        "RESTRICTION_TYPE": kind, "VESSEL_TYPE": F.element_at(F.array(*map(F.lit, ["ALL", "", "A11A", "A12", "A13", "A99"])), F.least(size % 7 + 1, F.lit(6)).cast("int")),
        "VESSEL_DRAUGHT_FROM": F.when(size % 3 == 0, F.concat((size / 3).cast("int").cast("string"), F.lit(",5"))).when(size % 11 == 10, "deep").otherwise(""),
        "VESSEL_DRAUGHT_TO": F.when(size % 4 == 0, (size % 20 + 2).cast("string")).otherwise(" "), "VESSEL_DIRECTION": F.when(size % 5 < 2, "INBOUND_OUTBOUND").otherwise("INBOUND"),
        "RESTRICTION_VALUE": F.when(kind == "VESSEL_TYPE", (size % 3).cast("string")).when(kind == "FRESH_WATER_ALLOWANCE", (size % 4).cast("string")).when(kind.like("MAX%"), (20 + 4 * size).cast("string"))
        .when(kind == "MINIMUM_LENGTH", (50 + size).cast("string")).otherwise(F.concat(F.lit("0,"), (size % 9).cast("string"))),
        "RESTRICTION_UNIT": F.when(kind == "FRESH_WATER_ALLOWANCE", "PERCENTAGE").when(size == 13, "FEET").otherwise("METERS"),
    }
    return K.table(spark, d, "part").select("p_partkey", *(own.get(c, F.lit("")).cast("string").alias(c) for c in ruletable.COLUMNS))


_CELLS = f"""(select p_partkey, k25, place, kind, typ, low, high, both_ways, val, unit,
case when kind = 'SOMETHING' or typ = 'A99' or p_size % 11 = 10 and p_size % 3 <> 0 then null
when kind = 'VESSEL_TYPE' and val = 0 then 'forbidden' when kind = 'VESSEL_TYPE' and val = 1 then 'allowed' when kind = 'VESSEL_TYPE' then null
when kind = 'FRESH_WATER_ALLOWANCE' then 'fresh_water' when unit = 'FEET' then null when kind like 'MINIMUM_UKC%' then 'ukc'
when kind = 'MAXIMUM_BEAM' then 'max_beam' when kind = 'MAXIMUM_LENGTH' then 'max_length' else 'min_length' end what
from (select p_partkey, p_size, case when p_partkey % 50 <> 49 then p_partkey % 25 end k25, case when p_partkey % 10 = 9 and p_partkey % 50 <> 49 then p_partkey % 500 end place,
case p_partkey % {len(_TYPES)} {" ".join(f"when {i} then '{t}'" for i, t in enumerate(_TYPES))} end kind,
case p_size % 7 when 2 then 'A11A' when 3 then 'A12' when 4 then 'A13' when 5 then 'A99' when 6 then 'A99' end typ,
case when p_size % 3 = 0 then p_size // 3 + 0.5 end low, case when p_size % 4 = 0 and p_size % 3 <> 0 then p_size % 20 + 2 end high, p_size % 5 < 2 both_ways,
case kind when 'VESSEL_TYPE' then p_size % 3 when 'FRESH_WATER_ALLOWANCE' then p_size % 4 when 'MAXIMUM_BEAM' then 20 + 4 * p_size when 'MAXIMUM_LENGTH' then 20 + 4 * p_size
when 'MINIMUM_LENGTH' then 50 + p_size else ('0.' || (p_size % 9))::double end::double val,
case when kind = 'FRESH_WATER_ALLOWANCE' then 'PERCENTAGE' when p_size = 13 then 'FEET' else 'METERS' end unit from part))"""


@query(f"""select p_partkey, what kind, k25 section, place, typ "type", low::double draught_from, high::double draught_to, both_ways, val bound from {_CELLS} where what is not null""")
def rule_csv_limits(spark, d):
    made = ruletable.limits(ruletable.typed(rule_cells(spark, d)), keep=["p_partkey"])
    return made.filter("kind is not null").drop("fault").withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query(f"""with v as materialized (select k, fk, section, draught, beam, len, dir is not null moves, case typ when '1' then 'A11A' when '2' then 'A12' when '3' then 'A13' end code, case when fk % 10 <> 0 then bd end cd, case when fk % 10 <> 0 then fk % 4 end fw from {K._V}),
r as materialized (select * from {_CELLS} where what is not null)
select k o_orderkey, count(*) n_rules, count(*) filter (where not met) n_denied, bool_and(met) allow from (
select v.k, coalesce(case what when 'max_beam' then beam <= val when 'max_length' then len <= val when 'min_length' then len > val when 'ukc' then cd >= draught + val
when 'fresh_water' then fw = val when 'allowed' then true else false end, false) met
from v join r on (k25 is null or section = k25) and (place is null or fk = place) and (r.typ is null or code = r.typ)
and (low is null or draught >= low) and (high is null or draught < high) and (not both_ways or moves) and (what not in ('ukc', 'fresh_water') or cd is not null)) group by 1""")
def rule_csv_eval(spark, d):
    code = F.create_map(*(F.lit(x) for pair in (("1", "A11A"), ("2", "A12"), ("3", "A13")) for x in pair))[F.col("vessel.type")]
    there = F.col("o_custkey") % 10 != 0
    v = K.vessels(spark, d).select(
        "o_orderkey", L.section(F.col("vessel.destination")).alias("section"), L.place(F.col("vessel.destination")).alias("place"), code.alias("type"), "vessel.direction",
        "vessel.draught", "vessel.beam", "vessel.length", F.when(there, F.col("berth.draught")).alias("contract_depth"), F.when(there, (F.col("o_custkey") % 4).cast("double")).alias("fresh_water_allowance"),
    )
    return ruletable.evaluate(v, ruletable.limits(ruletable.typed(rule_cells(spark, d))), "o_orderkey")


@query(f"""select k25 section, place, typ "type", both_ways, low::double draught_from, high::double draught_to, what kind,
case when what in ('max_beam', 'max_length') then min(val) else max(val) end bound from {_CELLS} where what is not null
group by k25, place, typ, both_ways, low, high, what, case when what in ('fresh_water', 'forbidden', 'allowed') then val end""")
def strictest_limits(spark, d):
    return ruletable.strictest(ruletable.limits(ruletable.typed(rule_cells(spark, d))))


_BOUNDS = [(f"vessel.beam <= {20 + 3 * i} m", f"beam <= {20 + 3 * i}") for i in range(6)] + [(f"vessel.length <= {150 + 20 * i} m", f"len <= {150 + 20 * i}") for i in range(6)]


@query(f"""select o_orderkey, string_agg(reason, ';' order by i) reasons from (
{" union all ".join(f"select k o_orderkey, {c} ok, '{t}' reason, {i} i from {K._V} where section in (6, 7)" for i, (t, c) in enumerate(_BOUNDS))}
union all select k, draught <= 10, 'vessel.draught <= 10 m', 90 from {K._V} where section = 7) where not ok group by 1""")
def extract_common_rules(spark, d):
    shared = [require(vessel.beam <= metres(20 + 3 * i)) for i in range(6)] + [require(vessel.length <= metres(150 + 20 * i)) for i in range(6)]
    six, seven = restrict(Z100 / 6 / "any", *shared), restrict(Z100 / 7 / "any", *shared, require(vessel.draught <= metres(10)))
    parts = extract_common(six, seven)
    return C.deny_events(K.vessels(spark, d), parts).select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


@query(K._case("draught <= 12", "vessel.draught <= 12 m"))
def rule_void(spark, d):
    """A condition that never has a value has no result and changes nothing."""
    return K.results(K.vessels(spark, d), require(void(BOOL)), when(void(BOOL) & const(True), require(const(False))), require(vessel.draught <= metres(12)))


@query(f"select user_id, event_id from {K.ALL}")
def named_stream(spark, d):
    return K.latest(streams.named(K.log(spark, d), "events")).df.select("user_id", "event_id")


# Messages and decoding


@query(f"""select o_orderkey::varchar "key", case when op = 'D' then '{{"Delete":{{"key":' || o_orderkey || '}}}}'
else '{{"Update":{{"key":' || o_orderkey || ',"value":{{"reasons":"' || reasons || '"}}}}}}' end "value" from ({K.ORACLE["deny_changes"]})""")
def restriction_messages(spark, d):
    return ingest.messages(K.QUERIES["deny_changes"](spark, d), "o_orderkey")


_CODES = list(ingest.CODES)


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON responses of one observation each, decoded: some are no points, some codes are unknown."""
    n = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, [*_CODES, "XX"])), (n % (len(_CODES) + 1) + 1).cast("int"))
    shape = F.struct(
        F.when(n % 10 == 0, "Line").otherwise("Point").alias("type"), F.when(n % 11 == 0, F.array(F.lit(4.0))).otherwise(F.array(F.lit(4.0), 51.0 + (n % 4) / 4)).alias("coordinates")
    )
    result = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("phenomenonTime"), F.array(F.struct(code.alias("name"), F.col("value"))).alias("parameters"))
    observation = F.struct(F.struct(F.concat(F.lit("s"), "user_id").alias("id"), F.when(n % 13 != 0, shape).alias("geometry")).alias("featureOfInterest"), F.array(result).alias("result"))
    body = F.to_json(F.struct(F.struct(F.array(observation).alias("observations")).alias("_embedded")))
    return K.table(spark, d, "events").select(F.from_json(body, ingest.OBSERVATIONS).alias("r")).select("r.*")


_SENT = f"(select *, case event_id % {len(_CODES) + 1} {' '.join(f"when {i} then '{c}'" for i, c in enumerate(_CODES))} else 'XX' end code from events)"
_MEASURE = "case " + " ".join(f"when code = '{c}' then '{m}'" for c, (m, _) in ingest.CODES.items()) + " end"
_FACTOR = "case " + " ".join(f"when code = '{c}' then {f}::double" for c, (_, f) in ingest.CODES.items()) + " end"


@query(f"""select 's' || user_id sensor, code, {_MEASURE} measure, epoch(date_trunc('second', ts))::bigint at_second, round(value * {_FACTOR}, 6) value, 51.0::double + (event_id % 4) / 4.0::double lat
from {_SENT} where code <> 'XX' and event_id % 10 <> 0 and event_id % 11 <> 0 and event_id % 13 <> 0""")
def observations_decode(spark, d):
    rows = ingest.flatten_observations(responses(spark, d))
    return rows.select("sensor", "code", "measure", F.unix_seconds("time").alias("at_second"), F.round("value", 6).alias("value"), "lat")


@query("""select 's' || user_id sensor, case when event_id % 13 = 0 then 'no geometry' when event_id % 10 = 0 then 'not a point: Line' else 'fewer than two coordinates' end reason
from events where event_id % 10 = 0 or event_id % 11 = 0 or event_id % 13 = 0""")
def observations_rejected(spark, d):
    return ingest.rejected_features(responses(spark, d))


@query("""select case when o_orderkey % 4 = 3 then 'another port' else 'no mmsi' end fault, count(*) n from orders where o_orderkey % 4 = 3 or o_orderkey % 11 = 0 group by 1""")
def visit_faults(spark, d):
    return ingest.visit_faults(K.visits(spark, d))


@query(f"""select user_id, case when l.event_id is null then 'right' when r.event_id is null then 'left' else 'both' end side, coalesce(l.value, 0) + coalesce(r.value, 0) total
from {K.EVEN} l full join {K.ODD} r using (user_id)""")
def relation_map2(spark, d):
    """Two relations under one function, absent sides included."""
    changes = K.log(spark, d)
    sides = [K.latest(K.parity(changes, k)).map(**{n: F.col("value")}) for k, n in ((0, "a"), (1, "b"))]
    made: Relation = sides[0].outer_join(sides[1])
    side: Column = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return made.df.select("user_id", side.alias("side"), (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("total"))
