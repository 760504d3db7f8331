"""Queries of vessels' and berths' further fields, lookups, messages, constants and the minimiser's single rewrites, each with
the SQL it must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.functions import location as L
from rulefold.functions import timeseries
from rulefold.functions.expr import const, named, record_field
from rulefold.functions.location import Z100
from rulefold.functions.units import LENGTH, metres
from rulefold.operators import streams
from rulefold.operators.relation import Relation, merge_changelogs
from rulefold.plans import catalog as K
from rulefold.plans import compile as C
from rulefold.plans import harbour as H
from rulefold.plans import minimise as M
from rulefold.plans import ruletable
from rulefold.plans.rules import INBOUND, Rule, berth, require, restrict, size, transform, vessel, walk, when, with_condition
from rulefold.session import shared_folder
from rulefold.sources import ingest

query = K.query

# Further fields


def named_vessels(spark: SparkSession, d: str) -> DataFrame:
    """Orders as vessels with name, mmsi and port call, bound for berths whose sizes differ."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = F.struct("vessel.*", F.concat(F.lit("ship "), k % 40).alias("name"), (k % 1000).cast("string").alias("mmsi"), F.concat(F.lit("call-"), k % 90).alias("portcall_id"))
    place = F.struct(F.col("berth.draught").alias("draught"), (120 + c % 200).cast("double").alias("length"), (15 + c % 40).cast("double").alias("width"))
    return K.vessels(spark, d).select("o_orderkey", "o_custkey", own.alias("vessel"), place.alias("berth"))


@query("""select o_orderkey, array_to_string(list_filter([case when not (bl >= len) then 'berth.length >= vessel.length' end, case when not (bw >= beam + 2) then 'berth.width >= vessel.beam + 2 m' end,
case when barred then 'false' end], lambda x: x is not null), ';') reasons
from (select o_orderkey, 50 + o_orderkey % 350 len, 10 + o_orderkey % 50 beam, 120 + o_custkey % 200 bl, 15 + o_custkey % 40 bw,
o_orderkey % 40 = 3 or o_orderkey % 1000 = 77 or o_orderkey % 90 = 5 barred from orders join customer on o_custkey = c_custkey)
where not (bl >= len) or not (bw >= beam + 2) or barred""")
def deny_events_names(spark, d):
    """Rules over name, mmsi, port call, and the berth's length and width."""
    barred = vessel.name.is_("ship 3") | vessel.mmsi.is_("77") | vessel.portcall_id.is_("call-5")
    rules = [require(berth.length >= vessel.length), require(berth.width >= vessel.beam + metres(2)), when(barred, require(const(False)))]
    return C.deny_events(named_vessels(spark, d), rules).select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


@query(f"""select k o_orderkey, beam < 40 small, round(draught * 1.1 + 0.5, 6) deep, ceil(len / 10) * 10 berth_length from {K._V}""")
def expression_map(spark, d):
    """Named functions of one expression, a named expression, and strictly less."""
    deep = named("deep", vessel.draught.map("grown", lambda x: x * F.lit(1.1).cast("double"), LENGTH) + metres(0.5))
    tens = vessel.length.map("tens", lambda x: F.ceil(x / 10) * 10, LENGTH)
    return K.vessels(spark, d).select("o_orderkey", (vessel.beam < metres(40)).column().alias("small"), F.round(deep.column(), 6).alias("deep"), tens.column().cast("double").alias("berth_length"))


_WHERE = Z100 / 6 / "any" + Z100 / 7 / 20 + Z100 / 2 / "any"


@query("""select o_orderkey, 'Z100/' || c_nationkey || case when c_nationkey in (2, 6) then '/any' else '/' || o_custkey end member
from orders join customer on o_custkey = c_custkey where c_nationkey in (2, 6) or c_nationkey = 7 and o_custkey = 20""")
def location_urns(spark, d):
    """Which member of a location a vessel is bound for, as text."""
    urns = F.array(*map(F.lit, _WHERE.urns()))
    bound = K.vessels(spark, d).filter(_WHERE.contains(F.col("vessel.destination"))).select("o_orderkey", F.col("vessel.destination").alias("to"), F.explode(urns).alias("member"))
    last = F.regexp_extract("member", r"/([^/]+)$", 1)
    inside = (L.section(F.col("to")) == F.regexp_extract("member", r"Z\d+/(\d+)/", 1).cast("bigint")) & ((last == "any") | (L.place(F.col("to")) == last.try_cast("bigint")))
    return bound.filter(inside).select("o_orderkey", "member")


@query("select user_id, count(*) n, round(sum(value * 2 + 1), 4) total, max(value * 2 + 1) highest from events where event_type = 'view' group by 1")
def series_map(spark, d):
    """Values of series under a function, a day of a user at a time."""
    events = K.table(spark, d, "events").filter("event_type = 'view'")
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_list(F.struct(F.col("ts").alias("time"), "value")).alias("s"))
    made = days.withColumn("s", timeseries.map_values(F.col("s"), lambda v: v * 2 + 1))
    total = F.aggregate("s", F.lit(0.0), lambda a, p: a + p["value"])
    return made.groupBy("user_id").agg(F.sum(F.size("s")).alias("n"), F.round(F.sum(total), 4).alias("total"), F.max(F.array_max(F.transform("s", lambda p: p["value"]))).alias("highest"))


# Relations


@query(f"""select coalesce(l.user_id, 3) user_id, l.value, r.note from {K.ALL} l full join (select 3 user_id, 'note' note) r on l.user_id = r.user_id""")
def relation_pure(spark, d):
    """One row of its own key beside a table; a relation without rows adds nothing."""
    table = K.latest(K.log(spark, d)).map(value=F.col("value"))
    one = Relation.pure(spark, "user_id bigint, note string", (3, "note"), ("user_id",))
    none = Relation.empty(spark, "user_id bigint, other string", ("user_id",))
    return table.outer_join(one).map(value=F.col("value"), note=F.col("note")).outer_join(none, "nothing").df.select("user_id", "value", "note")


@query(f"select user_id, value * 2 + 1 value from {K.ALL} where value * 2 > 30")
def relation_transform(spark, d):
    """Relation to relation functions, one after another."""
    steps = [lambda r: r.map(value=F.col("value") * 2), lambda r: r.filter(F.col("value") > 30), lambda r: r.map(value=F.col("value") + 1)]
    return K.latest(K.log(spark, d)).transform(*steps).df


@query("""select user_id, event_id from (select *, row_number() over (partition by user_id order by due desc, event_id desc) n from (
select user_id, event_id, ts due, 'U' op from events where event_type = 'view' union all select user_id, event_id, ts + interval 2 day, 'D' from events where event_type = 'error')) where n = 1 and op = 'U'""")
def merged_logs(spark, d):
    """Two logs with times of their own: upserts, and deletes that take effect two days later."""
    events = K.table(spark, d, "events")
    views = events.filter("event_type = 'view'").select("user_id", "event_id", F.col("ts").alias("at"), F.lit("U").alias("op"))
    errors = events.filter("event_type = 'error'").select("user_id", "event_id", (F.col("ts") + F.expr("interval 2 days")).alias("at"), F.lit("D").alias("op"))
    return Relation.from_changelog(merge_changelogs(views, errors), ["user_id"], ["at", "event_id"]).df.select("user_id", "event_id")


@query(K._case("draught <= 12", "vessel.draught <= 12 m"))
def rule_constants(spark, d):
    """A condition that is always true stands for its body, one that never is for nothing."""
    return K.results(K.vessels(spark, d), when(const(True), require(vessel.draught <= metres(12))), when(const(False), require(const(False))))


# Lookups, vessels and berths


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Identity lookups: events as answers, several for an identity."""
    events = K.table(spark, d, "events")
    return events.select(F.col("user_id").cast("string").alias("mmsi"), F.concat(F.lit("C"), "event_id").alias("callSign"), F.col("value").alias("maxDraught"), F.col("event_id").alias("timeLastUpdate"))


@query(f"""select o_orderkey, value draught, 'C' || event_id call_sign from orders join (select user_id, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) n from events) where n = 1)
on o_orderkey % 400 = user_id""")
def visits_draught(spark, d):
    """The latest answer for each vessel's identity; vessels without one are not followed."""
    vessels = K.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 400).cast("string").alias("mmsi"))
    return ingest.with_draught(vessels, _answers(spark, d)).select("o_orderkey", "draught", "call_sign")


@query(f"select k o_orderkey, dir direction from {K._V} where timestamp '2024-01-01' + to_minutes(k % 43200) >= timestamp '2024-01-08 12:00:00'")
def vessels_active(spark, d):
    rows = K.vessels(spark, d).select("o_orderkey", "vessel.time", "vessel.direction")
    return ingest.active(Relation(rows, ("o_orderkey",)), F.lit("2024-01-08 12:00:00").cast("timestamp")).df.select("o_orderkey", "direction")


@query("select 'b' || c_custkey urn, c_acctbal length from customer where c_custkey % 4 <> 3 and c_custkey % 6 <> 5")
def berths_folded(spark, d):
    """Berths from messages: each has two versions, some messages are of another kind, some do not parse."""
    c = F.col("c_custkey")
    customers = K.table(spark, d, "customer")
    body = lambda length: F.to_json(F.struct(F.when(c % 6 != 5, F.concat(F.lit("b"), c)).alias("urn"), F.when(c % 4 != 3, "Berth").otherwise("Buoy").alias("type"), length.alias("length")))
    messages = customers.select(F.when(c % 3 == 0, "{broken").otherwise(body(F.lit(1.0))).alias("value"), c.alias("seq")).unionByName(customers.select(body(F.col("c_acctbal")).alias("value"), (c + 10**9).alias("seq")))
    return ingest.berths(messages, "urn string, type string, length double").df.select("urn", "length")


@query(K.ORACLE["rule_csv_limits"] if "rule_csv_limits" in K.ORACLE else None)
def rule_csv_source(spark, d):
    """The rule table written as a file with `;` between cells, and read again."""
    path = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    cells = H.rule_cells(spark, d)
    # a file has no column for the part: it travels in one that no rule looks at
    cells.withColumn("POLICY_REMARKS", F.col("p_partkey").cast("string")).select(*ruletable.COLUMNS).write.csv(path, sep=";", header=True)
    made = ruletable.limits(ruletable.read(spark, path), keep=["POLICY_REMARKS"]).filter("kind is not null").drop("fault")
    return made.withColumn("p_partkey", F.col("POLICY_REMARKS").cast("bigint")).drop("POLICY_REMARKS")


_SAME = "(a.{0} is null or a.{0} is not distinct from b.{0})"


@query(f"""with s as materialized (select distinct section, place, "type" t, both_ways, draught_from f, draught_to u, kind, case when kind not in ('forbidden', 'allowed') then bound end bound
from ({K.ORACLE["strictest_limits"]}) where draught_from is null or draught_to is null or draught_from < draught_to)
select section, place, t "type", both_ways, f draught_from, u draught_to, kind, bound from s b where not exists (select 1 from s a where
{_SAME.format("section")} and {_SAME.format("place")} and {_SAME.format("t")} and (not a.both_ways or b.both_ways) and coalesce(a.f, -1e9) <= coalesce(b.f, -1e9) and coalesce(a.u, 1e9) >= coalesce(b.u, 1e9)
and (a.kind = 'forbidden' and b.kind <> 'allowed' or a.kind = b.kind and case when a.kind in ('max_beam', 'max_length') then a.bound <= b.bound when a.kind in ('min_length', 'ukc') then a.bound >= b.bound
when a.kind = 'fresh_water' then a.bound = b.bound else true end)
and (a.section, a.place, a.t, a.both_ways, a.f, a.u, a.kind, a.bound) is distinct from (b.section, b.place, b.t, b.both_ways, b.f, b.u, b.kind, b.bound))""")
def minimal_limits(spark, d):
    return ruletable.minimal(ruletable.limits(ruletable.typed(H.rule_cells(spark, d))))


# Single rewrites: the rewritten rules deny what the original ones do


def _denied(spark: SparkSession, d: str, rules: list[Rule] | None, fewer_than: list[Rule]) -> DataFrame:
    """Vessels that the rules deny; a rewrite that does not apply, or does not shorten, is an error."""
    if not rules or sum(map(size, rules)) >= sum(map(size, fewer_than)):
        raise ValueError("the rewrite did not apply")
    return C.deny_events(K.vessels(spark, d), rules).select("o_orderkey")


def _where(condition: str) -> str:
    return f"select k o_orderkey from {K._V} where {condition}"


_WIDE, _LONG = require(vessel.beam <= metres(40)), require(vessel.length <= metres(250))


@query(_where("(section = 6 or draught >= 12) and beam > 40"))
def rewrite_merge_when(spark, d):
    a, b = when(vessel.draught >= metres(12), _WIDE), when(vessel.direction.is_(INBOUND) & const(False), _WIDE)
    rules = [a, b, restrict(Z100 / 6 / "any", _WIDE)]
    return _denied(spark, d, [*M.merge_when(a, b), rules[2]], rules)


@query(_where("not draught < 12"))
def rewrite_shorten_when(spark, d):
    rule = when(vessel.draught >= metres(12), require(const(False)))
    return _denied(spark, d, [M.shorten_when(rule)], [rule])


@query(_where("beam > 40"))
def rewrite_remove_duplicate(spark, d):
    rules = [_WIDE, require(vessel.beam <= metres(40))]
    return _denied(spark, d, M.remove_duplicate(*rules), rules)


@query(_where("section = 6 and len > 250"))
def rewrite_remove_tautology(spark, d):
    rule = restrict(Z100 / 6 / "any", require(const(True)), _LONG)
    return _denied(spark, d, [M.remove_tautology(rule)], [rule])


@query(_where("draught >= 12 and beam > 30 or beam > 40"))
def rewrite_merge_implied(spark, d):
    rules = [when(vessel.draught >= metres(12), require(vessel.beam <= metres(30))), when(vessel.draught < metres(12), _WIDE)]
    made = M.merge_implied(*rules)
    if not made or size(made[0]) != 1:
        raise ValueError("the rewrite did not apply")
    return C.deny_events(K.vessels(spark, d), made).select("o_orderkey")


@query(f"select k o_orderkey from {K._V} where fk % 10 <> 0 and fk % 4 = 2 and not (bd >= 1.02 * (draught + 0.5))")
def rewrite_fresh_water(spark, d):
    """The allowance of a berth is applied to its depth, instead of compared."""
    rules = [require(ruletable.fresh_water_allowance.is_(2.0)), require(ruletable.contract_depth >= vessel.draught + metres(0.5))]
    made = M.merge_fresh_water(*rules)
    c = F.col("o_custkey")
    place = F.when((c % 10 != 0) & (c % 4 == 2), F.struct(F.col("berth.draught").alias("contract_depth"), F.lit(2.0).alias("fresh_water_allowance")))
    rows = K.vessels(spark, d).withColumn("berth", place)
    return C.deny_events(rows, made).select("o_orderkey")


# Distances and many sensors


def _geodesic_sql(points: str) -> str:
    """Vincenty's inverse formula over (id, x1, y1, x2, y2), its iteration written out step by step."""
    f, b = L.FLATTENING, L.AXIS * (1 - L.FLATTENING)
    arc = "sqrt(pow(cv * sin(x), 2) + pow(cu * sv - su * cv * cos(x), 2)) s, su * sv + cu * cv * cos(x) c"
    rows = f"(select *, sin(u) su, cos(u) cu, sin(v) sv, cos(v) cv, l x from (select id, atan({1 - f} * tan(radians(y1))) u, atan({1 - f} * tan(radians(y2))) v, radians(x2 - x1) l from {points}))"
    for _ in range(8):
        rows = f"(select *, {arc} from {rows})"
        rows = f"(select *, case when s = 0 then 0 else cu * cv * sin(x) / s end a from {rows})"
        rows = f"(select *, 1 - a * a q, case when 1 - a * a > 1e-15 then c - 2 * su * sv / (1 - a * a) else 0 end m, atan2(s, c) g from {rows})"
        rows = f"(select *, {f} / 16 * q * (4 + {f} * (4 - 3 * q)) k from {rows})"
        rows = f"(select * exclude (x, s, c, a, q, m, g, k), l + (1 - k) * {f} * a * (g + k * s * (m + k * c * (2 * m * m - 1))) x from {rows})"
    rows = f"(select *, {arc} from {rows})"
    rows = f"(select *, case when s = 0 then 0 else cu * cv * sin(x) / s end a from {rows})"
    rows = f"(select *, (1 - a * a) * {(L.AXIS**2 - b**2) / b**2} w, case when 1 - a * a > 1e-15 then c - 2 * su * sv / (1 - a * a) else 0 end m, atan2(s, c) g from {rows})"
    rows = f"(select *, 1 + w / 16384 * (4096 + w * (w * (320 - 175 * w) - 768)) big, w / 1024 * (256 + w * (w * (74 - 47 * w) - 128)) small from {rows})"
    return f"(select id, {b} * big * (g - small * s * (m + small / 4 * (c * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))) metres from {rows})"


@query(f"""select id c_custkey, round(metres, 3) metres from {_geodesic_sql("(select c_custkey id, 3.0 + (c_custkey % 150) * 0.01::double x1, -80.0 + c_custkey % 161 y1, 3.0 + c_nationkey * 0.6::double x2, -50.0 + c_nationkey * 4 y2 from customer)")}""")
def geodesic_distances(spark, d):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    there = [F.lit(3.0) + (c % 150) * F.lit(0.01).cast("double"), (c % 161).cast("double") - 80, F.lit(3.0) + n * F.lit(0.6).cast("double"), n * 4.0 - 50]
    return K.table(spark, d, "customer").select("c_custkey", F.round(L.geodesic(*(x.cast("double") for x in there)), 3).alias("metres"))


_PARTS = """(select p_partkey sensor, p_partkey ord, case when p_size % 3 = 0 then 3.0 + (p_partkey * 7919 % 997) * 0.003::double else -180.0 + (p_partkey * 104729 % 36000) * 0.01::double end lon,
case when p_size % 3 = 0 then 51.0 + (p_partkey * 6151 % 991) * 0.002::double else -89.5 + (p_partkey * 15485863 % 17900) * 0.01::double end lat from part)"""


@query(f"""select c_custkey, sensor from (select c_custkey, s.sensor, row_number() over (partition by c_custkey order by
2 * 6371008.8 * asin(sqrt(pow(sin(radians(s.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - b.lon) / 2), 2))), ord) rn
from (select c_custkey, case when c_custkey % 3 = 0 then -180.0 + (c_custkey * 7 % 360) else 3.0::double + (c_custkey % 150) * 0.01::double end lon,
case when c_custkey % 3 = 0 then -90.0 + (c_custkey * 11 % 181) else 51.4::double + (c_custkey % 60) * 0.01::double end lat from customer) b, {_PARTS} s) where rn = 1""")
def nearest_of_many_sensors(spark, d):
    """A third of the sensors near one port, the others all over the world, and berths in both."""
    c, p = F.col("c_custkey"), F.col("p_partkey")
    lon = F.when(c % 3 == 0, F.lit(-180.0) + (c * 7) % 360).otherwise(F.lit(3.0) + (c % 150) * F.lit(0.01).cast("double"))
    lat = F.when(c % 3 == 0, F.lit(-90.0) + (c * 11) % 181).otherwise(F.lit(51.4).cast("double") + (c % 60) * F.lit(0.01).cast("double"))
    near = F.col("p_size") % 3 == 0
    cell = lambda a, n, step, low: F.lit(low).cast("double") + ((p * a) % n) * F.lit(step).cast("double")
    sensors = K.table(spark, d, "part").select(
        p.alias("sensor"), p.alias("ord"), F.when(near, cell(7919, 997, 0.003, 3.0)).otherwise(cell(104729, 36000, 0.01, -180.0)).alias("lon"),
        F.when(near, cell(6151, 991, 0.002, 51.0)).otherwise(cell(15485863, 17900, 0.01, -89.5)).alias("lat"),
    )
    return L.nearest_sensor(K.table(spark, d, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat")), sensors, "c_custkey")


_METRES = "(200000 + event_id % 1000 * 100)::double"


@query(f"""select event_id, case event_id % 4 when 0 then null else 'found' end state,
round(case event_id % 4 when 1 then degrees({_METRES} / 6378137.0) when 2 then 3.0 when 3 then 4.5 end, 9) lon,
round(case event_id % 4 when 1 then degrees(2 * atan(exp(6000000.0 / 6378137.0)) - pi() / 2) when 2 then 0.0 when 3 then 51.5 end, 9) lat from events""")
def observations_projected(spark, d):
    """Positions in several reference systems as longitude and latitude; those in an unknown one are told apart."""
    n = F.col("event_id")
    kind = n % 4
    x = F.when(kind == 1, (200_000 + n % 1000 * 100).cast("double")).when(kind == 2, 500_000.0).when(kind == 3, 4.5).otherwise(1.0)
    y = F.when(kind == 1, 6_000_000.0).when(kind == 2, 0.0).when(kind == 3, 51.5).otherwise(1.0)
    code = F.when(kind == 1, "3857").when(kind == 2, "32631").when(kind == 3, "4326").otherwise("1")
    place = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"), F.struct(code.alias("wkid")).alias("spatialReference"))
    result = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("phenomenonTime"), F.array(F.struct(F.lit("H10").alias("name"), F.col("value"))).alias("parameters"))
    observation = F.struct(F.struct(n.cast("string").alias("id"), place.alias("geometry")).alias("featureOfInterest"), F.array(result).alias("result"))
    body = F.to_json(F.struct(F.struct(F.array(observation).alias("observations")).alias("_embedded")))
    sent = K.table(spark, d, "events").select(F.from_json(body, ingest.OBSERVATIONS).alias("r")).select("r.*")
    found = ingest.flatten_observations(sent).select(F.col("sensor").cast("bigint").alias("event_id"), F.lit("found").alias("state"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))
    lost = ingest.rejected_features(sent).filter("reason = 'no position in EPSG:1'").select(F.col("sensor").cast("bigint").alias("event_id"))
    none = F.lit(None).cast("double")
    return found.unionByName(lost.select("event_id", F.lit(None).cast("string").alias("state"), none.alias("lon"), none.alias("lat")))


# Streams in rules, sequences, trees


@query(f"""select k o_orderkey, 'vessel.draught <= notice.depth' reasons from {K._V}, (select 5 + value / 10 depth from events where event_type = 'purchase' order by ts desc, event_id desc limit 1)
where not (draught <= depth)""")
def rule_stream_value(spark, d):
    """A rule over the latest element of a stream, beside the vessel: a relation with a stream."""
    notices = K.table(spark, d, "events").filter("event_type = 'purchase'").select("ts", "event_id", (5 + F.col("value") / 10).alias("depth"))
    rows = Relation(K.vessels(spark, d).select("o_orderkey", "vessel"), ("o_orderkey",)).zip_latest(notices, ["ts", "event_id"])
    notice = rows.df.select("o_orderkey", "vessel", F.struct("depth").alias("notice"))
    rule = require(vessel.draught <= record_field("notice", "depth", LENGTH))
    return C.deny_events(notice, [rule]).select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


@query("""select user_id, event_id, step from events join (values ('view', 0), ('click', 1), ('purchase', 2)) s(event_type, step) using (event_type)
qualify row_number() over (partition by user_id order by step desc, ts, event_id) = 1""")
def sequence_steps(spark, d):
    """Each user's first event of the furthest step of a sequence; a stream without elements adds none."""
    steps = streams.from_sequence(spark, [("view",), ("click",), ("purchase",)], "event_type string", "step")
    events = streams.merge(K.table(spark, d, "events"), streams.never(K.table(spark, d, "events")))
    reached = events.join(F.broadcast(steps), "event_type").select("user_id", "event_id", "step", "ts")
    furthest = reached.groupBy("user_id").agg(F.min_by(F.struct("event_id", "step"), F.struct(-F.col("step"), "ts", "event_id")).alias("e"))
    return furthest.select("user_id", "e.event_id", F.col("e.step").cast("int").alias("step"))


@query(_where("section in (6, 7) and (len > 200 or draught >= 12 and beam > 60) or draught >= 12 and beam > 60"))
def rule_tree_map(spark, d):
    """A tree under a function of every statement: what limits beams is doubled, what looks at names goes."""
    barred = when(vessel.name.is_("none"), require(const(False)))
    tree = restrict(Z100 / 6 / "any" + Z100 / 7 / "any", barred, require(vessel.length <= metres(200)), when(vessel.draught >= metres(12), require(vessel.beam <= metres(30)), barred))
    deep = when(vessel.draught >= metres(12), require(vessel.beam <= metres(30)))

    def change(rule: Rule) -> Rule | None:
        condition = getattr(rule, "condition", None)
        if condition is not None and condition.op == "is":
            return None
        if condition is not None and condition.op == "<=" and condition.args[0].same(vessel.beam):
            return with_condition(rule, vessel.beam <= 2 * condition.args[1])
        return rule

    rules = [transform(r, change) for r in (tree, deep)]
    if sum(1 for r in rules for _ in walk(r)) != 6:
        raise ValueError("the tree has another shape")
    return C.deny_events(K.vessels(spark, d), rules).select("o_orderkey")
