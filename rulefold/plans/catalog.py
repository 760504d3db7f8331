"""Queries over the driver's tables, each with the SQL it must agree with.

Stand-ins: events are changes of a table keyed by user (an 'error' deletes), orders are vessels, customers are berths,
nations are sensors, parts are rule-table rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.functions import location as L
from rulefold.functions import timeseries
from rulefold.functions.expr import apply, const
from rulefold.functions.location import Z100
from rulefold.functions.units import LENGTH, degrees, knots, metres, metres_per_second, seconds
from rulefold.operators import streams
from rulefold.operators.relation import Relation, merge_changelogs
from rulefold.plans import compile as C
from rulefold.plans import ruletable
from rulefold.plans.minimise import minimise
from rulefold.plans.rules import INBOUND, OUTBOUND, Rule, berth, require, restrict, vessel, when, wind
from rulefold.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ORDER = ["ts", "event_id"]


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", op, "event_type", "value")


def latest(changes: DataFrame) -> Relation:
    return Relation.from_changelog(changes, ["user_id"], ORDER)


def parity(changes: DataFrame, rest: int) -> DataFrame:
    return changes.filter(F.col("event_id") % 2 == rest)


_LATEST = """(select user_id, event_id, event_type, value, ts from (select *, row_number() over (partition by user_id
order by ts desc, event_id desc) rn from events where {0}) where rn = 1 and event_type <> 'error')"""
ALL, EVEN, ODD = (_LATEST.format(x) for x in ("true", "event_id % 2 = 0", "event_id % 2 = 1"))


# Relations


@query(f"select user_id, event_id, event_type, value from {ALL}")
def table_latest(spark, d):
    return latest(log(spark, d)).df.select("user_id", "event_id", "event_type", "value")


@query(f"select user_id, value * 2 doubled, event_id + 1 following from {ALL}")
def relation_map(spark, d):
    return latest(log(spark, d)).map(doubled=F.col("value") * 2, following=F.col("event_id") + 1).df


@query(f"select user_id, event_id, value from {ALL} where value > 20")
def relation_filter(spark, d):
    return latest(log(spark, d)).filter(F.col("value") > 20).df.select("user_id", "event_id", "value")


@query("""select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn
from events where value > 20) where rn = 1 and event_type <> 'error'""")
def stream_filter_then_table(spark, d):
    return latest(log(spark, d).filter(F.col("value") > 20)).df.select("user_id", "event_id", "value")


@query(f"select l.user_id, l.value left_value, r.value right_value from {EVEN} l join {ODD} r using (user_id)")
def relation_inner_join(spark, d):
    changes = log(spark, d)
    return latest(parity(changes, 0)).map(left_value=F.col("value")).join(latest(parity(changes, 1)).map(right_value=F.col("value"))).df


@query(f"""select user_id, l.value left_value, r.value right_value, case when r.event_id is null then 'left'
when l.event_id is null then 'right' else 'both' end side from {EVEN} l full join {ODD} r using (user_id)""")
def relation_outer_join(spark, d):
    changes = log(spark, d)
    return latest(parity(changes, 0)).map(left_value=F.col("value")).outer_join(latest(parity(changes, 1)).map(right_value=F.col("value"))).df


@query("select o_orderkey, o_custkey, c_acctbal, c_nationkey from orders join customer on o_custkey = c_custkey")
def fk_join(spark, d):
    orders = Relation(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ("o_orderkey",))
    customers = Relation(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ("c_custkey",))
    return orders.join_foreign(customers, "o_custkey").df


@query(f"""select user_id, value, last_id, last_value from {ALL}, (select event_id last_id, value last_value from events
where event_type = 'purchase' order by ts desc, event_id desc limit 1)""")
def zip_latest(spark, d):
    stream = table(spark, d, "events").filter("event_type = 'purchase'").select("ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return latest(log(spark, d)).map(value=F.col("value")).zip_latest(stream, ["ts", "last_id"]).df.drop("ts")


@query("select event_id, 'v' kind from events where event_type = 'view' union all select event_id, 'c' from events where event_type = 'click'")
def merge_streams(spark, d):
    events = table(spark, d, "events")
    sides = [events.filter(F.col("event_type") == t).select("event_id", F.lit(k).alias("kind")) for t, k in (("view", "v"), ("click", "c"))]
    return streams.merge(*sides)


@query(f"select user_id, event_id from {ALL}")
def merge_relations(spark, d):
    changes = log(spark, d)
    return latest(merge_changelogs(parity(changes, 1), parity(changes, 0))).df.select("user_id", "event_id")


@query(f"""select user_id, case when l.event_id is null then r.value when r.event_id is null then l.value else l.value + r.value end total
from {EVEN} l full join {ODD} r using (user_id)""")
def combine_relations(spark, d):
    changes = log(spark, d)
    sides = [latest(parity(changes, k)).map(total=F.col("value")) for k in (0, 1)]
    return sides[0].combine(sides[1], lambda a, b: a + b).df


@query("select p_partkey, unnest(string_split(p_name, ' ')) word from part")
def map_concat(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return streams.map_concat(parts, "word", F.split("p_name", " ")).select("p_partkey", "word")


@query("""select user_id, event_id, v view_value, c click_value from (select user_id, event_id,
last_value(case when event_type = 'view' then value end ignore nulls) over w v,
last_value(case when event_type = 'click' then value end ignore nulls) over w c
from events where event_type in ('view', 'click') window w as (partition by user_id order by ts, event_id)) where v is not null and c is not null""")
def combine_latest(spark, d):
    events = table(spark, d, "events")
    view, click = (events.filter(F.col("event_type") == t).withColumnRenamed("value", f"{t}_value") for t in ("view", "click"))
    return streams.combine_latest(view, click, ORDER, "view_value", "click_value", ["user_id"]).drop("ts")


@query("""select e.user_id, e.event_id, c.event_type, c.value from (select * from events where event_type = 'purchase') e
asof join (select *, event_id cid from events where event_type <> 'purchase') c on e.user_id = c.user_id and e.ts >= c.ts where c.event_type <> 'error'""")
def lookup_asof(spark, d):
    changes = log(spark, d)
    elements = changes.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("event_id").alias("element"))
    table_log = changes.filter("event_type <> 'purchase'")
    found = streams.lookup_asof(elements, table_log, ["user_id"], ORDER)
    return found.select("user_id", F.col("element").alias("event_id"), "event_type", "value")


_CUT = "timestamp '2024-01-15 00:00:00'"
OLD = _LATEST.format(f"ts < {_CUT}")


@query(f"""select user_id, case when n.event_id is null then 'D' else 'U' end op, n.value from {OLD} o full join {ALL} n using (user_id)
where o.event_id is null or n.event_id is null or o.value is distinct from n.value""")
def changelog_diff(spark, d):
    changes = log(spark, d)
    old, new = (latest(c).map(value=F.col("value")) for c in (changes.filter(F.col("ts") < F.expr("timestamp_ntz '2024-01-15 00:00:00'")), changes))
    return old.changes_to(new)


@query(f"select user_id, event_id from {ALL}")
def changelog_round_trip(spark, d):
    again = latest(log(spark, d)).changelog()
    return latest(again).df.select("user_id", "event_id")


# Locations


def berth_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("urn:x:Z100/"), "c_nationkey", F.lit("/"), "c_custkey").alias("urn"))


def located(spark: SparkSession, d: str, where: L.Location) -> DataFrame:
    return berth_names(spark, d).filter(where.contains(F.col("urn"))).select("c_custkey", "urn")


_NAMED = "(select c_custkey, 'urn:x:Z100/' || c_nationkey || '/' || c_custkey urn from customer)"


@query(f"select * from {_NAMED} where try_cast(regexp_extract(urn, 'Z100/(\\d+)/(\\d+)$', 1) as bigint) = 6")
def location_section(spark, d):
    return located(spark, d, Z100 / 6 / "any")


@query(f"select * from {_NAMED} where regexp_extract(urn, 'Z100/(\\d+)/(\\d+)$', 1) = '7' or urn in ('urn:x:Z100/2/0', 'urn:x:Z100/19/1')")
def location_set(spark, d):
    return located(spark, d, Z100 / 7 / "any" + Z100 / 2 / 0 + Z100 / 19 / 1)


@query(f"select * from {_NAMED}")
def location_any(spark, d):
    return located(spark, d, L.anywhere)


def berth_places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    there = k % 7 != 0
    lon, lat = F.lit(3.0) + (k % 150) * F.lit(0.01).cast("double"), F.lit(51.4).cast("double") + (k % 60) * F.lit(0.01).cast("double")
    return table(spark, d, "customer").select("c_custkey", F.when(there, lon).alias("lon"), F.when(there, lat).alias("lat"))


def sensors(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        n.cast("bigint").alias("sensor"), (F.lit(3.0) + n * F.lit(0.06).cast("double")).alias("lon"),
        (F.lit(51.4).cast("double") + ((n * 7) % 25) * F.lit(0.025).cast("double")).alias("lat"), n.alias("ord"),
    )


_NEAREST = """(select c_custkey, sensor from (select c_custkey, s.sensor, row_number() over (partition by c_custkey order by
2 * 6371008.8 * asin(sqrt(pow(sin(radians(s.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - b.lon) / 2), 2))), ord) rn
from (select c_custkey, 3.0::double + (c_custkey % 150) * 0.01::double lon, 51.4::double + (c_custkey % 60) * 0.01::double lat from customer where c_custkey % 7 <> 0) b,
(select n_nationkey::bigint sensor, n_nationkey ord, 3.0::double + n_nationkey * 0.06::double lon, 51.4::double + ((n_nationkey * 7) % 25) * 0.025::double lat from nation) s) where rn = 1)"""


@query(f"select c_custkey, sensor from {_NEAREST}")
def nearest_sensor(spark, d):
    return L.nearest_sensor(berth_places(spark, d), sensors(spark, d), "c_custkey")


# Time series


def series(spark: SparkSession, d: str, kind: str, key: Column) -> DataFrame:
    events = table(spark, d, "events").filter(F.col("event_type") == kind)
    return events.select(key.alias("k"), F.col("ts").alias("time"), "value", "event_id")


def _asof(queries: str, points: str, name: str) -> str:
    """SQL for the prediction of `name` from points (k, t, v) for queries (k, t, ...)."""
    gap = "(abs(epoch_us(q.t) - epoch_us({0}.t)) // 60000000)"
    a, b = gap.format("a"), gap.format("b")
    return f"""(select q.*, case when a.t < q.t and q.t < b.t then a.v + (b.v - a.v) / nullif(cast(floor(epoch(b.t)) - floor(epoch(a.t)) as double), 0) * (floor(epoch(q.t)) - floor(epoch(a.t)))
when {a} <= 60 and (b.t is null or {a} <= {b}) then a.v when {b} <= 60 then b.v end {name}
from {queries} q asof left join {points} a on q.k = a.k and q.t >= a.t asof left join {points} b on q.k = b.k and q.t < b.t)"""


def _points(kind: str, key: str) -> str:
    return f"(select {key} k, ts t, arg_max(value, event_id) v from events where event_type = '{kind}' group by 1, 2)"


_PURCHASES = "(select user_id k, ts t, event_id id from events where event_type = 'purchase')"


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.col("ts").alias("time"), F.col("event_id").alias("id"))


@query(f"select id, k user_id, round(p, 6) predicted from {_asof(_PURCHASES, _points('view', 'user_id'), 'p')}")
def interpolate_linear(spark, d):
    made = timeseries.interpolate(_purchases(spark, d), series(spark, d, "view", F.col("user_id")), "k", tie=["event_id"])
    return made.select("id", F.col("k").alias("user_id"), F.round("value", 6).alias("predicted"))


_LATE = "(select user_id k, ts + interval 45 minute t, event_id id from events where ts >= timestamp '2024-01-29 12:00:00')"


@query(f"select id, round(p, 6) predicted from {_asof(_LATE, _points('view', 'user_id'), 'p')} where p is not null")
def interpolate_fallback(spark, d):
    events = table(spark, d, "events").filter(F.col("ts") >= F.expr("timestamp_ntz '2024-01-29 12:00:00'"))
    asked = events.select(F.col("user_id").alias("k"), (F.col("ts") + F.expr("interval 45 minutes")).alias("time"), F.col("event_id").alias("id"))
    made = timeseries.interpolate(asked, series(spark, d, "view", F.col("user_id")), "k", tie=["event_id"])
    return made.filter("value is not null").select("id", F.round("value", 6).alias("predicted"))


_BOTH = _asof(_asof(_PURCHASES, _points("view", "user_id"), "x"), _points("click", "user_id"), "y")


@query(f"select id, round(x, 6) x, round(y, 6) y from {_BOTH} where x is not null and y is not null")
def interpolate_record(spark, d):
    fields = {name: series(spark, d, kind, F.col("user_id")) for name, kind in (("x", "view"), ("y", "click"))}
    rows = timeseries.interpolate_fields(_purchases(spark, d), fields, "k", tie=["event_id"])
    return rows.filter("x is not null and y is not null").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("select user_id, count(*) n, min(event_id) first_id from events where event_type = 'view' and ts > timestamp '2024-01-20 00:00:00' group by 1")
def series_trim(spark, d):
    events = table(spark, d, "events").filter("event_type = 'view'")
    # arrays hold one user's points of a day, so that no key's array grows without bound
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("time"), F.col("event_id").alias("value")))).alias("s"))
    kept = days.withColumn("s", timeseries.remove_before(F.col("s"), F.expr("timestamp_ntz '2024-01-20 00:00:00'"))).filter(F.size("s") > 0)
    least = F.array_min(F.transform("s", lambda p: p["value"]))
    return kept.groupBy("user_id").agg(F.sum(F.size("s")).alias("n"), F.min(least).alias("first_id"))


# Expressions


def _kind(status: Column) -> Column:
    return F.when(status == "O", INBOUND).when(status == "F", OUTBOUND)


def bound(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, o_custkey, vessel): orders with the customer they are bound for."""
    k = F.col("o_orderkey")
    urn = F.concat(F.lit("urn:x:Z100/"), "c_nationkey", F.lit("/"), "o_custkey")
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    rows = orders.join(customers.select("c_custkey", "c_nationkey"), orders["o_custkey"] == customers["c_custkey"])
    record = F.struct(
        (F.col("o_totalprice") / 25000).alias("draught"), (50 + k % 350).cast("double").alias("length"), (10 + k % 50).cast("double").alias("beam"),
        _kind(F.col("o_orderstatus")).alias("direction"), F.element_at(F.split("o_orderpriority", "-"), 1).alias("type"),
        (F.expr("timestamp '2024-01-01 00:00:00'") + F.make_dt_interval(mins=(k % 43200).cast("int"))).alias("time"), urn.alias("destination"),
    )
    return rows.select("o_orderkey", "o_custkey", record.alias("vessel"))


def vessels(spark: SparkSession, d: str, absent_berths: bool = False) -> DataFrame:
    """(o_orderkey, o_custkey, vessel, berth)."""
    rows, customers = bound(spark, d), table(spark, d, "customer")
    berths = customers.select("c_custkey", (5 + F.col("c_acctbal") / 1000).alias("draught"), F.lit(300.0).alias("length"), F.lit(40.0).alias("width"))
    return C.with_berth(rows, berths.filter("c_custkey % 10 <> 0") if absent_berths else berths, "o_custkey", "c_custkey")


_V = """(select o_orderkey k, o_custkey fk, o_totalprice / 25000 draught, (50 + o_orderkey % 350)::double len, (10 + o_orderkey % 50)::double beam,
case o_orderstatus when 'O' then 'Inbound' when 'F' then 'Outbound' end dir, c_nationkey section, split_part(o_orderpriority, '-', 1) typ,
5 + c_acctbal / 1000 bd from orders join customer on o_custkey = c_custkey)"""


@query(f"""select k o_orderkey, round(draught + beam, 6) plus, round(draught - beam, 6) minus, round(-draught, 6) negated, round(abs(draught - beam), 6) absolute,
sign(draught - beam)::integer sgn, case when draught < bd then -1 when draught > bd then 1 else 0 end cmp, draught <= bd and beam > 20 both_hold,
draught <= bd or beam > 20 either, not (beam >= 30) negation from {_V}""")
def scalar_ops(spark, d):
    v = vessels(spark, d)
    e = {
        "plus": F.round((vessel.draught + vessel.beam).column(), 6), "minus": F.round((vessel.draught - vessel.beam).column(), 6),
        "negated": F.round((-vessel.draught).column(), 6), "absolute": F.round(abs(vessel.draught - vessel.beam).column(), 6),
        "sgn": (vessel.draught - vessel.beam).signum().column(), "cmp": vessel.draught.compare(berth.draught).column(),
        "both_hold": ((vessel.draught <= berth.draught) & (vessel.beam > metres(20))).column(),
        "either": ((vessel.draught <= berth.draught) | (vessel.beam > metres(20))).column(), "negation": (~(vessel.beam >= metres(30))).column(),
    }
    return v.select("o_orderkey", *(c.alias(n) for n, c in e.items()))


@query(f"select k o_orderkey, round(len / (10.0 * 1852 / 3600), 6) transit_s, round(len / beam, 6) ratio, round(len / nullif(beam - 10, 0), 6) safe, round(beam * 2, 6) twice from {_V}")
def unit_ratio(spark, d):
    e = {"transit_s": vessel.length / knots(10), "ratio": vessel.length / vessel.beam, "safe": vessel.length / (vessel.beam - metres(10)), "twice": (vessel.beam / const(seconds(1))) * seconds(2)}
    return vessels(spark, d).select("o_orderkey", *(F.round(x.column(), 6).alias(n) for n, x in e.items()))


# Rules


def results(v: DataFrame, *rules: Rule) -> DataFrame:
    return C.evaluate(v, rules).select("o_orderkey", "allow", F.array_join("reasons", ";").alias("reasons"))


def _case(condition: str, text: str, source: str = _V, where: str = "true") -> str:
    return f"select k o_orderkey, {condition} allow, case when {condition} then '' else '{text}' end reasons from {source} where {where}"


@query(_case("draught <= 12", "vessel.draught <= 12 m"))
def rule_require(spark, d):
    return results(vessels(spark, d), require(vessel.draught <= metres(12)))


@query(_case("len <= 200", "vessel.length <= 200 m", where="beam > 30"))
def rule_when(spark, d):
    return results(vessels(spark, d), when(vessel.beam > metres(30), require(vessel.length <= metres(200))))


@query(_case("draught <= bd", "vessel.draught <= berth.draught", where="dir in ('Inbound', 'Outbound')"))
def rule_or(spark, d):
    either = vessel.direction.is_(INBOUND) | vessel.direction.is_(OUTBOUND)
    return results(vessels(spark, d), when(either, require(vessel.draught <= berth.draught)))


@query(f"""select o_orderkey, bool_and(allow) allow, coalesce(string_agg(case when not allow then reason end, ';' order by i), '') reasons from (
select k o_orderkey, len <= 200 allow, 'vessel.length <= 200 m' reason, 1 i from {_V} where beam > 30
union all select k, draught <= 12, 'vessel.draught <= 12 m', 2 from {_V} where section = 6) group by 1""")
def rule_siblings(spark, d):
    rules = when(vessel.beam > metres(30), require(vessel.length <= metres(200))), restrict(Z100 / 6 / "any", require(vessel.draught <= metres(12)))
    return results(vessels(spark, d), *rules)


@query(f"select k o_orderkey, true allow, '' reasons from {_V} where section = 6")
def rule_empty_body(spark, d):
    return results(vessels(spark, d), restrict(Z100 / 6 / "any", when(vessel.beam > metres(30))))


@query(_case("(bd >= 9 or beam <= 30)", "berth.draught >= 9 m or vessel.beam <= 30 m", where="fk % 10 <> 0"))
def rule_missing_source(spark, d):
    return results(vessels(spark, d, absent_berths=True), require((berth.draught >= metres(9)) | (vessel.beam <= metres(30))))


FLAGSHIP = (
    when(vessel.direction.is_(INBOUND) | vessel.direction.is_(OUTBOUND), require(berth.draught >= vessel.draught + metres(0.3))),
    when(vessel.draught >= metres(10), require(vessel.draught <= metres(18))),
)


@query(f"""select k o_orderkey, string_agg(reason, ';' order by i) reasons from (
select k, bd >= draught + 0.3 allow, 'berth.draught >= vessel.draught + 0.3 m' reason, 1 i from {_V} where fk % 10 <> 0 and dir is not null
union all select k, draught <= 18, 'vessel.draught <= 18 m', 2 from {_V} where draught >= 10) where not allow group by 1""")
def deny_events(spark, d):
    denied = C.deny_events(vessels(spark, d, absent_berths=True), FLAGSHIP)
    return denied.select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


_DENY_OLD = ORACLE["deny_events"]
_DENY_NEW = _DENY_OLD.replace("fk % 10 <> 0 and ", "")


@query(f"""select o_orderkey, case when n.o_orderkey is null then 'D' else 'U' end op, n.reasons from ({_DENY_OLD}) o full join
(select * from ({_DENY_NEW})) n using (o_orderkey) where o.reasons is distinct from n.reasons""")
def deny_changes(spark, d):
    """What is published when berths that were missing become known: new and changed denials, and withdrawn ones."""
    sides = []
    for absent in (True, False):
        denied = C.deny_events(vessels(spark, d, absent_berths=absent), FLAGSHIP)
        sides.append(Relation(denied.select("o_orderkey", F.array_join("reasons", ";").alias("reasons")), ("o_orderkey",)))
    return sides[0].changes_to(sides[1])


def with_wind(spark: SparkSession, d: str) -> DataFrame:
    fields = {n: series(spark, d, kind, F.col("user_id") % 25).withColumnRenamed("k", "sensor") for n, kind in (("velocity", "view"), ("direction", "click"))}
    near = L.nearest_sensor(berth_places(spark, d), sensors(spark, d), "c_custkey")
    return C.with_reading(vessels(spark, d), "wind", fields, near, "o_orderkey", "o_custkey", "c_custkey", "vessel.time")


_ASKED = f"(select sensor k, timestamp '2024-01-01' + to_minutes(o_orderkey % 43200) t, o_orderkey id, o_totalprice / 25000 draught from orders join {_NEAREST} n on o_custkey = n.c_custkey)"
_WIND = _asof(_asof(_ASKED, _points("view", "user_id % 25"), "vel"), _points("click", "user_id % 25"), "dir")


@query(f"""select id o_orderkey, 'wind.velocity <= 40 m/s and wind.direction <= 60 deg' reasons from {_WIND}
where vel is not null and dir is not null and draught >= 10 and not (vel <= 40 and dir <= 60)""")
def deny_events_env(spark, d):
    rule = when(vessel.draught >= metres(10), require((wind.velocity <= metres_per_second(40)) & (wind.direction <= degrees(60))))
    return C.deny_events(with_wind(spark, d), [rule]).select("o_orderkey", F.array_join("reasons", ";").alias("reasons"))


def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as typed rule-table rows."""
    k = F.col("p_partkey")
    kind = F.when(k % 6 < 2, "max_beam").when(k % 6 < 4, "max_length").when(k % 6 == 4, "min_length").otherwise("forbidden")
    bound = F.when(k % 6 < 2, 12.0 + F.col("p_size")).when(k % 6 < 4, 100.0 + 5 * F.col("p_size")).otherwise(50.0 + F.col("p_size"))
    kinds = F.when(F.col("p_size") % 4 == 0, None).otherwise((F.col("p_size") % 5 + 1).cast("string"))
    lower = F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 3.0)
    return table(spark, d, "part").select((k % 25).alias("section"), kinds.alias("type"), lower.alias("draught_from"), kind.alias("kind"), bound.alias("bound"))


@query(f"""select k o_orderkey, count(*) n_rules, count(*) filter (where not met) n_denied, bool_and(met) allow from (
select k, case when p_partkey % 6 < 2 then beam <= 12 + p_size when p_partkey % 6 < 4 then len <= 100 + 5 * p_size when p_partkey % 6 = 4 then len > 50 + p_size else false end met
from {_V}, part where section = p_partkey % 25 and (p_size % 4 = 0 or typ = (p_size % 5 + 1)::varchar) and (p_size % 3 <> 0 or draught >= p_size / 3.0)) group by 1""")
def rule_table_eval(spark, d):
    v = vessels(spark, d).select("o_orderkey", L.section(F.col("vessel.destination")).alias("section"), "vessel.type", "vessel.draught", "vessel.beam", "vessel.length")
    return ruletable.evaluate(v, rule_rows(spark, d), "o_orderkey")


@query(f"""select k o_orderkey, string_agg(reason, ';' order by reason) reasons from (
select k, beam <= 35 allow, 'vessel.beam <= 35 m' reason from {_V} where section in (6, 7)
union all select k, len <= 250, 'vessel.length <= 250 m' from {_V} where section in (6, 7)
union all select k, draught <= 14, 'vessel.draught <= 14 m' from {_V} where section = 7) where not allow group by 1""")
def minimised_rules(spark, d):
    limits = require(vessel.beam <= metres(35)), require(vessel.length <= metres(250))
    six, seven = Z100 / 6 / "any", Z100 / 7 / "any"
    rules = restrict(L.anywhere, restrict(six, *limits), restrict(six, require(vessel.beam <= metres(38))), restrict(seven, *limits), restrict(seven, require(vessel.draught <= metres(14)), require(vessel.draught <= metres(16))))
    small = minimise(rules)
    # a conjunction of two limits is one reason; split it as the single limits would say it
    denied = C.deny_events(vessels(spark, d), [small])
    held = {"vessel.beam <= 35 m": vessel.beam <= metres(35), "vessel.length <= 250 m": vessel.length <= metres(250)}
    joint = F.exists("reasons", lambda r: r.contains(" and "))
    single = F.filter("reasons", lambda r: ~r.contains(" and "))
    parts = F.array_compact(F.array(*(F.when(~e.column(), F.lit(t)) for t, e in held.items())))
    return denied.select("o_orderkey", F.array_join(F.array_sort(F.when(joint, F.concat(single, parts)).otherwise(single)), ";").alias("reasons"))


# Ingestion


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as visits with two berth visits each, three and nine days after the order."""
    k = F.col("o_orderkey")

    def stop(days: int, inbound: Column, outbound: Column) -> Column:
        start = F.col("o_orderdate") + F.make_dt_interval(days=F.lit(days))
        end = start + F.make_dt_interval(hours=F.lit(8))
        places = F.array(F.concat(F.lit("a"), (k % 7).cast("string")), F.concat(F.lit("b"), F.lit(str(days))))
        return F.struct(start.alias("start"), end.alias("end"), inbound.alias("has_inbound"), outbound.alias("has_outbound"), places.alias("locations"))

    record = F.struct(F.lit("n").alias("name"), F.when(k % 11 != 0, k.cast("string")).alias("mmsi"), F.lit(20.0).alias("beam"), F.lit(100.0).alias("lengthOverall"), F.lit("c").alias("shipCategoryCode"))
    stops = F.array(stop(3, k % 3 == 0, k % 5 == 0), stop(9, k % 2 == 0, k % 7 == 0))
    return table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 != 3, "NLRTM").otherwise("BEANR").alias("port"), record.alias("vessel"), stops.alias("berth_visits"))


@query("""with o as (select o_orderkey k, o_orderdate + interval 3 day s1, o_orderdate + interval 9 day s2 from orders where o_orderkey % 4 <> 3 and o_orderkey % 11 <> 0),
c as (select k, case when k % 3 = 0 and s1 > timestamp '1997-01-01' then 1 when k % 2 = 0 and s2 > timestamp '1997-01-01' then 2 when k % 5 = 0 then 3 when k % 7 = 0 then 4 end pick from o)
select k id, case when pick <= 2 then 'Inbound' else 'Outbound' end direction, place from c, (values (1), (2)) n(i),
lateral (select case when i = 1 then 'a' || (k % 7) when pick in (1, 3) then 'b3' else 'b9' end place) where pick is not null""")
def visits_classify(spark, d):
    found = ingest.classify_visits(visits(spark, d), F.expr("timestamp_ntz '1997-01-01 00:00:00'"))
    return found.select("id", "direction", "place")


@query("""select user_id sensor, count(*) filter (where event_type = 'view') n_velocity, count(*) filter (where event_type = 'click') n_direction
from events where event_type in ('view', 'click') and user_id % 3 <> 0 or event_type = 'view' group by 1 having n_velocity > 0 and n_direction > 0""")
def sensor_publish(spark, d):
    events = table(spark, d, "events").filter("event_type in ('view', 'click') and user_id % 3 <> 0 or event_type = 'view'")
    measure = F.when(F.col("event_type") == "view", "wind.velocity").otherwise("wind.direction")
    rows = events.select(F.col("user_id").alias("sensor"), measure.alias("measure"), F.col("ts").alias("time"), "value")
    wide = ingest.publish(rows, ["wind.velocity", "wind.direction"]).df
    return wide.groupBy("sensor").agg(F.sum(F.size("velocity")).alias("n_velocity"), F.sum(F.size("direction")).alias("n_direction"))


@query("select event_id, cast(json_extract(props, '$.k') as integer) k from events")
def json_decode(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select event_id, try_cast(replace(case when event_id % 5 = 0 then '' when event_id % 7 = 0 then 'x' else replace(value::varchar, '.', ',') end, ',', '.') as double) cell from events")
def typed_cells(spark, d):
    n = F.col("event_id")
    raw = F.when(n % 5 == 0, "").when(n % 7 == 0, "x").otherwise(F.regexp_replace(F.col("value").cast("string"), r"\.", ","))
    return table(spark, d, "events").select("event_id", ruletable.number(raw).alias("cell"))


@query("select distinct event_type code from events")
def code_catalog(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("code")).distinct()


@query("select user_id, event_type code, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def results_per_location(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("code")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select k o_orderkey, round(greatest(draught, bd), 6) deepest from " + _V)
def expression_apply(spark, d):
    deepest = apply("deepest", F.greatest, LENGTH, vessel.draught, berth.draught)
    return vessels(spark, d).select("o_orderkey", F.round((deepest / metres(1)).column(), 6).alias("deepest"))
