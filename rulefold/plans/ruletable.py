"""Spreadsheet rule tables: typed reading with quarantine, rows as rule trees, and evaluation as one join."""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulefold.functions import units as U
from rulefold.functions.expr import Expr, const, named, record_field
from rulefold.functions.location import Z100, Location, parse
from rulefold.plans.limitindex import LimitIndex
from rulefold.plans.rules import INBOUND, OUTBOUND, Rule, require, restrict, vessel, when
from rulefold.session import stored

#: The columns of a rule table, in order.
COLUMNS = [
    "FEATUREID", "RESTRICTION_TYPE", "VESSEL_TYPE", "VESSEL_LENGTH_FROM", "VESSEL_LENGTH_TO", "VESSEL_BEAM_FROM", "VESSEL_BEAM_TO",
    "VESSEL_DRAUGHT_FROM", "VESSEL_DRAUGHT_TO", "VESSEL_HEIGHT_FROM", "VESSEL_HEIGHT_TO", "VESSEL_TONNAGE_FROM", "VESSEL_TONNAGE_TO",
    "VESSEL_DIRECTION", "SPECIAL_TRANSPORT", "VISIBILITY_FROM", "VISIBILITY_TO", "WIND_DIRECTION_FROM", "WIND_DIRECTION_TO",
    "WIND_SPEED_FROM", "WIND_SPEED_TO", "CURRENT_FROM", "CURRENT_TO", "CURRENT_TREND", "LIGHT_CONDITION", "RESTRICTION_VALUE",
    "RESTRICTION_UNIT", "RESTRICTION_DESCRIPTION", "POLICY_CLEARANCE", "POLICY_TUG_NUMBER", "POLICY_TUG_TYPE", "POLICY_TUG_BOLLARD_PULL",
    "POLICY_REMARKS", "STATUS", "DATASOURCE", "SURVEYMETHOD", "SURVEYPRECISION", "SURVEYDATE", "FUNCSTARTDATE", "FUNCENDDATE",
]
#: Cells that hold numbers; a comma is a decimal point too.
NUMBERS = [
    "VESSEL_LENGTH_FROM", "VESSEL_LENGTH_TO", "VESSEL_BEAM_FROM", "VESSEL_BEAM_TO", "VESSEL_DRAUGHT_FROM", "VESSEL_DRAUGHT_TO",
    "VESSEL_HEIGHT_FROM", "VESSEL_HEIGHT_TO", "VESSEL_TONNAGE_FROM", "VESSEL_TONNAGE_TO", "VISIBILITY_FROM", "VISIBILITY_TO",
    "WIND_SPEED_FROM", "WIND_SPEED_TO",
]
#: Allowed codes.
VESSEL_TYPES = ["ALL", "A11A", "A12", "A13"]
KINDS = ["MINIMUM_UKC", "MINIMUM_UKC_LONG_TERM", "FRESH_WATER_ALLOWANCE", "VESSEL_TYPE", "MAXIMUM_BEAM", "MINIMUM_LENGTH", "MAXIMUM_LENGTH"]
EVERYWHERE: Location = Z100 / 6 / "any"

contract_depth = named("contract_depth", record_field("berth", "contract_depth", U.LENGTH))
fresh_water_allowance = named("fresh_water_allowance", record_field("berth", "fresh_water_allowance", U.SCALAR))


def number(cell: Column) -> Column:
    """A cell as a double: null if empty or not a number."""
    return F.regexp_replace(F.trim(cell), ",", ".").try_cast("double")


def typed(cells: DataFrame) -> DataFrame:
    """Typed columns and `_corrupt`: what is wrong with a row (null if nothing). Empty cells are null; vessel type ALL
    is null."""
    blank = {c: F.when(F.trim(c) != "", F.trim(c)) for c in cells.columns}
    wrong = [F.when(blank[c].isNotNull() & number(F.col(c)).isNull(), F.lit(f"{c} is not a number")) for c in NUMBERS]
    wrong.append(F.when(~F.coalesce(blank["VESSEL_TYPE"], F.lit("ALL")).isin(VESSEL_TYPES), F.lit("unknown VESSEL_TYPE")))
    wrong.append(F.when(~F.coalesce(blank["RESTRICTION_TYPE"].isin(KINDS), F.lit(False)), F.lit("unknown RESTRICTION_TYPE")))
    columns = {c: number(F.col(c)) if c in NUMBERS else blank[c] for c in cells.columns}
    columns["VESSEL_TYPE"] = F.when(blank["VESSEL_TYPE"] != "ALL", blank["VESSEL_TYPE"])
    note = F.array_join(F.array_compact(F.array(*wrong)), "; ")
    return cells.select(*(v.alias(k) for k, v in columns.items()), F.when(note != "", note).alias("_corrupt"))


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A rule table: `;` between cells, one header line. strict raises ValueError if any row is corrupt."""
    schema = ", ".join(f"`{c}` string" for c in COLUMNS)
    rows = typed(spark.read.csv(path, schema=schema, sep=";", header=True, enforceSchema=True))
    if strict:
        bad = rows.filter("_corrupt is not null").select("FEATUREID", "_corrupt").first()
        if bad:
            raise ValueError(f"{bad['FEATUREID']}: {bad['_corrupt']}")
    return rows


def _requirement(row: Row) -> Expr | None:
    kind, unit = row["RESTRICTION_TYPE"], row["RESTRICTION_UNIT"]
    try:
        value = float((row["RESTRICTION_VALUE"] or "").replace(",", "."))
    except ValueError:
        return None
    if kind == "VESSEL_TYPE" and value in (0, 1):
        return const(bool(value))
    if kind == "FRESH_WATER_ALLOWANCE" and unit == "PERCENTAGE":
        return fresh_water_allowance.is_(value)
    if unit != "METERS":
        return None
    bound = const(U.metres(value))
    if kind in ("MINIMUM_UKC", "MINIMUM_UKC_LONG_TERM"):
        return contract_depth >= vessel.draught + bound
    return {"MAXIMUM_BEAM": vessel.beam <= bound, "MAXIMUM_LENGTH": vessel.length <= bound, "MINIMUM_LENGTH": vessel.length > bound}.get(kind)


def rule(row: Row, both_bounds: bool = False) -> Rule:
    """A row as a rule. Of two draught bounds only the lower counts unless both_bounds. Raises ValueError for a
    restriction that no requirement fits."""
    wanted = _requirement(row)
    if wanted is None:
        raise ValueError(f"no requirement for {row['RESTRICTION_TYPE']} {row['RESTRICTION_VALUE']} {row['RESTRICTION_UNIT']}")
    out: Rule = require(wanted)
    low, high = row["VESSEL_DRAUGHT_FROM"], row["VESSEL_DRAUGHT_TO"]
    if high is not None and (low is None or both_bounds):
        out = when(vessel.draught < const(U.metres(high)), out)
    if low is not None:
        out = when(vessel.draught >= const(U.metres(low)), out)
    if row["VESSEL_DIRECTION"] == "INBOUND_OUTBOUND":
        out = when(vessel.direction.is_(INBOUND) | vessel.direction.is_(OUTBOUND), out)
    if row["VESSEL_TYPE"]:
        out = when(vessel.type.is_(row["VESSEL_TYPE"]), out)
    where = parse(row["FEATUREID"] or "")
    return restrict(where, out) if where else out


def rules(table: DataFrame, within: Location = EVERYWHERE, most: int = 2000) -> Rule:
    """All good rows as one rule set, which is one expression for each vessel. More than `most` rows raise ValueError:
    limits() and evaluate() take tables of any size."""
    rows = table.filter("_corrupt is null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: evaluate them as limits()")
    return restrict(within, *map(rule, rows))


#: What a row requires, by restriction type and unit (any unit for VESSEL_TYPE).
_KIND = {
    ("MINIMUM_UKC", "METERS"): "ukc", ("MINIMUM_UKC_LONG_TERM", "METERS"): "ukc", ("FRESH_WATER_ALLOWANCE", "PERCENTAGE"): "fresh_water",
    ("MAXIMUM_BEAM", "METERS"): "max_beam", ("MAXIMUM_LENGTH", "METERS"): "max_length", ("MINIMUM_LENGTH", "METERS"): "min_length",
}


def limits(table: DataFrame, both_bounds: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of a typed rule table as limits, the same rules as rule() makes: section, place (null: all of it), type
    (null: any), both_ways (only vessels that move in or out), draught_from and draught_to (null: any), kind, bound.

    Rows that are corrupt, and those that no requirement fits, have their reason in `fault` and null as kind; a location
    that does not parse holds everywhere (section null). `keep` names columns of the table to keep."""
    bound = number(F.col("RESTRICTION_VALUE"))
    kind = reduce(
        lambda otherwise, k: F.when((F.col("RESTRICTION_TYPE") == k[0][0]) & (F.col("RESTRICTION_UNIT") == k[0][1]), k[1]).otherwise(otherwise), _KIND.items(), F.lit(None).cast("string")
    )
    kind = F.when((F.col("RESTRICTION_TYPE") == "VESSEL_TYPE") & (bound == 0), "forbidden").when((F.col("RESTRICTION_TYPE") == "VESSEL_TYPE") & (bound == 1), "allowed").otherwise(kind)
    kind = F.when(F.col("_corrupt").isNull() & bound.isNotNull(), kind)
    where = lambda group: F.regexp_extract(F.coalesce("FEATUREID", F.lit("")), r"Z100/(\d+)/(\d+|any)$", group)
    high = F.col("VESSEL_DRAUGHT_TO") if both_bounds else F.when(F.col("VESSEL_DRAUGHT_FROM").isNull(), F.col("VESSEL_DRAUGHT_TO"))
    return table.select(
        *keep, F.when(where(1) != "", where(1).cast("bigint")).alias("section"), where(2).try_cast("bigint").alias("place"), F.col("VESSEL_TYPE").alias("type"),
        F.coalesce(F.col("VESSEL_DIRECTION") == "INBOUND_OUTBOUND", F.lit(False)).alias("both_ways"), F.col("VESSEL_DRAUGHT_FROM").alias("draught_from"), high.alias("draught_to"),
        kind.alias("kind"), bound.alias("bound"), F.when(kind.isNull(), F.coalesce("_corrupt", F.lit("no requirement"))).alias("fault"),
    )


def strictest(table: DataFrame) -> DataFrame:
    """Limits with those left out that a stricter one for the same vessels and kind implies: one job over a table of any
    size, where minimise() rewrites the trees of a small one. Columns of limits() without fault; a vessel is denied by
    what is left just where it was denied before."""
    own = ["section", "place", "type", "both_ways", "draught_from", "draught_to", "kind"]
    exact = F.when(F.col("kind").isin("fresh_water", "forbidden", "allowed"), F.col("bound"))
    rows = table.filter(F.col("kind").isNotNull()).withColumn("__exact", exact)
    return rows.groupBy(*own, "__exact").agg(F.min("bound").alias("__low"), F.max("bound").alias("__high")).select(
        *own, F.when(F.col("kind").isin("max_beam", "max_length"), F.col("__low")).when(F.col("kind").isin("min_length", "ukc"), F.col("__high")).otherwise(F.col("__exact")).alias("bound")
    )


#: Parts that the limits of one guard are dealt to where they look for one that implies them.
SALTS = 8


def _implied(table: pa.Table) -> pa.Table:
    """One guard, one kind: ids of the limits that another one here implies. In the order of lower draughts up, upper ones
    down, bounds from strict to loose, what implies a limit stands before it; the stairs hold what is open by falling
    upper draught and rising strictness."""
    columns = ("low", "high", "tight", "asks", "id")
    rows = sorted(zip(*(table[c].to_pylist() for c in columns), strict=True), key=lambda r: (r[0], -r[1], r[2], r[3]))
    tops: list[float] = []  # negated upper draughts, ascending
    tights: list[float] = []  # descending: a lower top has to be stricter to be of use
    found = []
    for low, high, tight, asks, own in rows:
        at = bisect.bisect_right(tops, -high)
        if at and tights[at - 1] <= tight:
            found.append(own)
            continue
        if not asks:
            at = bisect.bisect_left(tops, -high)
            end = at
            while end < len(tops) and tights[end] >= tight:
                end += 1
            tops[at:end], tights[at:end] = [-high], [tight]
    return pa.table({"id": pa.array(found, pa.int64())})


def minimal(table: DataFrame) -> DataFrame:
    """strictest(), less all limits that another one implies: one for the same vessels or more of them (any section, place,
    type or direction, a wider range of draughts) with a bound as strict or stricter, or a flat refusal. Columns of
    strictest(); nothing that is left is implied by another one, and a vessel is denied by what is left just where it was
    denied before. Allowances stand for themselves: only wider ones imply them.

    Each limit asks the guards that hold its own (16 at most, and each refusal there), of which only those that occur
    are kept; the questions to one guard are dealt to SALTS parts, each of which gets the guard's limits.
    """
    guard = ["section", "place", "type", "both_ways"]
    kind = F.col("kind")
    tight = F.when(kind.isin("max_beam", "max_length"), F.col("bound")).when(kind.isin("min_length", "ukc"), -F.col("bound")).otherwise(0.0)
    rows = strictest(table).filter("draught_from is null or draught_to is null or draught_from < draught_to")
    # refusals and allowances are the same whatever their bound
    rows = rows.withColumn("bound", F.when(~kind.isin("forbidden", "allowed"), F.col("bound"))).distinct()
    rows = stored(rows.withColumn("id", F.xxhash64(*guard, "draught_from", "draught_to", "kind", "bound")), "limits")
    about = F.when(kind == "fresh_water", F.concat("kind", F.lit(" "), F.col("bound").cast("string"))).otherwise(kind)
    inf = F.lit(float("inf"))
    facts = rows.select(*guard, about.alias("about"), F.coalesce("draught_from", -inf).alias("low"), F.coalesce("draught_to", inf).alias("high"), tight.alias("tight"), "id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    wider = facts
    for c in guard[:3]:
        wider = wider.withColumn(c, F.explode(F.array_distinct(F.array(F.col(c), F.lit(None).cast(facts.schema[c].dataType)))))
    wider = wider.withColumn("both_ways", F.explode(F.array_distinct(F.array("both_ways", F.lit(False)))))
    asked = wider.withColumn("about", F.explode(F.when(F.col("about").isin("allowed", "forbidden"), F.array("about")).otherwise(F.array("about", F.lit("forbidden")))))
    # a refusal is as strict as any bound
    asked = asked.withColumn("tight", F.when(F.col("about") == "forbidden", 0.0).otherwise(F.col("tight")))
    here = facts.select("id", *(F.col(c).alias(f"__{c}") for c in [*guard, "about"]))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*guard, "about"]]
    asked = asked.join(here.drop("id").distinct(), reduce(lambda a, b: a & b, same)).select(*facts.columns)
    # a limit's question to its own guard and kind is its own row
    asked = asked.join(facts.select("id", *(F.col(c).alias(f"__{c}") for c in [*guard, "about"])).withColumnRenamed("id", "__id"), reduce(lambda a, b: a & b, [*same, F.col("id") == F.col("__id")]), "left_anti")
    both = facts.select("*", F.lit(0).alias("asks"), salts).unionByName(asked.withColumns({"asks": F.lit(1), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")}))
    implied = both.groupBy(*guard, "about", "salt").applyInArrow(_implied, "id bigint")
    return rows.join(implied.distinct(), "id", "left_anti").drop("id")


#: Columns of limits and vessels that may be missing, with their types.
_LIMIT = {"place": "bigint", "both_ways": "boolean", "draught_to": "double"}
_VESSEL = {"place": "bigint", "direction": "string", "contract_depth": "double", "fresh_water_allowance": "double"}
_OTHER = "other"


def evaluate(vessels: DataFrame, table: DataFrame, key: str, most_rules: int = 200_000) -> DataFrame:
    """All limits against all vessels as one job: (key, n_rules that apply, n_denied, allow).

    vessels: key, section, type, draught, beam, length, and as far as limits ask for them place, direction,
    contract_depth and fresh_water_allowance (null: the vessel has no berth record, and the limit no result for it).
    table: as limits() makes it.

    Equal limits count once with their number. Up to most_rules of them go to every task as an index that a vessel
    searches, so its work grows with the logarithm of the limits; one row a vessel, nothing is shuffled. Beyond that
    vessels and limits are joined on section and type (evaluate_by_pairs).
    """
    rules = table.withColumns({c: F.lit(None).cast(t) for c, t in _LIMIT.items() if c not in table.columns}).filter(F.col("kind").isNotNull())
    own = ["section", "place", "type", "both_ways", "draught_from", "draught_to", "kind", "bound"]
    rows = rules.groupBy(*own).agg(F.count("*").alias("times")).limit(most_rules + 1).collect()
    if len(rows) > most_rules:
        return evaluate_by_pairs(vessels, table, key)
    v = vessels.withColumns({c: F.lit(None).cast(t) for c, t in _VESSEL.items() if c not in vessels.columns})
    index = LimitIndex([tuple(r) for r in rows])
    numbers = ["draught", "beam", "length", "contract_depth", "fresh_water_allowance"]
    sent = v.select(
        key, *(F.col(c).cast("bigint").alias(f"__{c}") for c in ("section", "place")), F.col("type").alias("__type"),
        F.coalesce(F.col("direction").isin(INBOUND, OUTBOUND), F.lit(False)).alias("__moves"), *(F.col(c).cast("double").alias(f"__{c}") for c in numbers),
    )
    schema = T.StructType([v.schema[key], *T._parse_datatype_string("n_rules bigint, n_denied bigint")])

    def run(batches):
        for b in batches:
            floats = [np.array(b.column(f"__{c}").to_numpy(zero_copy_only=False), float) for c in numbers]
            labels = [b.column(f"__{c}").to_pylist() for c in ("section", "place", "type")]
            n, broken = index.count(*labels, b.column("__moves").to_numpy(zero_copy_only=False).astype(bool), *floats)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n), pa.array(broken)], names=[key, "n_rules", "n_denied"])

    counted = sent.mapInArrow(run, schema).filter("n_rules > 0")
    return counted.withColumn("allow", F.col("n_denied") == 0)


def evaluate_by_pairs(vessels: DataFrame, table: DataFrame, key: str, most_rules: int = 200_000) -> DataFrame:
    """evaluate() as a join for rule tables of any size: both sides meet on section and type (a limit for all types is
    there once for each type, one for all sections once for each section), so only few pairs that do not apply are
    looked at. Limits are broadcast up to most_rules; beyond that both sides are shuffled on section and type."""
    v = vessels.withColumns({c: F.lit(None).cast(t) for c, t in _VESSEL.items() if c not in vessels.columns})
    rules = table.withColumns({c: F.lit(None).cast(t) for c, t in _LIMIT.items() if c not in table.columns}).filter(F.col("kind").isNotNull())
    own = ["section", "place", "type", "both_ways", "draught_from", "draught_to", "kind", "bound"]
    rules = rules.groupBy(*own).agg(F.count("*").alias("__times"))
    types = [r["type"] for r in rules.select("type").distinct().collect() if r["type"] is not None]  # codes of a closed list
    each = F.explode(F.when(F.col("type").isNull(), F.array(*map(F.lit, [*types, _OTHER]))).otherwise(F.array("type")))
    rules = rules.select(each.alias("__type"), F.coalesce("section", F.lit(-1)).alias("__section"), "__times", *(F.col(c).alias(f"__r_{c}") for c in own[1:] if c != "type"))
    rules = F.broadcast(rules) if rules.count() <= most_rules else rules
    v = v.withColumn("__own", F.when(F.col("type").isin(types), F.col("type")).otherwise(_OTHER) if types else F.lit(_OTHER))
    v = v.withColumn("__at", F.explode(F.array(F.coalesce("section", F.lit(-2)), F.lit(-1))))
    r = lambda c: F.col(f"__r_{c}")
    open_ = lambda c: r(c).isNull()
    applies = (F.col("__section") == F.col("__at")) & (F.col("__type") == F.col("__own")) & (open_("place") | (F.col("place") == r("place")))
    applies = applies & (open_("draught_from") | (F.col("draught") >= r("draught_from"))) & (open_("draught_to") | (F.col("draught") < r("draught_to")))
    applies = applies & (~F.coalesce(r("both_ways"), F.lit(False)) | F.coalesce(F.col("direction").isin(INBOUND, OUTBOUND), F.lit(False)))
    applies = applies & (~r("kind").isin("ukc", "fresh_water") | F.col("contract_depth").isNotNull())
    met = reduce(
        lambda otherwise, case: F.when(r("kind") == case[0], case[1]).otherwise(otherwise),
        [
            ("max_beam", F.col("beam") <= r("bound")), ("max_length", F.col("length") <= r("bound")), ("min_length", F.col("length") > r("bound")),
            ("ukc", F.col("contract_depth") >= F.col("draught") + r("bound")), ("fresh_water", F.col("fresh_water_allowance") == r("bound")), ("allowed", F.lit(True)),
        ],
        F.lit(False),
    )
    refused = F.when(F.coalesce(met, F.lit(False)), 0).otherwise(F.col("__times"))
    counted = v.join(rules, applies).groupBy(key).agg(F.sum("__times").alias("n_rules"), F.sum(refused).alias("n_denied"))
    return counted.withColumn("allow", F.col("n_denied") == 0)
