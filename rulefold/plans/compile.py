"""From rules to one projection over the vessels: branches become Columns, results are combined in the row.

Every record a rule set mentions is joined once. A branch has a result only where all its guards hold with all records
they need; a vessel without any branch result has no result (neither allowed nor denied).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.functions import timeseries
from rulefold.functions.expr import Expr, text
from rulefold.functions.location import nearest_sensor
from rulefold.plans.rules import Require, Restrict, Rule

Guard = Column


@dataclass(frozen=True)
class Branch:
    """A way to a result: guards (never null), then a requirement or plain allowance."""

    guards: tuple[Guard, ...]
    requirement: Expr | None

    def result(self) -> Column:
        """struct(allow, reason), or null where the branch does not apply."""
        guards = list(self.guards)
        if self.requirement is None:
            answer = F.struct(F.lit(True).alias("allow"), F.lit(None).cast("string").alias("reason"))
        else:
            guards.append(self.requirement.present())
            allow = F.coalesce(self.requirement.column(), F.lit(False))
            reason = F.when(~allow, F.lit(text(self.requirement)))
            answer = F.struct(allow.alias("allow"), reason.alias("reason"))
        return F.when(reduce(lambda a, b: a & b, guards, F.lit(True)), answer)


def branches(rules: Iterable[Rule], destination: Column, guards: tuple[Guard, ...] = ()) -> list[Branch]:
    out = []
    for rule in rules:
        if isinstance(rule, Require):
            out.append(Branch(guards, rule.condition))
        elif not rule.body:  # an empty body allows whatever comes in; its own condition is not looked at
            out.append(Branch(guards, None))
        else:
            own = rule.location.contains(destination) if isinstance(rule, Restrict) else rule.condition.holds()
            out += branches(rule.body, destination, (*guards, own))
    return out


def sources(rules: Iterable[Rule]) -> set[str]:
    """Records that the rules mention."""
    out = set()
    for rule in rules:
        if not isinstance(rule, Restrict):
            out |= rule.condition.sources()
        out |= sources(getattr(rule, "body", ()))
    return out


def fields(rules: Iterable[Rule]) -> set[tuple[str, str]]:
    """Records and their fields that the rules mention."""
    out = set()
    for rule in rules:
        out |= {("vessel", "destination")} if isinstance(rule, Restrict) else rule.condition.fields()
        out |= fields(getattr(rule, "body", ()))
    return out


def combine_results(results: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(has a result, allowed, reasons): a denial prevails, reasons stand in the order of the rules."""
    there = F.array_compact(F.array(*results))
    allowed = F.forall(there, lambda r: r["allow"])
    reasons = F.transform(F.filter(there, lambda r: ~r["allow"]), lambda r: r["reason"])
    return F.size(there) > 0, allowed, reasons


def evaluate(vessels: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """vessels (with a struct column for each record, null where absent) with allow and reasons; vessels without a
    result are left out."""
    found = branches(rules, F.col("vessel.destination"))
    if not found:
        return vessels.withColumns({"allow": F.lit(True), "reasons": F.expr("cast(array() as array<string>)")}).limit(0)
    there, allowed, reasons = combine_results([b.result() for b in found])
    return vessels.select("*", there.alias("__there"), allowed.alias("allow"), reasons.alias("reasons")).filter("__there").drop("__there")


def deny_events(vessels: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Vessels that some rule denies, with the reasons."""
    return evaluate(vessels, rules).filter(~F.col("allow")).drop("allow")


def with_berth(vessels: DataFrame, berths: DataFrame, key: str, berth_key: str) -> DataFrame:
    """vessels with the record `berth` of the berth they are bound for (null without one)."""
    own = [c for c in berths.columns if c != berth_key]
    right = berths.select(F.col(berth_key).alias("__berth"), F.struct(*own).alias("berth"))
    return vessels.join(right, F.col(key) == F.col("__berth"), "left").drop("__berth")


def berth_sensors(berths: DataFrame, sensors: DataFrame, berth_key: str) -> DataFrame:
    """(berth key, sensor): computed for each berth once, not for each vessel."""
    return nearest_sensor(berths, sensors, berth_key)


def with_reading(
    vessels: DataFrame, record: str, fields: dict[str, DataFrame], berth_to_sensor: DataFrame, vessel_key: str, destination: str, berth_key: str, time: str
) -> DataFrame:
    """vessels with a sensor record predicted at their time; null unless every field can be predicted.

    fields: name -> series (sensor, time, value). All fields are predicted in one pass over (vessel, sensor, time) rows
    and joined back once.
    """
    wanted = vessels.select(vessel_key, F.col(destination).alias("__to"), F.col(time).alias("time"))
    rows = wanted.join(berth_to_sensor, F.col("__to") == F.col(berth_key)).select(vessel_key, "sensor", "time")
    rows = timeseries.interpolate_fields(rows, fields, "sensor")
    whole = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in fields))
    made = rows.filter(whole).select(F.col(vessel_key).alias("__id"), F.struct(*fields).alias(record))
    return vessels.join(made, F.col(vessel_key) == F.col("__id"), "left").drop("__id")
