"""Rule sets over changing records: only vessels that a change touches are evaluated again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.plans.compile import branches, combine_results, fields, sources
from rulefold.plans.rules import Rule
from rulefold.streaming import keyed


@dataclass(frozen=True)
class Record:
    """A record that rules mention beside the vessel: the changelog of its relation, the relation's key, and the column
    of the vessels' changelog that names its row."""

    log: DataFrame
    key: str
    foreign: str
    order: tuple[str, ...] = ("seq",)


def _record(df: DataFrame, name: str, column: str, mentioned: set[tuple[str, str]]) -> Column:
    """A struct column without the fields that no rule mentions, so that they are neither sent nor held; null where it was."""
    there = [f.name for f in df.schema[column].dataType.fields]
    kept = [f for f in there if (name, f.lower()) in mentioned] or there
    return F.when(F.col(column).isNotNull(), F.struct(*(F.col(column).getField(f).alias(f) for f in kept))).alias(name)


def deny_changes(vessels: DataFrame, rules: Sequence[Rule], keys: Sequence[str], records: dict[str, Record] | None = None, order: Sequence[str] = ("seq",)) -> DataFrame:
    """What is to be published as vessels and records change: keys, op, version, reasons (null for a withdrawn denial).

    `vessels` is a streaming changelog with the struct column `vessel` and the columns that name records; each record is
    joined by its key, so a change reaches only the vessels that name it. A vessel that several changes of a micro-batch
    touch is published once, with the result of all of them; one whose denial and reasons stay is not published.
    Folded by version, the result equals the denials of the rule set over the folded tables at each batch's end.
    """
    records = records or {}
    if missing := sources(rules) - {"vessel"} - set(records):
        raise ValueError(f"no record for {sorted(missing)}")
    mentioned = {(record, field.partition(".")[0].lower()) for record, field in fields(rules)}
    foreign = dict.fromkeys(r.foreign for r in records.values() if r.foreign not in keys)
    rows = vessels.select(*keys, "op", *order, *foreign, _record(vessels, "vessel", "vessel", mentioned))
    for name, record in records.items():
        values = [c for c in record.log.columns if c not in {record.key, "op", *record.order}]
        log = record.log.select(record.key, "op", *record.order, F.struct(*values).alias(name))
        log = log.select(record.key, "op", *record.order, _record(log, name, name, mentioned))
        rows = keyed.foreign_join(rows, log, keys, record.foreign, record.key, order, record.order, how="left")
        order = (keyed.VERSION,)
    found = branches(rules, F.col("vessel.destination"))
    there, allowed, reasons = combine_results([b.result() for b in found]) if found else (F.lit(False), F.lit(True), F.expr("cast(array() as array<string>)"))
    denied = F.when(F.col("op") == "U", there & ~allowed).otherwise(False)
    judged = rows.withColumns({"__denied": denied, "__reasons": reasons})
    out = judged.select(*keys, F.when(F.col("__denied"), "U").otherwise("D").alias("op"), *order, F.when(F.col("__denied"), F.col("__reasons")).alias("reasons"))
    return keyed.differences(out, keys, order)
