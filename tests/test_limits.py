"""Limits by index against pairs, and minimal tables against all pairs of limits."""

import random

import pytest
from pyspark.sql import functions as F

from rulefold.plans import ruletable
from rulefold.plans.limitindex import KINDS

LIMITS = "section bigint, place bigint, type string, both_ways boolean, draught_from double, draught_to double, kind string, bound double, fault string"
SHIPS = "id bigint, section bigint, place bigint, type string, direction string, draught double, beam double, length double, contract_depth double, fresh_water_allowance double"


def limits(rng, n):
    some = lambda *x: rng.choice([*x, None])
    return [(some(1, 2), some(1, 2), some("A", "B"), rng.random() < 0.4, some(2.0, 4.0, 6.0), some(5.0, 7.0, 9.0), rng.choice(KINDS), float(rng.randint(1, 6)), None) for _ in range(n)]


def ships(rng, n):
    some = lambda *x: rng.choice([*x, None])
    number = lambda: some(*(float(i) for i in range(1, 11)))
    return [(i, some(1, 2, 3), some(1, 2, 3), some("A", "B", "C"), some("Inbound", "Outbound", "Else"), number(), number(), number(), number(), some(1.0, 2.0, 3.0)) for i in range(n)]


def test_index_agrees_with_pairs(spark):
    rng = random.Random(3)
    v = spark.createDataFrame(ships(rng, 400), SHIPS).cache()
    extra = [(None, None, None, False, None, None, "max_beam", None, None), (1, None, None, False, None, None, "ukc", None, None), (None, None, "A", None, 3.0, 3.0, "max_length", 1.0, None), (None, None, None, False, None, None, None, 1.0, "broken")]
    for n in (0, 1, 7, 300):
        table = spark.createDataFrame(limits(rng, n) + extra[: n // 7 and 4], LIMITS)
        want = {tuple(r) for r in ruletable.evaluate_by_pairs(v, table, "id").collect()}
        assert {tuple(r) for r in ruletable.evaluate(v, table, "id").collect()} == want
        assert {tuple(r) for r in ruletable.evaluate(v, table, "id", most_rules=5).collect()} == want
    assert len(want) > 300 and ruletable.evaluate(v.limit(0), table, "id").count() == 0


def implies(a, b):
    """Whether what limit b denies, limit a denies."""
    if any(x is not None and x != y for x, y in zip(a[:3], b[:3], strict=True)) or a[3] and not b[3]:
        return False
    low, high = lambda r: -99 if r[4] is None else r[4], lambda r: 99 if r[5] is None else r[5]
    if low(a) > low(b) or high(a) < high(b):
        return False
    if a[6] == "forbidden" and b[6] != "allowed":
        return True
    if a[6] != b[6]:
        return False
    return {"max_beam": lambda: a[7] <= b[7], "max_length": lambda: a[7] <= b[7], "min_length": lambda: a[7] >= b[7], "ukc": lambda: a[7] >= b[7], "fresh_water": lambda: a[7] == b[7], "allowed": lambda: True}[a[6]]()


def test_minimal_tables_hold_nothing_implied(spark):
    rng = random.Random(5)
    v = spark.createDataFrame(ships(rng, 300), SHIPS).cache()
    rows = limits(rng, 150) + [r for r in limits(rng, 150) if r[6] not in ("forbidden", "allowed")]
    table = spark.createDataFrame(rows, LIMITS)
    left = [tuple(r) for r in ruletable.minimal(table).select(*(c.split()[0] for c in LIMITS.split(", ")[:8])).collect()]
    whole = {(*r[:7], None if r[6] in ("forbidden", "allowed") else r[7]) for r in rows if r[4] is None or r[5] is None or r[4] < r[5]}
    want = {b for b in whole if not any(a != b and implies(a, b) for a in whole)}
    assert sorted(left, key=repr) == sorted(want, key=repr) and 5 < len(left) < len(whole) / 2
    allow = lambda t: {r.id for r in ruletable.evaluate(v, t, "id").filter(~F.col("allow")).collect()}
    assert allow(spark.createDataFrame([(*r, None) for r in left], LIMITS)) == allow(table)
    assert ruletable.minimal(table.limit(0)).count() == 0


def test_a_rule_tree_is_bounded(spark):
    blank = dict.fromkeys(ruletable.COLUMNS, "") | {"FEATUREID": "x:Z100/6/any", "RESTRICTION_TYPE": "MAXIMUM_BEAM", "RESTRICTION_VALUE": "30", "RESTRICTION_UNIT": "METERS"}
    typed = ruletable.typed(spark.createDataFrame([tuple(blank.values())] * 3, ", ".join(f"`{c}` string" for c in ruletable.COLUMNS)))
    assert len(ruletable.rules(typed).body) == 3
    with pytest.raises(ValueError):
        ruletable.rules(typed, most=2)
