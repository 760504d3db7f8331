"""Relation and stream operators against a dict model, on seeded random changelogs."""

import random

import pytest
from pyspark.sql import functions as F

from rulefold.operators import streams
from rulefold.operators.relation import Relation, merge_changelogs

SCHEMA = "k string, seq bigint, op string, v int"


def changes(seed, start=0, n=12):
    rng = random.Random(seed)
    return [(rng.choice("ABCD"), start + i, *(("U", rng.randint(1, 42)) if rng.random() < 0.5 else ("D", None))) for i in range(rng.randint(0, n))]


def fold(rows):
    out = {}
    for k, _, op, v in sorted(rows, key=lambda r: r[1]):
        if op == "U":
            out[k] = v
        else:
            out.pop(k, None)
    return out


def relation(spark, rows):
    return Relation.from_changelog(spark.createDataFrame(rows, SCHEMA), ["k"], ["seq"]).map(v=F.col("v"))


def table(df):
    rows = df.df.collect() if isinstance(df, Relation) else df.collect()
    return {r["k"]: tuple(r)[1:] if len(r) > 2 else r[1] for r in rows}


@pytest.mark.parametrize("seed", range(4))
def test_operators_match_the_model(spark, seed):
    a, b = changes(seed), changes(seed + 100)
    ta, tb = fold(a), fold(b)
    ra, rb = relation(spark, a), relation(spark, b)
    assert table(ra) == ta
    assert table(ra.map(v=F.col("v") + 1)) == {k: v + 1 for k, v in ta.items()}
    assert table(ra.filter(F.col("v") % 2 == 0)) == {k: v for k, v in ta.items() if v % 2 == 0}
    other = rb.map(w=F.col("v"))
    assert table(ra.join(other)) == {k: (ta[k], tb[k]) for k in ta.keys() & tb.keys()}
    sides = {k: (ta.get(k), tb.get(k), "both" if k in ta and k in tb else "left" if k in ta else "right") for k in ta.keys() | tb.keys()}
    assert table(ra.outer_join(other)) == sides
    total = {k: ta.get(k, 0) + tb.get(k, 0) for k in ta.keys() | tb.keys()}
    assert table(ra.combine(rb, lambda x, y: x + y)) == total
    assert table(rb.combine(ra, lambda x, y: x + y)) == total
    later = [(k, seq + 50, op, v) for k, seq, op, v in b]
    merged = merge_changelogs(*(spark.createDataFrame(x, SCHEMA) for x in (a, later)))
    assert table(Relation.from_changelog(merged, ["k"], ["seq"]).map(v=F.col("v"))) == fold(a + later)


@pytest.mark.parametrize("seed", range(3))
def test_diff_turns_one_table_into_the_other(spark, seed):
    a, b = changes(seed), changes(seed + 7)
    rows = [tuple(r) for r in relation(spark, a).changes_to(relation(spark, b)).select("k", "op", "v").collect()]
    got = dict(fold(a))
    for k, op, v in rows:
        if op == "U":
            assert got.get(k) != v
            got[k] = v
        else:
            del got[k]
    assert got == fold(b)


def test_filter_on_the_table_differs_from_filter_on_the_changes(spark):
    rows = [("A", 1, "U", 10), ("B", 2, "U", 5), ("A", 3, "U", 11)]
    assert table(relation(spark, rows).filter(F.col("v") <= 10)) == {"B": 5}
    assert table(relation(spark, [r for r in rows if r[3] <= 10])) == {"A": 10, "B": 5}


def test_foreign_join_drops_rows_that_match_none(spark):
    left = Relation(spark.createDataFrame([("A", 1), ("B", 2), ("C", 1)], "k string, f int"), ("k",))
    right = Relation(spark.createDataFrame([(1, "x")], "id int, name string"), ("id",))
    assert table(left.join_foreign(right, "f")) == {"A": (1, "x"), "C": (1, "x")}


def test_zip_latest_is_empty_until_the_stream_has_an_element(spark):
    r = relation(spark, [("A", 1, "U", 1), ("B", 2, "U", 2)])
    s = spark.createDataFrame([(1, "x"), (3, "y")], "n int, e string")
    assert table(r.zip_latest(s, ["n"])) == {"A": (1, 3, "y"), "B": (2, 3, "y")}
    assert table(r.zip_latest(s.limit(0), ["n"])) == {}


def test_empty_pure_and_bad_changelogs(spark):
    empty = Relation.empty(spark, "k string, v int", ["k"])
    one = Relation.pure(spark, "k string, v int", ("", 3), ["k"])
    assert table(empty) == {} and table(one) == {"": 3}
    assert table(one.combine(empty, lambda a, b: a + b)) == {"": 3}
    with pytest.raises(ValueError, match="lacks"):
        Relation.from_changelog(spark.createDataFrame([("A", 1)], "k string, v int"), ["k"], ["seq"])
    with pytest.raises(ValueError, match="keys differ"):
        one.join(Relation(one.df, ("v",)))
    assert table(one.transform(lambda r: r.map(v=F.col("v") * 2), lambda r: r.filter(F.col("v") > 5))) == {"": 6}


def test_combine_latest_and_lookup(spark):
    left = spark.createDataFrame([("u", 1, 10), ("u", 4, 11), ("w", 1, 1)], "p string, seq int, a int")
    right = spark.createDataFrame([("u", 2, 20), ("u", 3, 21)], "p string, seq int, b int")
    got = streams.combine_latest(left, right, ["seq"], "a", "b", ["p"]).orderBy("seq").collect()
    assert [(r.seq, r.a, r.b) for r in got] == [(2, 10, 20), (3, 10, 21), (4, 11, 21)]
    elements = spark.createDataFrame([("A", 2, "e2"), ("A", 4, "e4"), ("A", 6, "e6"), ("B", 9, "e9")], "k string, seq int, e string")
    log = spark.createDataFrame([("A", 1, "U", 1), ("A", 3, "D", None), ("A", 5, "U", 5)], "k string, seq int, op string, v int")
    got = streams.lookup_asof(elements, log, ["k"], ["seq"]).collect()
    assert sorted((r.e, r.v) for r in got) == [("e2", 1), ("e6", 5)]
    assert [r.x for r in streams.map_concat(spark.createDataFrame([([1, 2],), ([],), (None,)], "a array<int>"), "x", F.col("a")).collect()] == [1, 2]
