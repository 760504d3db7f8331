"""Operators on ordered elements without a key. Order is always explicit: columns that order the rows totally."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge(*streams: DataFrame) -> DataFrame:
    """All elements of all streams (bag semantics); the order columns tell how they interleave."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def map_concat(stream: DataFrame, name: str, array: Column) -> DataFrame:
    """An element for each item of an array; empty and null arrays give none."""
    return stream.select(*stream.columns, F.explode(array).alias(name))


def combine_latest(
    left: DataFrame, right: DataFrame, order: Sequence[str], left_value: str, right_value: str, partition: Sequence[str] = ()
) -> DataFrame:
    """The latest values of both sides whenever either changes, once both have one.

    Rows are partition, order, left_value and right_value. Without a partition the whole input is one ordered sequence,
    which Spark does in one task: give one wherever there is a key. Values must not be null (null means no change).
    """
    names = [*partition, *order]
    a = left.select(*names, F.col(left_value), F.lit(None).cast(right.schema[right_value].dataType).alias(right_value))
    b = right.select(*names, F.lit(None).cast(left.schema[left_value].dataType).alias(left_value), F.col(right_value))
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b)
    latest = both.select(*names, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in (left_value, right_value)))
    return latest.filter(F.col(left_value).isNotNull() & F.col(right_value).isNotNull())


def lookup_asof(elements: DataFrame, log: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """Each element with the row its key had at that point of the order: the last change at or before it. Elements
    whose key has no row then (none yet, or deleted) are dropped.

    Both sides go through one shuffle on the key and one sort: an as-of join without a range join.
    """
    own = [c for c in elements.columns if c not in {*keys, *order}]
    values = [c for c in log.columns if c not in {*keys, *order}]
    e = elements.select(*keys, *order, F.lit(1).alias("__side"), F.struct(*own).alias("__e"), F.lit(None).cast(_struct(log, values)).alias("__c"))
    c = log.select(*keys, *order, F.lit(0).alias("__side"), F.lit(None).cast(_struct(elements, own)).alias("__e"), F.struct(*values).alias("__c"))
    w = Window.partitionBy(*keys).orderBy(*order, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = e.unionByName(c).withColumn("__row", F.last("__c", ignorenulls=True).over(w))
    found = seen.filter((F.col("__side") == 1) & (F.col(f"__row.{op}") == "U"))
    return found.select(*keys, *order, "__e.*", *(f"__row.{v}" for v in values if v != op))


def _struct(df: DataFrame, names: Sequence[str]) -> str:
    return df.select(*names).schema.simpleString()


def named(df: DataFrame, name: str) -> DataFrame:
    """A label for plans and error messages; rows and columns are unchanged."""
    return df.alias(name)


def never(like: DataFrame) -> DataFrame:
    """A stream of the same columns that has no element, ever: merging it adds nothing, combining with it gives nothing."""
    return like.limit(0)


def from_sequence(spark: SparkSession, rows: Sequence[tuple], schema: str, order: str = "seq") -> DataFrame:
    """The elements of a local sequence with their place in it, from 0, as the column that orders them."""
    fields = T._parse_datatype_string(schema)
    placed = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(placed, T.StructType([*fields, T.StructField(order, T.LongType())]))
