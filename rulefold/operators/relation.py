"""Keyed tables described by changelogs, as DataFrames.

A changelog row has key columns, `op` ('U' upsert, 'D' delete), value columns and order columns that give a total order
per key. Folding it yields the table: the last row of each key wins, deletes leave nothing. All operators here work on
folded tables, so their results depend on tables alone, never on how changes interleave.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPSERT, DELETE = "U", "D"


def _values(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def last_changes(log: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """The last change of each key, deletes included: the shortest changelog with the same table, also for changes that
    are still to come and may be older."""
    missing = {*keys, *order, op} - set(log.columns)
    if missing:
        raise ValueError(f"the changelog lacks {sorted(missing)}")
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, *(f"last.{c}" for c in rest))


@dataclass(frozen=True)
class Relation:
    """A table with one row for each value of its key columns."""

    df: DataFrame
    keys: tuple[str, ...]

    @classmethod
    def from_changelog(cls, log: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> Relation:
        """Fold a changelog. The order columns stay as values; ties in the order are broken arbitrarily.

        Latest-wins is max_by, which combines before the shuffle, so a key with many changes costs one row a task.
        """
        last = last_changes(log, keys, order, op)
        return cls(last.filter(F.col(op) == UPSERT).drop(op), tuple(keys))

    @classmethod
    def empty(cls, spark: SparkSession, schema: str, keys: Sequence[str]) -> Relation:
        return cls(spark.createDataFrame([], schema), tuple(keys))

    @classmethod
    def pure(cls, spark: SparkSession, schema: str, row: tuple, keys: Sequence[str]) -> Relation:
        """One row, at the key it holds."""
        return cls(spark.createDataFrame([row], schema), tuple(keys))

    @property
    def values(self) -> list[str]:
        return _values(self.df, self.keys)

    def map(self, **columns: Column) -> Relation:
        """New values for each row; keys stay."""
        return Relation(self.df.select(*self.keys, *(c.alias(n) for n, c in columns.items())), self.keys)

    def filter(self, condition: Column) -> Relation:
        """Rows of the table where the condition holds. Unlike a filter on the changelog, a key whose last change does
        not match is gone."""
        return Relation(self.df.filter(condition), self.keys)

    def map_concat(self, name: str, array: Column) -> DataFrame:
        """A row for each element; rows without any vanish. The result has no unique key, so it is a DataFrame."""
        return self.df.select(*self.df.columns, F.explode(array).alias(name))

    def _other_values(self, other: Relation) -> None:
        if both := {c.lower() for c in self.values} & {c.lower() for c in other.values}:
            raise ValueError(f"both sides have {sorted(both)}; map() renames")

    def join(self, other: Relation) -> Relation:
        """Keys in both; values of both, whose names must differ."""
        self._same_keys(other)
        self._other_values(other)
        return Relation(self.df.join(other.df, list(self.keys)), self.keys)

    def outer_join(self, other: Relation, side: str = "side") -> Relation:
        """Keys in either; `side` is 'left', 'right' or 'both'. Names of values must differ."""
        self._same_keys(other)
        self._other_values(other)
        left = self.df.withColumn("__l", F.lit(True))
        right = other.df.withColumn("__r", F.lit(True))
        both = left.join(right, list(self.keys), "full_outer")
        tag = F.when(F.col("__r").isNull(), "left").when(F.col("__l").isNull(), "right").otherwise("both")
        return Relation(both.withColumn(side, tag).drop("__l", "__r"), self.keys)

    def join_foreign(self, other: Relation, foreign: str) -> Relation:
        """Each row with the row of `other` that its column `foreign` names; rows that match none vanish (so a key that
        moves to an unknown one is deleted downstream)."""
        if len(other.keys) != 1:
            raise ValueError("the other relation needs a single key column")
        right = other.df.withColumnRenamed(other.keys[0], "__key")
        joined = self.df.join(right, F.col(foreign) == F.col("__key")).drop("__key")
        return Relation(joined, self.keys)

    def zip_latest(self, stream: DataFrame, order: Sequence[str]) -> Relation:
        """Every row with the last element of a stream; nothing until the stream has one. One row is broadcast."""
        names = [c for c in stream.columns]
        last = stream.agg(F.max_by(F.struct(*names), F.struct(*order)).alias("last")).filter("last is not null").select("last.*")
        return Relation(self.df.crossJoin(F.broadcast(last)), self.keys)

    def combine(self, other: Relation, how: Callable[[Column, Column], Column]) -> Relation:
        """Keys in either; where both have a value column, how(left, right), else the one there is."""
        self._same_keys(other)
        names = self.values
        left = self.df.select(*self.keys, F.struct(*names).alias("__l"))
        right = other.df.select(*self.keys, F.struct(*names).alias("__r"))
        both = left.join(right, list(self.keys), "full_outer")

        def pick(c: str) -> Column:
            a, b = F.col(f"__l.{c}"), F.col(f"__r.{c}")
            return F.when(F.col("__l").isNull(), b).when(F.col("__r").isNull(), a).otherwise(how(a, b)).alias(c)

        return Relation(both.select(*self.keys, *map(pick, names)), self.keys)

    def changes_to(self, newer: Relation) -> DataFrame:
        """The changelog that turns this table into `newer`: keys, op, values (null for deletes). Equal rows, nulls
        included, give nothing."""
        self._same_keys(newer)
        names = self.values
        old = self.df.select(*self.keys, F.struct(*names).alias("__old"))
        new = newer.df.select(*self.keys, F.struct(*names).alias("__new"))
        both = old.join(new, list(self.keys), "full_outer").filter(~F.col("__old").eqNullSafe(F.col("__new")))
        op = F.when(F.col("__new").isNull(), DELETE).otherwise(UPSERT).alias("op")
        return both.select(*self.keys, op, *(F.col(f"__new.{c}").alias(c) for c in names))

    def changelog(self) -> DataFrame:
        """The table as upserts."""
        return self.df.withColumn("op", F.lit(UPSERT))

    def transform(self, *steps: Callable[[Relation], Relation]) -> Relation:
        """Apply relation -> relation functions in turn."""
        out = self
        for step in steps:
            out = step(out)
        return out

    def _same_keys(self, other: Relation) -> None:
        if self.keys != other.keys:
            raise ValueError(f"keys differ: {self.keys} and {other.keys}")


def merge_changelogs(*logs: DataFrame) -> DataFrame:
    """One changelog of all changes; folded, the last writer of each key wins, deletes included."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out
