"""Incremental evaluation: snapshots and differences per micro-batch, and keyed operators with state.

Snapshot mode suits any relation: each micro-batch folds its changes into the base table, derives the relation with the
batch operators, and writes what changed. Paths carry the batch id, so a repeated batch writes the same result again.
State mode keeps the rows of single-key operators in the state store and emits changes at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from rulefold.operators.relation import Relation, last_changes, merge_changelogs
from rulefold.session import removed
from rulefold.streaming.keyed import packed, unpacked


class SnapshotQuery:
    """A derived relation that follows a stream of changes.

    `derive` maps the folded base relation to the derived one. Below `path`: base/<batch> (the last change of each key),
    derived/<batch> and changes/<batch> (a changelog with op). Only the last two snapshots of base and derived are kept.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str], derive: Callable[[Relation], Relation]) -> None:
        self.path, self.keys, self.order, self.derive = path, list(keys), list(order), derive

    def _earlier(self, spark: SparkSession, kind: str, batch: int, like: DataFrame) -> DataFrame:
        if batch == 0:
            return spark.createDataFrame([], like.schema)
        return spark.read.schema(like.schema).parquet(f"{self.path}/{kind}/{batch - 1}")

    def process(self, changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        log = merge_changelogs(self._earlier(spark, "base", batch, changes), changes)
        last = last_changes(log, self.keys, self.order)
        last.write.mode("overwrite").parquet(f"{self.path}/base/{batch}")  # with deletes: an older change may still come
        base = Relation.from_changelog(spark.read.schema(last.schema).parquet(f"{self.path}/base/{batch}"), self.keys, self.order)
        made = self.derive(base)
        made.df.write.mode("overwrite").parquet(f"{self.path}/derived/{batch}")
        new = Relation(spark.read.schema(made.df.schema).parquet(f"{self.path}/derived/{batch}"), made.keys)
        old = Relation(self._earlier(spark, "derived", batch, made.df), made.keys)
        old.changes_to(new).write.mode("overwrite").parquet(f"{self.path}/changes/{batch}")
        for kind in ("base", "derived"):  # a repeated batch reads the one before it
            removed(spark, f"{self.path}/{kind}/{batch - 2}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follow a streaming DataFrame of changes, by default until its input is used up."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


class _Filter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, present boolean")

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        seq, present = self.last.get() or (None, False)
        for r in sorted(rows, key=lambda r: r.seq):
            if seq is not None and r.seq < seq:
                continue
            if r.matches or present:
                yield Row(k=key[0], op="U" if r.matches else "D", seq=r.seq, own=r.own)
            seq, present = r.seq, r.matches
        self.last.update((seq, present))

    def close(self) -> None:
        pass


def stateful_filter(changes: DataFrame, keys: Sequence[str], condition: Column, order: str = "seq") -> DataFrame:
    """The changelog of a filtered relation from a streaming changelog: an upsert that stops matching becomes a delete,
    if the key was there. Changes older than the last one seen of their key are ignored. Needs the RocksDB state store."""
    matches = (F.col("op") == "U") & F.coalesce(condition, F.lit(False))
    fields = {f.name: f for f in changes.schema.fields}
    own = [f for c, f in fields.items() if c not in {*keys, "op", order}]
    rows = changes.select(packed([F.col(k) for k in keys]).alias("k"), F.col(order).cast("bigint").alias("seq"), matches.alias("matches"), packed([F.col(f"`{f.name}`") for f in own]).alias("own"))
    made = rows.groupBy("k").transformWithState(_Filter(), "k string, op string, seq bigint, own string", "Append", "None")
    made = made.select(*unpacked("k", [fields[k] for k in keys]), "op", F.col("seq").cast(fields[order].dataType).alias(order), *unpacked("own", own))
    return made.select(*changes.columns)


class _Join(StatefulProcessor):
    """State for each side: the order of its last change, whether it is there, and its values."""

    def __init__(self, outer: bool) -> None:
        self.enough = any if outer else all

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = {side: handle.getValueState(side, "seq bigint, there boolean, own string") for side in "lr"}

    def handleInputRows(self, key, rows, timer) -> Iterator[Row]:  # noqa: N802
        held = {side: state.get() or (None, False, None) for side, state in self.states.items()}
        for r in sorted(rows, key=lambda r: r.seq):
            if held[r.side][0] is not None and r.seq < held[r.side][0]:
                continue
            before = self.enough(v[1] for v in held.values())
            there = r.op == "U"
            held[r.side] = (r.seq, there, r.own if there else None)
            if self.enough(v[1] for v in held.values()):
                yield Row(k=key[0], op="U", seq=r.seq, l=held["l"][2], r=held["r"][2])
            elif before:
                yield Row(k=key[0], op="D", seq=r.seq, l=None, r=None)
        for side, state in self.states.items():
            if held[side][0] is not None:
                state.update(held[side])

    def close(self) -> None:
        pass


def stateful_join(left: DataFrame, right: DataFrame, key: str, order: str = "seq", outer: bool = False) -> DataFrame:
    """The changelog of the inner join of two relations from their streaming changelogs (key, op, order, values), or
    with `outer` of the full outer join (values of a missing side are null). Deletes come only for keys that were in the
    result; changes older than the last one seen of their key and side are ignored; the order of a result is that of
    the change that caused it. Value columns of the two sides have different names. Needs the RocksDB state store."""
    fixed = {key, "op", order}
    a, b = ([f for f in df.schema.fields if f.name not in fixed] for df in (left, right))
    if both_have := {f.name for f in a} & {f.name for f in b}:
        raise ValueError(f"both sides have {sorted(both_have)}")
    kind = left.schema[key]
    sides = [
        df.select(packed([F.col(key).cast(kind.dataType).alias(key)]).alias("k"), F.lit(tag).alias("side"), "op", F.col(order).cast("bigint").alias("seq"), packed([F.col(f"`{f.name}`") for f in own]).alias("own"))
        for df, tag, own in ((left, "l", a), (right, "r", b))
    ]
    made = sides[0].unionByName(sides[1]).groupBy("k").transformWithState(_Join(outer), "k string, op string, seq bigint, l string, r string", "Append", "None")
    return made.select(*unpacked("k", [kind]), "op", F.col("seq").cast(left.schema[order].dataType).alias(order), *unpacked("l", a), *unpacked("r", b))
