"""Packing token pieces into sequences: a configuration linear program over the histogram of lengths.

Only the histogram (at most `capacity` counts) reaches the driver. There a covering program over configurations (sets
of lengths that fit one sequence) is solved approximately by multiplicative weights: lengths not yet covered weigh
more, a knapsack dynamic program prices the best configuration, and for each length the best one that holds it. The
solution is rounded, and the rest solved again, until the program places little more; best fit places the few pieces
left over (2 % of the sequences of the sf0.1 documents, 4 % of those of a hundred times their counts). The
plan says for each length which ranks go to which configuration; pieces are ranked within their length by window
functions over salted buckets, so a length that holds a third of all pieces is many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulefold.llm import bytes as B
from rulefold.llm.tokens import Encoder
from rulefold.session import stored

CAPACITY = 2_048
ROUNDS = 120
STEP = 0.25
NEAR = 0.1
GOOD = 0.995
LITTLE = 0.01
BUCKET = 5_000

Configuration = tuple[tuple[int, int], ...]  # (length, copies), longest first


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """value[l]: worth of a piece of length l (-inf: none). Best worth for each room, and the length to put there first
    (0: leave one place empty)."""
    best, choice = np.zeros(len(value)), np.zeros(len(value), np.int64)
    for room in range(1, len(value)):
        worth = value[1 : room + 1] + best[room - 1 :: -1] if room > 1 else value[1:2] + best[:1]
        k = int(worth.argmax())
        if worth[k] > best[room - 1]:
            best[room], choice[room] = worth[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, choice


def traced(choice: np.ndarray, room: int, held: Counter) -> Configuration:
    while room > 0:
        if choice[room]:
            held[int(choice[room])] += 1
        room -= int(choice[room]) or 1
    return tuple(sorted(held.items(), reverse=True))


def solve(counts: np.ndarray, rounds: int = ROUNDS, near: float = NEAR) -> dict[Configuration, tuple[float, float]]:
    """Configurations that together cover every length about once (counts[l] pieces of length l): amount, and worth at
    the prices it was chosen at as a share of the best configuration's.

    Prices start in proportion to the lengths (what perfect sequences would pay) and fall as a length gets covered. Each
    round prices the best configuration that holds each length and takes the good ones that share no length.
    """
    capacity, there = len(counts) - 1, counts > 0
    per = np.where(there, counts, 1).astype(float)
    covered = np.zeros(len(counts))
    amounts: dict[Configuration, tuple[float, float]] = {}
    if not there.any():
        return amounts
    rooms = capacity - np.arange(len(counts))
    for _ in range(rounds):
        weight = np.arange(len(counts)) / capacity * np.exp(-(covered - covered[there].min()))
        value = np.where(there, weight, -np.inf)
        best, choice = knapsack(value)
        held = np.where(there, value + best[rooms], -np.inf)
        touched: set[int] = set()
        for length in np.argsort(-held, kind="stable")[: int(there.sum())]:
            if held[length] < (1 - near) * best[capacity] and touched:
                break
            if length in touched:
                continue
            config = traced(choice, capacity - int(length), Counter({int(length): 1}))
            if any(x in touched for x, _ in config):
                continue
            touched.update(x for x, _ in config)
            amount = STEP * min(per[x] / a for x, a in config)
            before, worth = amounts.get(config, (0.0, 0.0))
            amounts[config] = before + amount, max(worth, held[length] / best[capacity])
            for x, a in config:
                covered[x] += a * amount / per[x]
        if covered[there].min() >= 1:
            break
    return amounts


def best_fit(counts: np.ndarray) -> Counter[Configuration]:
    """Best fit, longest first, equal sequences together."""
    capacity = len(counts) - 1
    bins: dict[int, Counter[Configuration]] = {}
    rooms: list[int] = []

    def put(room: int, config: Configuration, n: int) -> None:
        if room not in bins:
            bins[room] = Counter()
            insort(rooms, room)
        bins[room][config] += n

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            if at < len(rooms):
                config = next(iter(bins[room]))
                there = bins[room][config]
            else:
                config, there = (), left
            each = min(room // length, left)
            n = min(there, left // each)
            if at < len(rooms):
                bins[room][config] -= n
                if not bins[room][config]:
                    del bins[room][config]
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            put(room - length * each, (*config, (length, each)), n)
            left -= n * each
    return sum(bins.values(), Counter())


def fill(config: Configuration) -> int:
    return sum(x * a for x, a in config)


def programmed(counts: np.ndarray) -> tuple[Counter[Configuration], np.ndarray]:
    """Sequences by configuration from the rounded program, and the pieces they leave.

    A solution is rounded from its largest amounts on: full configurations up (to one at least), as long as pieces last,
    others down, and only those worth what the best one is. What is left is solved again until little more is placed.
    """
    capacity, left = len(counts) - 1, counts.astype(np.int64).copy()
    chosen: Counter[Configuration] = Counter()
    while left.any():
        placed = 0
        amounts = solve(left)
        for config in sorted(amounts, key=lambda c: (-fill(c), -amounts[c][0], c)):
            amount, worth = amounts[config]
            whole = max(1, int(amount)) if fill(config) == capacity else int(amount) if worth >= GOOD else 0
            n = min(whole, *(int(left[x]) // a for x, a in config))
            if n:
                chosen[config] += n
                placed += n
                for x, a in config:
                    left[x] -= n * a
        if placed <= LITTLE * sum(chosen.values()):
            break
    return chosen, left


def configurations(counts: np.ndarray) -> Counter[Configuration]:
    """Sequences by configuration, together exactly the pieces of counts."""
    chosen, left = programmed(counts)
    return chosen + best_fit(left)


@dataclass
class Plan:
    """For ranks of one length: ranges that start at low (keyed by length * 2**44 + rank), with the first sequence,
    pieces a sequence, and place of the first."""

    keys: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    @classmethod
    def of(cls, chosen: Counter[Configuration], capacity: int) -> Plan:
        used = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for config in sorted(chosen):
            n, offset = chosen[config], 0
            for length, each in config:
                rows.append(((length << 44) + int(used[length]), sequence, each, offset))
                used[length] += n * each
                offset += length * each
            sequence += n
        columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy()
        return cls(*columns, sequence)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 44) + rank, "right") - 1
        inside = (length << 44) + rank - self.keys[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. A null or empty text is one piece, the end id."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encoder = Encoder.of(shared.value)
        for batch in batches:
            low = 0
            for ids, offsets in encoder.slices(batch.column(1)):
                n = np.diff(offsets)
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                begin = offsets[:-1][doc] + start
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(begin, begin + length, strict=True)]
                keys = batch.column(0).take(pa.array(doc + low))
                columns = [keys, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])
                low += len(n)

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pieces of docs with sequence_id and offset; each sequence is filled without gaps from 0.

    vocabulary is the path of a tokenizers JSON file. Rows of equal keys are packed each; other columns are left out;
    an empty table gives an empty one.
    """
    made = stored(pieces(docs, vocabulary, capacity, text, key), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in made.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    plan = docs.sparkSession.sparkContext.broadcast(Plan.of(configurations(counts), capacity))
    # each length has as many buckets as its pieces fill, so they number no more than lengths and pieces / BUCKET
    buckets = F.split(F.lit(",".join(str(1 + n // BUCKET) for n in counts.tolist())), ",").cast("array<bigint>")
    salted = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(buckets, F.col("length"))).cast("int"))
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(bases, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within") - 1).alias("rank"))

    def make():
        known = plan.value

        def run(batch: pa.RecordBatch) -> dict:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = known.place(length, rank) if len(length) else (length, rank)
            return {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}

        return run

    return B.extended(ranked, "sequence_id bigint, offset bigint", make, drop=("rank",))
