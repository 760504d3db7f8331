"""SimHash near duplicates: fingerprints within a Hamming radius, found by balls that meet in the middle.

A fingerprint emits every variant within half the radius; two fingerprints share a variant exactly if they are within
the radius. Only distinct fingerprints emit, and their variants travel folded: a row (fingerprint, start of the variant)
stands for all its variants with that start, which the task unfolds, so a shuffle on the first w bits moves
1 + w + w (w - 1) / 2 rows a fingerprint instead of 2081. Starts that too many variants share are split by more bits,
down to single variants if need be (no more than 2081 distinct fingerprints can share one), so no group is unbounded.
Each group gives a forest of its links, never all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.llm import bytes as B
from rulefold.llm.components import components
from rulefold.session import dropped, stored

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Variants of an average group; a group of SPLIT times as many is split by STEP more bits.
TARGET = 1 << 19
SPLIT = 4
STEP = 6
#: Shingles hashed at a time.
CHUNK = 1 << 16


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a slice: a bit is set if it is in over half of the shingles' XXH64 values."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offsets, B.NOT_SPACE)
    texts, counts = len(offsets) - 1, np.diff(first)
    bits = np.zeros((texts, BITS), np.int64)
    if len(starts):
        to = np.cumsum(ends - starts + 1) - 1  # ends of the words when one space joins them
        start = to - (ends - starts)
        joined, word = np.full(int(to[-1]) + 1, 32, np.uint8), np.ones(int(to[-1]) + 1, bool)
        word[to] = False
        joined[word] = data[B.NOT_SPACE[data]]
        joined = joined.tobytes()
        owner = np.repeat(np.arange(texts), counts)
        place = np.arange(len(starts))
        left = first[1:][owner] - place
        lead = np.flatnonzero((left >= n) | (place == first[:-1][owner]))
        for low in range(0, len(lead), CHUNK):
            own = lead[low : low + CHUNK]
            spans = zip(start[own].tolist(), to[own + np.minimum(left[own], n) - 1].tolist(), strict=True)
            h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), ">u8", len(own))
            text = owner[own]
            edge = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            bits[text[edge]] += np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), edge, axis=0, dtype=np.int64)
    total = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    return np.packbits(2 * bits > total[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "simhash") -> DataFrame:
    """docs with the 64 bits of each text's fingerprint as a bigint; a null text and one without words have none set.
    A column of that name, in any case, is replaced."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            made = [fingerprints(data, offsets) for _, _, data, offsets in B.text_slices(batch.column(text))]
            return {name: pa.array(np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64))}

        return run

    return B.extended(docs, f"`{name}` bigint", make)


def masks(low: int, high: int, flips: int) -> list[int]:
    """All ways to flip up to so many of the bits low to high - 1."""
    return [sum(1 << b for b in own) for k in range(flips + 1) for own in combinations(range(low, high), k)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _finer(rows: DataFrame, level: int, to: int, half: int) -> DataFrame:
    """Rows (f, v), v being f with flips in its first `level` bits, for all flips in the first `to` bits."""
    flips = F.explode(F.array(*(F.lit(_signed(m)) for m in masks(BITS - to, BITS - level, half)))).alias("flip")
    return rows.select("f", "v", flips).select("f", F.col("v").bitwiseXOR(F.col("flip")).alias("v")).filter(F.bit_count(F.col("f").bitwiseXOR(F.col("v"))) <= half)


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    return rows.withColumn("start", F.shiftrightunsigned("v", BITS - level))


def unfolded(f: np.ndarray, spent: np.ndarray, free: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The last `free` bits of all variants of fingerprints that have spent some flips, and whose they are."""
    tail = f & np.uint64((1 << free) - 1)
    made, owner = [], []
    for k in range(half + 1):
        own = np.flatnonzero(spent == k)
        flips = np.array(masks(0, free, half - k), np.uint64)
        made.append((tail[own][:, None] ^ flips).ravel())
        owner.append(np.repeat(own, len(flips)))
    return np.concatenate(made), np.concatenate(owner)


def forest(f: np.ndarray, spent: np.ndarray, free: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (of, to): every fingerprint that shares a variant, and the first of those it is connected with."""
    variant, owner = unfolded(f, spent, free, half)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    edge = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    size = np.diff(np.r_[edge, len(variant)])
    shared = np.repeat(size > 1, size)
    owner, size = owner[shared], size[size > 1]
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.cumsum(size) - size
    head = np.repeat(np.minimum.reduceat(owner, edge), size)
    near = np.bitwise_count(f[owner] ^ f[head]) <= 2 * half  # so it is, by the way over the variant
    of, to = owner[near], head[near]
    label = np.arange(len(f))
    while True:  # least index along the links
        least = label.copy()
        np.minimum.at(least, of, label[to])
        np.minimum.at(least, to, label[of])
        least = least[least]
        if (least == label).all():
            break
        label = least
    own = np.flatnonzero(label != np.arange(len(f)))
    return own, label[own]


def _group(free: int, half: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        f, v = (table[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("f", "v"))
        of, to = forest(f, np.bitwise_count(f ^ v), free, half)
        f = f.view(np.int64)
        return pa.table([pa.array(f[of]), pa.array(f[to])], names=["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, target: int = TARGET, step: int = STEP) -> DataFrame:
    """Links (u, v) that connect the same fingerprints (column f, distinct) as all pairs within the radius do; stored."""
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("the radius is an even number up to 8")
    half = radius // 2
    all_variants = len(masks(0, BITS, half))
    level = max(6, min(40, math.ceil(math.log2(max(1, distinct.count() * all_variants / target)))))
    rows = _finer(distinct.select("f", F.col("f").alias("v")), 0, level, half)
    found, kept = None, []
    while True:
        free = BITS - level
        keyed = _keyed(rows, level)
        if level < BITS:
            weights = F.array(*(F.lit(len(masks(0, free, half - k))) for k in range(half + 1)))
            weight = F.element_at(weights, F.bit_count(F.col("f").bitwiseXOR(F.col("v"))) + 1)
            heavy = stored(keyed.groupBy("start").agg(F.sum(weight).alias("n")).filter(F.col("n") > SPLIT * target).select("start"), "heavy")
            kept.append(heavy)
            light = keyed.join(heavy, "start", "left_anti")
        else:
            heavy, light = None, keyed
        made = light.groupBy("start").applyInArrow(_group(free, half), "u bigint, v bigint")
        found = made if found is None else found.unionByName(made)
        if heavy is None or heavy.isEmpty():
            break
        to = min(BITS, level + step)
        rows = stored(_finer(keyed.join(heavy, "start", "left_semi").select("f", "v"), level, to, half), "finer")
        kept.append(rows)
        level = to
    out = stored(found.distinct(), "links")
    dropped(*kept)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row a document: key, simhash (bigint), component_id (least key of all documents that links lead to, its own
    included), for links between fingerprints that differ in at most `radius` bits.

    A null or blank text has fingerprint zero and links like any other; copies and repeated rows share a component; a
    null key is never the least one (a component of such rows alone has none); an empty table gives an empty one; other
    columns are left out.
    """
    read = stored(with_fingerprint(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))).select("key", F.col("simhash").alias("f")), "fingerprints")
    distinct = stored(read.groupBy("f").agg(F.min("key").alias("least")), "distinct")
    found = links(distinct.select("f"), radius)
    roots = components(found)
    rooted = distinct.join(roots, distinct["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    info = stored(rooted.join(least, "root").select("f", "component_id"), "components")
    dropped(distinct, found, roots)
    return read.join(info, "f").select(F.col("key").alias(key), F.col("f").alias("simhash"), "component_id")
