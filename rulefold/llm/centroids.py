"""Centroid clustering of whole-number vectors with Elkan's bounds: exact assignments, few distances.

Each vector keeps an upper bound of the distance to its centroid and a lower bound to every centroid. Moves of the
centroids loosen the bounds; distances between centroids and the bounds tell which centroids cannot be nearest. Bounds
are rounded outwards and a centroid is skipped only where it is strictly farther, so ties are decided on the exact
distances, in whole numbers. A round is a narrow job whose state is a table in the shared folder; only counts and sums
of each cluster reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rulefold.session import dropped, stored

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
#: Largest component in size, so that squared distances of up to 64 components fit into 64 bits.
LARGEST = 1 << 27
#: Outward rounding of bounds: above all rounding errors of one sum, root and product.
_UP, _DOWN = 1 + 2.0**-48, 1 - 2.0**-48


@dataclass(frozen=True)
class Bounds:
    """State of some vectors: number of the nearest centroid, upper bound to it, lower bounds to all."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to c, a centroid or one for each row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def first_bounds(x: np.ndarray, c: np.ndarray) -> Bounds:
    exact = np.stack([squared(x, own) for own in c], axis=1)
    cluster = exact.argmin(axis=1)  # the first of equals
    return Bounds(cluster, np.sqrt(exact[np.arange(len(x)), cluster].astype(float)) * _UP, np.sqrt(exact.astype(float)) * _DOWN)


def assigned(x: np.ndarray, c: np.ndarray, moves: np.ndarray, old: Bounds) -> tuple[Bounds, int]:
    """Bounds after the centroids moved to c by at most `moves`, and how many distances that took."""
    cluster = old.cluster.copy()
    upper = (old.upper + moves[cluster]) * _UP
    lower = np.maximum((old.lower - moves) * _DOWN, 0)
    half = np.stack([np.sqrt(squared(c, own).astype(float)) for own in c]) * (0.5 * _DOWN)
    np.fill_diagonal(half, np.inf)
    taken = 0
    open_rows = np.flatnonzero(upper >= half.min(axis=1)[cluster]) if len(c) > 1 else np.zeros(0, np.int64)
    able = (upper[open_rows, None] >= lower[open_rows]) & (upper[open_rows, None] >= half[cluster[open_rows]])
    rows = open_rows[able.any(axis=1)]
    exact = squared(x[rows], c[cluster[rows]])
    taken += len(rows)
    upper[rows] = np.sqrt(exact.astype(float)) * _UP
    lower[rows, cluster[rows]] = np.sqrt(exact.astype(float)) * _DOWN
    for j in range(len(c)):
        own = cluster[rows]
        k = np.flatnonzero((own != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= half[own, j]))
        at = rows[k]
        there = squared(x[at], c[j])
        taken += len(at)
        lower[at, j] = np.sqrt(there.astype(float)) * _DOWN
        nearer = (there < exact[k]) | ((there == exact[k]) & (j < cluster[at]))
        k, at = k[nearer], at[nearer]
        exact[k] = there[nearer]
        cluster[at] = j
        upper[at] = np.sqrt(exact[k].astype(float)) * _UP
    return Bounds(cluster, upper, lower), taken


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """key and `x`: floor(scale * component) of each vector with exactly `dimensions` components, all finite; the other
    rows go. A component beyond LARGEST raises an error when the rows are read."""
    col = F.col(f"`{vector}`")
    sound = F.forall(col, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))  # not a number is larger
    fits = F.forall(col, lambda v: F.abs(v.cast("double") * scale) < LARGEST)
    made = F.transform(col, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    kept = vectors.filter(F.when(F.size(col) == dimensions, sound).otherwise(False)).select(F.col(f"`{key}`").alias(key), col)
    return kept.select(key, F.when(fits, made).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("x"))


def first_centroids(vectors: DataFrame, key: str, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the `clusters` smallest SHA-256 of seed:key, in that order (equal keys: by components)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("name"), "x").orderBy("name", "x").limit(clusters).collect()
    return np.array([r.x for r in rows], np.int64)


_STATE = "cluster int, upper double, lower array<double>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _round(state: DataFrame, c: np.ndarray, moves: np.ndarray | None, last: bool) -> DataFrame:
    """State after an assignment to c; with `last` its exact distances in place of the bounds."""
    kept = [f for f in state.schema if f.name not in ("cluster", "upper", "lower") and not (last and f.name == "x")]
    schema = T.StructType(kept + list(T._parse_datatype_string("cluster int, distance bigint" if last else _STATE)))
    arrow, k = to_arrow_schema(schema), len(c)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), c.shape[1]).astype(np.int64)
            if moves is None:
                now = first_bounds(x, c)
            else:
                old = Bounds(b.column("cluster").to_numpy(), b.column("upper").to_numpy(), _matrix(b.column("lower"), k))
                now, _ = assigned(x, c, moves, old)
            made = [pa.array(now.cluster.astype(np.int32))]
            if last:
                made.append(pa.array(squared(x, c[now.cluster])))
            else:
                offsets = pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32))
                made += [pa.array(now.upper), pa.ListArray.from_arrays(offsets, pa.array(now.lower.ravel()))]
            columns = [b.column(f.name) for f in kept] + made
            yield pa.RecordBatch.from_arrays([v if v.type == f.type else v.cast(f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)

    return state.mapInArrow(run, schema)


def _moved(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster; empty clusters keep their centroid. Tasks add up their own rows first."""
    k, width = c.shape

    def sums(batches):
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, cluster = _matrix(b.column("x"), width), b.column("cluster").to_numpy()
            for j in range(k):
                own = cluster == j
                total[j] += x[own].sum(axis=0, dtype=np.int64)
                count[j] += own.sum()
        for j in np.flatnonzero(count):
            yield pa.RecordBatch.from_pylist([{"cluster": int(j), "n": int(count[j]), "s": total[j].tolist()}], pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    parts = state.select("x", "cluster").mapInArrow(sums, "cluster int, n bigint, s array<bigint>")
    added = parts.select("cluster", "n", F.posexplode("s").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = c.copy()
    for r in added.collect():  # clusters x dimensions
        out[r.cluster, r["at"]] = int(r.s) // r.n
    return out


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance: squared, to the cluster's centroid) of each usable vector, and the final centroids.

    Usable are vectors with exactly `dimensions` components, none null or not finite; their components become
    floor(scale * x). Centroids 0, 1, ... start as the vectors whose keys have the smallest hashes; each round assigns
    every vector to the nearest centroid (ties: the smaller number), then moves each centroid that has vectors to the
    floor of their mean. After the rounds, vectors are assigned once more. Rounds end early once no centroid moves,
    as all later ones would be the same. Fewer vectors than clusters make as many centroids; no usable vector gives an
    empty table and no centroid; rows of equal or null keys are vectors of their own; other columns are left out.
    """
    rows = whole(vectors, key, vector, dimensions, scale)
    c = first_centroids(rows, key, clusters, seed)
    if not len(c):
        return rows.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), c
    state, moves = rows, None
    for _ in range(rounds):
        before = state
        state = stored(_round(before, c, moves, False), "bounds")
        dropped(before)
        now = _moved(state, c)
        moves = np.sqrt(squared(now, c).astype(float)) * _UP
        c = now
        if not moves.any():
            break
    return _round(state, c, moves, True), c
