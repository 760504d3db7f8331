"""Sharding by a permutation-filled lookup table (consistent placement with near-equal shares).

Each shard derives a permutation of the slots of a prime-sized table from its name. Shards take turns, in the
order given, each claiming the first slot of its permutation that is still free, until no slot is free. A row goes
to the shard that owns the slot its key hashes to. Shares differ by at most one slot per weight unit, and adding or
dropping a shard moves little besides the slots that have to move.

The table is filled on the driver: its size is the parameter `size`, independent of the data. Placement is one
broadcast join on the slot, without a shuffle, so a hot source costs nothing: keys are spread one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
MOST_SLOTS = 2_000_000


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def digest_number(text: str) -> int:
    """The first 60 bits of the MD5 of a text, as slot_of computes them in SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """Slot -> index of its shard. A shard of weight w takes w turns a round.

    Raises ValueError for no shards, repeated names, weights below 1, a size that is not a prime larger than the
    sum of weights, or one beyond MOST_SLOTS (the table is broadcast).
    """
    weights = list(weights or [1] * len(shards))
    if not shards or len(set(shards)) != len(shards) or len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("shards must be distinct names with a weight of 1 or more each")
    if not is_prime(size) or not sum(weights) < size <= MOST_SLOTS:
        raise ValueError(f"size must be a prime above the sum of weights and at most {MOST_SLOTS}")
    at = [digest_number(f"{name}/offset") % size for name in shards]
    step = [digest_number(f"{name}/skip") % (size - 1) + 1 for name in shards]
    owner = [-1] * size
    free = size
    while free:
        for shard, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                while owner[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % size
                owner[at[shard]] = shard
                free -= 1
    return owner


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size. A null key counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(size))


def place(
    docs: DataFrame, shards: Sequence[str], key: str = "doc_id", size: int = SLOTS, weights: Sequence[int] | None = None
) -> DataFrame:
    """docs with slot (bigint) and shard (string) appended; columns of those names are replaced.

    Equal keys share a shard, repeated rows stay repeated, null keys share the slot of the empty text, an empty
    table gives an empty one. Texts are never read for the placement.
    """
    spark = docs.sparkSession
    owners = ",".join(map(str, lookup_table(shards, size, weights)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("__slot", "__owner"))
    table = table.select(F.col("__slot").cast("bigint"), F.element_at(names, F.col("__owner").cast("int") + 1).alias("__shard"))
    rest = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    keyed = docs.select(*(F.col(f"`{c}`") for c in rest), slot_of(F.col(f"`{key}`"), size).alias("slot"))
    placed = keyed.join(F.broadcast(table), keyed["slot"] == table["__slot"], "left")
    return placed.select(*(F.col(f"`{c}`") for c in rest), "slot", F.col("__shard").alias("shard"))


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write one folder per shard. Rows of a shard are dealt over many tasks (slots of one shard differ), so a large
    shard is never one task; a file holds rows_per_file rows at most."""
    dealt = placed.repartition("slot")
    dealt.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
