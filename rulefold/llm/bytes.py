"""Words of Arrow text columns, found and hashed with numpy over the UTF-8 bytes.

Everything works on slices of a column: whole documents, together about SLICE bytes (a longer document forms a
slice alone), so that memory is bounded by the larger of SLICE and the longest document. Workers are reused by later
stages, and what their allocators keep of freed memory counts against the executor's; give_back() returns it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE = 1_500_000
#: Bytes from which a word has a hash of its own kind.
LONG = 64
_RANDOM = np.random.RandomState(20_240_229)
BYTE = _RANDOM.randint(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
WORD_BASE = np.uint64(0xD1B54A32D192ED03)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of words that are letters, digits or anything beyond ASCII.
LETTERS_DIGITS = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of words that end at ASCII white space.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers below n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        made = []
        for base in (BASE, BASE_INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.cumprod(out, out=out))
        if size > 4 * SLICE:
            return made[0], made[1]  # for one very long document; not kept
        _powers = made[0], made[1]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    return prefix_sums_of(table[data])


def prefix_sums_of(weights: np.ndarray) -> np.ndarray:
    """Prefix sums that span_hashes() takes, of symbols with these weights."""
    out = np.zeros(len(weights) + 1, np.uint64)
    np.cumsum(weights * powers(len(weights) + 1)[0][: len(weights)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes that the sums belong to; equal bytes have equal hashes anywhere."""
    x = sums[ends]
    x -= sums[starts]
    x *= powers(len(sums))[1][starts]
    return mixed(x)


def rehash_long(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hashes of spans, with XXH64 (of the bytes that `table` gives) for those of LONG bytes or more: powers modulo
    2**64 cancel out in some long regular words, so that these have the hash of another one."""
    for i in np.flatnonzero(ends - starts >= LONG).tolist():
        hashes[i] = xxhash.xxh64_intdigest(table[data[starts[i] : ends[i]]].tobytes(), LONG)
    return hashes


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = words[n - 1 :].copy()
    for k in range(n - 2, -1, -1):
        out *= WORD_BASE
        out += words[k : k + m]
    return mixed(out)


def _trimmer() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        return None


_trim = _trimmer()


def give_back() -> None:
    """Returns to the system what Arrow's and the C library's allocators keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the texts in them) of each slice; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and for each text (and its end) the index of its first word."""
    inside = table[data]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def list_array(values: pa.Array | np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def extended(
    df: DataFrame, added: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]], drop: tuple = ()
) -> DataFrame:
    """df with columns that a function of Arrow batches adds; make() is called once a task and gives that function.

    Columns of df that share a name (in any case) with an added one are replaced; `drop` names columns to leave out.
    """
    added = T._parse_datatype_string(added) if isinstance(added, str) else added
    gone = {f.name.lower() for f in added} | {c.lower() for c in drop}
    kept = [f for f in df.schema if f.name.lower() not in gone]
    schema = T.StructType(kept + list(added))
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            new = function(batch)
            columns = [batch.column(c) for c in names] + [new[f.name] for f in added]
            yield pa.RecordBatch.from_arrays(
                [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return df.mapInArrow(run, schema)
