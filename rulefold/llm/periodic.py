"""Periodic runs of words: stretches that repeat a period, found by masking and Main and Lorentz's divide and conquer.

A run of period q and length L repeats L - q words at a distance of q. With L >= max(LEAST, TIMES * q) that is K words
at least (16), so every word of a run lies in a K-gram that stands in the document twice. Words outside such K-grams
are masked; what is left are segments, and most documents have none. In a segment, a run crosses the middle of a block
that holds it, as in the divide and conquer of Main and Lorentz: for each middle and each period that the block can
hold, the common extensions to both sides of the middle give the run. All middles of a block size are tried together;
extensions come from hashes of 1, 2, 4, ... words, and each run is verified on the words (a hash can only make it
too long, and then other hashes are taken).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rulefold.llm import bytes as B

LEAST = 24
TIMES = 3


def least_overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words that a run repeats one period later, over all periods."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _salted(ids: np.ndarray, salt: int) -> np.ndarray:
    return B.mixed(ids.astype(np.uint64) * B.BASE + np.uint64(salt * 2 + 1))


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n words in a row from those of n."""
    return B.mixed(h[:-n] * B.WORD_BASE + (h[n:] ^ (h[n:] >> np.uint64(29)))) if len(h) > n else h[:0]


def _grams(ids: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of each k words in a row."""
    h, n = _salted(ids, salt), 1
    while 2 * n <= k:
        h, n = _doubled(h, n), 2 * n
    return B.mixed(h[: len(h) - (k - n)] * B.WORD_BASE + h[k - n :]) if k > n and len(ids) >= k else h


def segments(ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Stretches of words that lie in k-grams which stand in the sequence more than once."""
    if len(ids) <= k:
        return []
    grams = _grams(ids, k)
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return []
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    depth = np.zeros(len(ids) + 1, np.int64)
    depth[: len(grams)] += twice
    depth[k : k + len(grams)] -= twice
    edge = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(depth[:-1]) > 0).astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


class _Extensions:
    """How far a sequence agrees with itself from two places on, forwards and backwards."""

    def __init__(self, ids: np.ndarray, salt: int) -> None:
        self.n, self.hashes = len(ids), [_salted(ids, salt)]
        while 2 << len(self.hashes) - 1 <= self.n:
            self.hashes.append(_doubled(self.hashes[-1], 1 << len(self.hashes) - 1))

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j > i on."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.hashes) - 1, -1, -1):
            h = self.hashes[level]
            a, b = i + out, j + out
            fits = b < len(h)
            out += (fits & (h[np.where(fits, a, 0)] == h[np.where(fits, b, 0)])).astype(np.int64) << level
        return out

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before i and j > i."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.hashes) - 1, -1, -1):
            h = self.hashes[level]
            a, b = i - out - (1 << level), j - out - (1 << level)
            fits = a >= 0
            out += (fits & (h[np.where(fits, a, 0)] == h[np.where(fits, b, 0)])).astype(np.int64) << level
        return out


def _candidates(ext: _Extensions, least: int, times: int) -> np.ndarray:
    """(start, end, period) of what may be runs: each run crosses the middle of the largest block that holds it."""
    n, found = ext.n, []
    part = int(np.log2(least_overlap(least, times) // 2))
    near = ext.hashes[min(part, len(ext.hashes) - 1)]
    reach = 1 << min(part, len(ext.hashes) - 1)
    half = 1
    while 2 * half < least:
        half *= 2
    while half < n:
        middles = np.arange(half, n, 2 * half)
        periods = np.arange(1, 2 * half // times + 1)
        for low in range(0, len(middles), max(1, (1 << 20) // len(periods))):
            m = np.repeat(middles[low : low + max(1, (1 << 20) // len(periods))], len(periods))
            q = np.tile(periods, len(m) // len(periods))
            # one side of the middle has more than a period, so the words at the middle agree there ...
            first = ext.hashes[0]
            i = np.concatenate([m[(a := m + q < n)], (m - q)[(b := m - q > 0)]])
            p = np.concatenate([q[a], q[b]])
            at = np.concatenate([m[a], (m - q - 1)[b]])
            agree = first[at] == first[at + p]
            i, p = i[agree], p[agree]
            # ... and half of the least overlap agrees before or behind
            behind, before = i + p < len(near), i - reach >= 0
            agree = behind & (near[np.where(behind, i, 0)] == near[np.where(behind, i + p, 0)])
            agree |= before & (near[np.where(before, i - reach, 0)] == near[np.where(before, i + p - reach, 0)])
            i, p = i[agree], p[agree]
            start, end = i - ext.backwards(i, i + p), i + p + ext.forwards(i, i + p)
            long = end - start >= np.maximum(least, times * p)
            found.append(np.stack([start[long], end[long], p[long]], axis=1))
        half *= 2
    return np.concatenate([*found, np.zeros((0, 3), np.int64)])


def segment_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs (start, length, period) of a sequence, by start and period."""
    for salt in range(64):
        runs = _candidates(_Extensions(ids, salt), least, times)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        new = np.ones(len(runs), bool)  # multiples of the least period have the same ends
        new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
        runs = runs[new]
        if all((ids[a : b - q] == ids[a + q : b]).all() for a, b, q in runs.tolist()):
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
            return np.stack([runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    raise RuntimeError("64 hash functions in a row had equal values for different words")


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs (start, length, period) of a sequence of whole numbers (one for each distinct word), by start and period."""
    if times < 3:
        raise ValueError("a run holds its period three times or more")
    found = [np.zeros((0, 3), np.int64)]
    for a, b in segments(ids, least_overlap(least, times)):
        if b - a >= least:
            found.append(segment_runs(ids[a:b], least, times) + np.array([a, 0, 0]))
    return np.concatenate(found)


def _read(text: bytes, least: int, times: int) -> tuple[int, np.ndarray, bytes]:
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = runs(ids, least, times) if len(known) < len(words) else np.zeros((0, 3), np.int64)
    if len(found):
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, found[:, 0] + found[:, 2], 1)
        np.add.at(drop, found[:, 0] + found[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return len(ids), found, b" ".join(words)


def collapsed(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_words (between white space of ASCII), runs (array of start, length, period in words, by start and
    period) and collapsed: the words joined by one space, of each run only its first period's (a word that any run drops
    goes).

    A run is a stretch of words with least period q and at least max(least, times * q) words that no neighbouring word
    extends. Null, empty and blank texts have no words, no runs and an empty collapsed text; rows are judged each, so
    ids, ties and repeated rows do not matter; columns of these names, in any case, are replaced. A text is read as a
    whole; memory grows with its longest repetitive segment (8 bytes a word for each doubling of its length).
    """

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            n, spans, kept = [], [], []
            for value in pc.fill_null(batch.column(text).cast(pa.large_string()), ""):
                count, found, rest = _read(value.as_buffer().to_pybytes(), least, times)
                n.append(count)
                spans.append(found)
                kept.append(rest)
            flat = np.concatenate([*spans, np.zeros((0, 3), np.int64)])
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"])
            return {
                "n_words": pa.array(n, pa.int64()),
                "runs": B.list_array(parts, np.array([len(s) for s in spans], np.int64)),
                "collapsed": pa.array(kept, pa.large_binary()).cast(pa.large_string()),
            }

        return run

    return B.extended(docs, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", make)
