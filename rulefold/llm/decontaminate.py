"""Benchmark decontamination: word windows of a benchmark, looked for in every document.

Texts are normalised (A-Z lower-cased; words are runs of letters, digits and non-ASCII characters). The benchmark's
windows of `size` words form a hash set that is broadcast; each task slides the same window over its documents,
looks the hashes up and verifies each hit against the words themselves. An item of fewer words than a window, but not
none, is one window of its own length. No shuffle takes place.

The broadcast is bounded: the benchmark is dealt by item into blocks of about MOST_BYTES of text, and the documents are
scanned once for each block (one block for any usual benchmark), the intermediate result going to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.llm import bytes as B
from rulefold.session import stored

SIZE = 10
MOST_BYTES = 32_000_000
_LOWER_BYTE = B.BYTE[B.LOWER]
_BITS = 22


class Windows:
    """The distinct windows of some items: by length, sorted hashes with the normalised text and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        found: dict[bytes, set[str]] = defaultdict(set)
        lengths: dict[bytes, int] = {}
        for item, text in items:
            raw = B.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = B.words(raw, np.array([0, len(raw)]), B.LETTERS_DIGITS)
            words = [raw[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            n = min(size, len(words))
            for i in range(len(words) - n + 1) if n else ():
                window = b" ".join(words[i : i + n])
                found[window].add(item)
                lengths[window] = n
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.texts = list(found)
        self.items = [sorted(found[w]) for w in self.texts]
        for n in sorted(set(lengths.values())):
            index = np.array([i for i, w in enumerate(self.texts) if lengths[w] == n])
            data = np.frombuffer(b"\n".join(self.texts[i] for i in index), np.uint8)
            starts, ends, _ = B.words(data, np.array([0, len(data)]), B.LETTERS_DIGITS)
            hashes = B.run_hashes(B.span_hashes(B.prefix_sums(data, _LOWER_BYTE), starts, ends), n)[::n]
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = hashes[order], index[order]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Words' starts and ends, first words of the texts, and verified hits (first word, words, window)."""
        starts, ends, first = B.words(data, offsets, B.LETTERS_DIGITS)
        hashes = B.span_hashes(B.prefix_sums(data, _LOWER_BYTE), starts, ends)
        counts = np.diff(first)
        left = np.repeat(first[1:], counts) - np.arange(len(starts))  # words from here to the end of the text
        out, raw = [], None
        for n, (known, index) in self.by_length.items():
            runs = B.run_hashes(hashes, n)
            maybe = np.zeros(1 << _BITS, bool)
            maybe[known >> np.uint64(64 - _BITS)] = True
            at = np.flatnonzero(maybe[runs >> np.uint64(64 - _BITS)])
            at = at[left[at] >= n]
            low, high = np.searchsorted(known, runs[at]), np.searchsorted(known, runs[at], "right")
            for i, a, b in zip(at[high > low], low[high > low], high[high > low], strict=True):
                raw = B.LOWER[data] if raw is None else raw
                window = b" ".join(raw[s:e].tobytes() for s, e in zip(starts[i : i + n], ends[i : i + n], strict=True))
                out += [(int(i), n, int(w)) for w in index[a:b] if self.texts[w] == window]
        return starts, ends, first, out


def _scan(docs: DataFrame, windows: Windows, text: str, cut: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    earlier = "spans" in docs.columns

    def make():
        known = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            column = batch.column(text)
            totals, hit_counts, spans, items, kept = [], [], [], [], []
            for low, high, data, offsets in B.text_slices(column):
                starts, ends, first, found = known.hits(data, offsets)
                by_text = defaultdict(list)
                rows = np.searchsorted(first, [f[0] for f in found], "right") - 1
                for row, hit in zip(rows, found, strict=True):
                    by_text[int(row)].append(hit)
                totals.append(np.diff(first))
                for row in range(high - low):
                    hits = by_text.get(row, [])
                    cover = [(i - int(first[row]), i - int(first[row]) + n) for i, n, _ in hits]
                    names = {x for _, _, w in hits for x in known.items[w]}
                    if earlier:
                        cover += [(s["first"], s["last"]) for s in batch.column("spans")[low + row].as_py()]
                        names |= set(batch.column("items")[low + row].as_py())
                    merged: list[list[int]] = []
                    for a, b in sorted(cover):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    base = int(first[row])
                    begin = int(offsets[row])
                    spans.append(
                        [
                            {"first": a, "last": b, "start": int(starts[base + a]) - begin, "end": int(ends[base + b - 1]) - begin}
                            for a, b in merged
                        ]
                    )
                    hit_counts.append(sum(b - a for a, b in merged))
                    items.append(sorted(names))
                    if cut:
                        raw, at, parts = data[offsets[row] : offsets[row + 1]].tobytes(), 0, []
                        for s in spans[-1]:
                            parts.append(raw[at : s["start"]])
                            at = s["end"]
                        kept.append(b"".join([*parts, raw[at:]]).decode() if column[low + row].is_valid else None)
            made = {
                "n_words": pa.array(np.concatenate(totals) if totals else np.zeros(0, np.int64), pa.int64()),
                "n_hit": pa.array(hit_counts, pa.int64()),
                "items": pa.array(items, pa.list_(pa.string())),
                "spans": pa.array(spans, pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")]))),
            }
            return made | ({"kept_text": pa.array(kept, pa.string())} if cut else {})

        return run

    added = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:int,last:int,start:int,end:int>>"
    return B.extended(docs, added + (", kept_text string" if cut else ""), make)


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    size: int = SIZE, most_bytes: int = MOST_BYTES, cut: bool = False,
) -> DataFrame:
    """docs with n_words, n_hit (words inside hits), items (sorted ids, as strings, of items with an occurring window)
    and spans (maximal hit runs: words first to last and bytes start to end, ends exclusive); columns of those names
    are replaced. With cut=True also kept_text, the text without those spans.

    Null and empty texts have no words and no hits; null items are skipped; repeated rows stay repeated; an empty
    benchmark hits nothing; an empty table gives an empty one.
    """
    docs = docs.drop("spans", "items")
    chosen = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("words"))
    chosen = chosen.filter(F.col("item").isNotNull() & F.col("words").isNotNull())
    volume = chosen.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = 1 + volume // most_bytes
    state = docs
    for block in range(blocks):
        part = chosen if blocks == 1 else chosen.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = [(r["item"], r["words"]) for r in part.collect()]
        state = _scan(state, Windows(rows, size), text, cut)
        if block + 1 < blocks:
            state = stored(state, "decontaminate")
    return state


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """The documents without contamination, with the columns of docs.

    remove="documents" drops every document with a hit; remove="spans" keeps it without the hit spans.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # names of the operator's own columns may clash with those of docs, so docs travel in one struct
    packed = docs.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").alias("scanned"))
    found = scan(packed, benchmark, text="scanned", cut=remove == "spans", **options)
    if remove == "documents":
        return found.filter("n_hit = 0").select("row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    return found.select(
        *((F.col("kept_text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns)
    )


def digest(items: list[str]) -> str:
    """The digest of sorted item ids that the query's items_sha256 holds."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
