"""Token ids of whole texts by the tokenizers library, through a bounded cache of text chunks.

The pre-tokenizers of both supported kinds of vocabulary never join what stands on two sides of certain places (between
a word and white space, between letters and ASCII punctuation). Texts are cut at such places with numpy; equal chunks
are encoded once, by the library, many in one call; the ids of a text are those of its chunks in a row. A vocabulary
file of another kind, and a text that may hold special tokens, goes to the library as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from rulefold.llm import bytes as B

CACHE = 1_200_000
END = 0
_SPACE = ~B.NOT_SPACE
_LETTER = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_PUNCT = np.array([33 <= b <= 126 and chr(b) != "'" and not _LETTER[b] for b in range(256)])
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE_SPACE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_PLAIN = re.compile(r" ?\S+")


def _kind(spec: dict) -> str:
    """How texts may be cut: 'byte' and 'word' as below, or 'whole'."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"]["type"] != "BPE" or spec["model"].get("unk_token") or spec.get("truncation") or spec.get("padding"):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
    parts = [x["type"] for x in pre.get("pretokenizers", [])]
    drops = parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("invert") and pre["pretokenizers"][0]["behavior"] == "Removed"
    if steps == ["NFC", "Replace", "Lowercase"] and drops and spec["model"].get("end_of_word_suffix"):
        return "word"
    return "whole"


class Encoder:
    """Ids of texts for one vocabulary file (its JSON text); keeps its cache between calls."""

    _made: dict[int, Encoder] = {}

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.kind = _kind(parsed)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if top <= 65_536 else np.uint32
        self.width = np.zeros(top, np.int64)  # bytes that a token stands for
        suffix = parsed["model"].get("end_of_word_suffix") or ""
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix(suffix) if suffix else token)
        self.clear()

    @classmethod
    def of(cls, spec: str) -> Encoder:
        """One encoder for each vocabulary and process."""
        key = hash(spec)
        if key not in cls._made:
            cls._made[key] = cls(spec)
        return cls._made[key]

    def clear(self) -> None:
        # entry 0 is the end of a text
        self.keys = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.size = np.ones(1, np.int64)
        self.flat = np.array([END], self.dtype)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_ids(self, chunks: list[str]) -> list[np.ndarray]:
        plain = [i for i, c in enumerate(chunks) if _PLAIN.fullmatch(c) and not c.endswith(" ")]
        out: list = [None] * len(chunks)
        mark = "\n" if self.kind == "byte" else " "
        for low in range(0, len(plain), 4_000):
            some = plain[low : low + 4_000]
            joined = mark.join(chunks[i] for i in some)
            ids = np.array(self._library([joined])[0], np.int64)
            seen = joined if self.kind == "byte" else self.tokenizer.normalizer.normalize_str(joined)
            sizes = np.array([len(x.encode()) for x in seen.split(mark)], np.int64)
            gap = 1 if self.kind == "byte" else 0  # white space has a token only in the first kind
            begin = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
            edges = np.concatenate([[0], np.cumsum(self.width[ids])])
            a, b = np.searchsorted(edges, begin), np.searchsorted(edges, begin + sizes)
            if len(sizes) != len(some) or b.max() >= len(edges) or (edges[a] != begin).any() or (edges[b] != begin + sizes).any():
                for i, x in zip(some, self._library([chunks[i] for i in some]), strict=True):
                    out[i] = np.array(x, self.dtype)
                continue
            ids = ids.astype(self.dtype)
            for i, x, y in zip(some, a, b, strict=True):
                out[i] = ids[x:y]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._library([chunks[i] for i in rest]) if rest else [], strict=True):
            out[i] = np.array(x, self.dtype)
        return out

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        ids = self._chunk_ids(chunks)
        sizes = np.array([len(x) for x in ids], np.int64)
        entries = np.arange(len(self.size), len(self.size) + len(ids))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, *ids])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, place, keys), np.insert(self.entry, place, entries)

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start: at each text and at places that the pre-tokenizer never joins."""
        space, letter, punct = _SPACE[data], _LETTER[data], _PUNCT[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # accented Latin letters' second byte
        start = np.zeros(len(data), bool)
        after = np.zeros(len(data), bool)  # the byte before belongs to a word or is ASCII punctuation
        after[1:] = letter[:-1] | punct[:-1]
        start[1:] = letter[:-1] & punct[1:] | punct[:-1] & letter[1:] & (data[1:] < 128)
        if self.kind == "word":
            start[1:] |= space[:-1] != space[1:]
        else:
            solid = ~space & ~_MAYBE_SPACE[data]
            start |= space & after
            start[1:] |= solid[1:] & space[:-1] & (data[:-1] != 32)
            start[:-1] |= space[:-1] & solid[1:]  # only the last white space before a word stands alone
            start[1:] &= ~((data[:-1] == 32) & ~space[1:])  # a blank goes with what follows
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(start)

    def encode(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the column: the ids of its texts in a row, each text followed by END, and their offsets.
        A null text is empty."""
        return list(self.slices(column))

    def slices(self, column: pa.Array):
        for low, high, data, offsets in B.text_slices(column):
            whole = self._whole_rows(data, offsets)
            if self.kind == "whole" or whole:
                yield self._rarely(data, offsets, whole if self.kind != "whole" else range(high - low))
            else:
                yield self._slice(data, offsets)
            B.give_back()  # else a worker that has encoded 0.1 GB keeps some 150 MB that it does not use

    def _whole_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that may hold special tokens."""
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else []
        return sorted({int(x) for x in np.searchsorted(offsets, marks, "right") - 1})

    def _rarely(self, data: np.ndarray, offsets: np.ndarray, whole) -> tuple[np.ndarray, np.ndarray]:
        parts, whole = [], set(whole)
        for i in range(len(offsets) - 1):
            own = data[offsets[i] : offsets[i + 1]]
            if i in whole:
                ids = self._library([own.tobytes().decode()])[0]
                parts.append(np.array([*ids, END], self.dtype))
            else:
                parts.append(self._slice(own, np.array([0, len(own)]))[0])
        sizes = np.array([len(x) for x in parts], np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._cut(data, offsets)
        first = np.searchsorted(starts, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        if self.kind == "word":
            kept = ~_SPACE[data[starts]] if len(starts) else np.zeros(0, bool)
            first = np.concatenate([[0], np.cumsum(kept)])[first]
            starts, ends = starts[kept], ends[kept]
        seen = B.LOWER if self.kind == "word" else B.SAME
        hashes = B.rehash_long(B.span_hashes(B.prefix_sums(data, B.BYTE[seen]), starts, ends), data, starts, ends, seen)
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(keys[new], [raw[starts[i] : ends[i]].decode() for i in index[new]])
        entries = self.entry[np.searchsorted(self.keys, keys)][inverse] if len(keys) else np.zeros(0, np.int64)
        entries = np.insert(entries, first[1:], 0)
        sizes = self.size[entries]
        after = np.cumsum(sizes)
        take = np.repeat(self.at[entries] - after + sizes, sizes) + np.arange(after[-1])
        ends_at = first[1:] + np.arange(len(first) - 1)
        return self.flat[take], np.concatenate([[0], after[ends_at]])
