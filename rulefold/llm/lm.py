"""Language-model scoring by a weighted backoff automaton over smoothed n-grams learnt from the corpus itself.

States are histories seen in training: the root (none), the start of a text, every word, and every two words in a row. A
state has an arc for each word that followed it in training and a failure arc to the state of its history without the
first word (the root in the end). With c() counts over all training texts,

    root arc      P(w)      = (c(w) + 1/2) / (N + (V + 1) / 2)               one unknown word included
    arc of v      P(w | v)  = (c(v w) + K1 P(w)) / (c(v) + K1)               failure arc: K1 / (c(v) + K1)
    arc of u v    P(w | uv) = (c(u v w) + K2 P(w | v)) / (c(u v) + K2)       failure arc: K2 / (c(u v) + K2)

so the arcs of each state and what failure adds sum to 1. A text is traversed once from its start to its end token; the
state carried on is the longest known history, and a token is charged the failure arcs down to the first state that has
an arc for it, then that arc. Whole slices of texts are traversed at a time, order by order: the state before a token
depends on training counts of the tokens before it alone.

Counting and scoring are one dataflow over blocks of documents (about BLOCK bytes each, by a hash of key and text). A
block sends its distinct n-grams of every order with its training counts, packed by ranges of the n-gram's key; each
range is added up by one task; what the other blocks counted goes back in the order of the block's own keys (a history's
count is the total of its own n-gram, or the number of texts); then each block, with its texts and totals, is scored alone. So what
moves grows with the corpus, no n-gram is dropped, the vocabulary is never broadcast, and frequent n-grams are
pre-aggregated. Keys of n-grams are their order and 56 bits of a hash.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.llm import bytes as B

#: K1 and K2: how many counts the shorter history's distribution is worth in a state of one word, and of two.
CONCENTRATION = (5_000.0, 8.0)
ORDERS = len(CONCENTRATION) + 1
BLOCK = 12_000_000
KEY_BITS = 56
_LOWER_BYTE = B.BYTE[B.LOWER]
START = np.uint64(0x517A5E1F00D5EED1)
END = np.uint64(0x0E9D0FF17E5EED02)
_LONGER = np.uint64(0xA24BAED4963EE407)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of a slice (each text's words, lower-cased, then END) and first token of each text."""
    starts, ends, first = B.words(data, offsets, B.NOT_SPACE)
    keys = np.insert(B.span_hashes(B.prefix_sums(data, _LOWER_BYTE), starts, ends), first[1:], END)
    return keys, first + np.arange(len(first))


def _all_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    keys, firsts, done = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in B.text_slices(column):
        k, first = tokens_of(data, offsets)
        keys.append(k)
        firsts.append(first[1:] + done)
        done += len(k)
    return np.concatenate(keys), np.concatenate(firsts)


def _tagged(hashes: np.ndarray, order: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - KEY_BITS)) | np.uint64(order << KEY_BITS)


def _grams(tokens: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each order the key of the n-gram that ends at each token. A text's first token has no history but START, and
    so no n-gram of three: those places get the key of none."""
    hashes = [tokens]
    for order in range(2, ORDERS + 1):
        longer = np.empty_like(tokens)
        longer[1:] = hashes[-1][:-1]
        longer[first[:-1]] = START
        longer *= _LONGER
        longer += tokens
        hashes.append(B.mixed(longer))
        if order > 2:
            hashes[-1][first[:-1]] = 0
    return [_tagged(h, k) for k, h in enumerate(hashes, 1)]


_START_KEY = _tagged(START, 1)


class _Block:
    """Texts of a block as n-grams: for each order the distinct keys, the place of each token's among them, and their
    training counts within the block."""

    def __init__(self, table: pa.Table) -> None:
        parts = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in table["rows"].combine_chunks()]
        rows = pa.concat_tables(parts).combine_chunks()
        self.doc_id, self.train = rows["doc_id"], rows["train"]
        text = rows["text"]
        tokens, self.first = _all_tokens(text.chunk(0) if text.num_chunks == 1 else pa.concat_arrays(text.chunks))
        del parts, rows, text
        learnt = np.repeat(self.train.to_numpy().astype(bool), np.diff(self.first))
        self.keys, self.at, self.counts = [], [], []
        for order, grams in enumerate(_grams(tokens, self.first), 1):
            keys, at = np.unique(grams, return_inverse=True)
            if order == 3:
                learnt[self.first[:-1]] = False
            self.keys.append(keys)
            self.at.append(at.astype(np.int32))
            self.counts.append(np.bincount(self.at[-1][learnt], minlength=len(keys)))

    def heard(self, answers: list[tuple[int, np.ndarray]], ranges: int) -> None:
        """Add what other blocks counted: by range, in the order of this block's keys there."""
        edges, counts = _edges(np.concatenate(self.keys), ranges), np.concatenate(self.counts)
        for k, more in answers:
            counts[edges[k] : edges[k + 1]] += more
        self.counts = np.split(counts, np.cumsum([len(k) for k in self.keys])[:-1])

    def traversed(self, tokens: int, types: int, texts: int, concentration: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: whether it has a training count, log10 of its root arc, log10 of its charge."""
        c = [counts[at] for counts, at in zip(self.counts, self.at, strict=True)]
        root = (c[0] + 0.5) / (tokens + 0.5 * (types + 1))
        arc = [root]
        charge = np.zeros(len(root))
        seen = []  # training count of the state of each length before the token; without one there is no such state
        for order, k in enumerate(concentration, 1):
            before = np.zeros(len(root))
            before[1:] = c[order - 1][:-1]
            before[self.first[:-1]] = texts if order == 1 else 0
            seen.append(before)
            arc.append((c[order] + k * arc[-1]) / (before + k))
        walking = np.ones(len(root), bool)  # tokens without an arc yet, from the longest states down
        for order in range(ORDERS, 1, -1):
            k, before = concentration[order - 2], seen[order - 2]
            found = walking & (c[order - 1] > 0)
            charge[found] += np.log10(arc[order - 1][found])
            walking &= ~found
            fails = walking & (before > 0)
            charge[fails] += np.log10(k / (before[fails] + k))
        base = np.log10(root)
        charge[walking] += base[walking]
        return c[0] > 0, base, charge


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each text's tokens (every text has one at least)."""
    return np.add.reduceat(values, first[:-1], dtype=float) if len(first) > 1 else np.zeros(0)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def _values(planes: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(planes), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).ravel()


_PACKED = "block int, range int, keys binary, n binary"
_ANSWER = "block int, range int, n binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, {"int": pa.int32(), "binary": pa.binary()}[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _edges(keys: np.ndarray, ranges: int) -> list[int]:
    """Where ranges of equal spans of keys of all orders begin and end among ascending keys."""
    span = ORDERS << KEY_BITS
    bounds = np.array([(1 << KEY_BITS) + span * k // ranges for k in range(1, ranges)], np.uint64)
    return [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]


def _by_range(block: int, keys: np.ndarray, n: np.ndarray, ranges: int) -> pa.Table:
    """Ascending keys (as differences) and their counts by range."""
    cuts = enumerate(itertools.pairwise(_edges(keys, ranges)))
    rows = [(block, k, _planes(np.diff(keys[a:b], prepend=np.uint64(0))), _planes(n[a:b].astype(np.int64))) for k, (a, b) in cuts if a < b]
    return _table(rows, _PACKED)


def _summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """One range: the counts of each row, the distinct keys, their totals, and for all keys in a row the place there."""
    keys = [np.cumsum(_values(k.as_py()).view(np.uint64), dtype=np.uint64) for k in table["keys"]]
    counts = [_values(n.as_py()) for n in table["n"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return counts, distinct, total, at


def _added(table: pa.Table) -> pa.Table:
    """One range of keys: for each block that asked what the others counted, in the order of its keys."""
    counts, _, total, at = _summed(table)
    low, out = 0, []
    for i, n in enumerate(counts):
        more = total[at[low : low + len(n)]] - n
        if more.any():
            out.append((table["block"][i].as_py(), table["range"][i].as_py(), _planes(more)))
        low += len(n)
    return _table(out, _ANSWER)


def _counted(table: pa.Table) -> pa.Table:
    """One range of words: tokens, types and texts of the training texts in it (START stands for a text)."""
    _, keys, total, _ = _summed(table)
    begins = keys == _START_KEY
    sums = total[~begins].sum(), (total[~begins] > 0).sum(), total[begins].sum()
    return pa.table({k: pa.array([int(v)], pa.int64()) for k, v in zip(("tokens", "types", "texts"), sums, strict=True)})


def score(
    docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", concentration: tuple[float, ...] = CONCENTRATION, block_bytes: int = BLOCK
) -> DataFrame:
    """One row a document: doc_id, train, n_tokens, n_known, train_tokens, base_score (root arcs alone), score.

    train says which rows to learn from (null: learn). A null or empty text is the end token alone; repeated rows count
    each time and score alike; without training rows every token is unknown and scores 0 (the one class there is);
    other columns are left out; an empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + volume // block_bytes
    ranges = 2 * blocks

    def count(batches):
        for batch in batches:
            tokens, first = _all_tokens(batch.column(0).cast(pa.large_string()))
            keys, n = np.unique(np.append(_tagged(tokens, 1), np.full(len(first) - 1, _START_KEY)), return_counts=True)
            yield from _by_range(0, keys, n, ORDERS * ranges).to_batches()

    learnt = rows.filter("train").select("text").mapInArrow(count, _PACKED)
    sums = learnt.groupBy("range").applyInArrow(_counted, "tokens bigint, types bigint, texts bigint")
    n_tokens, n_types, n_texts = (x or 0 for x in sums.agg(F.sum("tokens"), F.sum("types"), F.sum("texts")).first())

    def deal(batches):
        """The rows of a batch that go to one block, together and compressed."""
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("block").to_numpy()
            order = np.argsort(own, kind="stable")
            numbers, starts = np.unique(own[order], return_index=True)
            kept = batch.select(["doc_id", "text", "train"]).take(pa.array(order))
            for number, (low, high) in zip(numbers.tolist(), itertools.pairwise([*starts.tolist(), len(own)]), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema, options=options) as out:
                    out.write_batch(kept.slice(low, high - low))
                yield pa.record_batch([pa.array([number], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", number).mapInArrow(deal, "block int, rows binary")

    def request(table: pa.Table) -> pa.Table:
        block = _Block(table)
        keys, n = np.concatenate(block.keys), np.concatenate(block.counts)
        number = table["block"][0].as_py()
        del block
        return _by_range(number, keys, n, ranges)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left)
        block.heard([(k.as_py(), _values(n.as_py())) for k, n in zip(right["range"], right["n"], strict=True)], ranges)
        known, base, charge = block.traversed(n_tokens, n_types, n_texts, concentration)
        size = len(block.doc_id)
        return pa.table(
            {
                "doc_id": block.doc_id, "train": block.train, "n_tokens": pa.array(np.diff(block.first)),
                "n_known": pa.array(_by_text(known, block.first).astype(np.int64)),
                "train_tokens": pa.array(np.full(size, n_tokens, np.int64)),
                "base_score": pa.array(_by_text(base, block.first)), "score": pa.array(_by_text(charge, block.first)),
            }
        )

    requests = dealt.groupBy("block").applyInArrow(request, _PACKED)
    answers = requests.groupBy("range").applyInArrow(_added, _ANSWER)
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)
