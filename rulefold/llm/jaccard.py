"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Texts are sets of runs of SHINGLE words (letters and digits, A-Z lower-cased; a text of fewer words is one run). Texts
with equal sets form a class. Classes that agree in any of BANDS bands of ROWS MinHash values are candidates: a pair at
the threshold 0.8 is missed with probability (1 - 0.8 ** 4) ** 32 = 5e-8. The join then compares the MinHash values of
a candidate pair STEP by STEP and drops it once the posterior probability (uniform prior) that its similarity reaches
the threshold is below TOLERANCE; what is left is verified on the sets themselves.

Candidates are never emitted as pairs. Bands link classes to stars, whose components are dealt to tasks: small ones
many to a task, a large one as pairs of blocks of about BLOCK classes or BLOCK_SHINGLES shingles, so that no group is
one task and no text is copied for each other text. A task returns a row for each of its classes: how many documents it
links to there, and the least class linked with it there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.llm import bytes as B
from rulefold.llm.components import components
from rulefold.session import dropped, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 8
TOLERANCE = 1e-7
#: Most classes, and on average most shingles, of a block; texts of a component are copied once for each of its blocks.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: Classes of small components that share a task.
TASK = 512
_LOWER_BYTE = B.BYTE[B.LOWER]
_RANDOM = np.random.RandomState(811)
_A = _RANDOM.randint(0, 2**62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.randint(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of each text of a slice, and first run of each text."""
    starts, ends, first = B.words(data, offsets, B.LETTERS_DIGITS)
    hashes = B.span_hashes(B.prefix_sums(data, _LOWER_BYTE), starts, ends)
    counts = np.diff(first)
    runs = B.run_hashes(hashes, n)
    left = np.repeat(first[1:], counts)[: len(runs)] - np.arange(len(runs))
    keep = np.flatnonzero(left >= n)
    sizes = np.where(counts >= n, counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    place = np.concatenate([[0], np.cumsum(sizes)])
    made = runs[keep]
    if len(short):
        whole = [B.run_hashes(hashes[first[i] : first[i + 1]], int(counts[i]))[0] for i in short]
        made = np.insert(made, place[short], whole)
        sizes[short] = 1
    return made, np.concatenate([[0], np.cumsum(sizes)])


def signatures(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of texts with one run at least."""
    out = np.empty((len(first) - 1, len(_A)), np.uint32)
    for k in range(len(_A)):
        mixed = (runs * _A[k] + _B[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(mixed, first[:-1])
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        keys = keys * B.WORD_BASE + signature[:, r::ROWS].astype(np.uint64) + np.uint64(1)
    keys += np.arange(BANDS, dtype=np.uint64) * B.BASE
    return B.mixed(keys)


def digests(runs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A 63-bit digest of each text's set, the set's size, and the sorted sets."""
    sets = [np.unique(runs[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = B.mixed(np.concatenate([*sets, np.zeros(0, np.uint64)]) * B.BASE)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(flat, dtype=np.uint64)])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return (B.mixed(sums[edge[1:]] - sums[edge[:-1]]) >> np.uint64(1)).astype(np.int64), sizes, sets


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of values compared: with fewer matches the posterior is below the tolerance. With a uniform
    prior, P(J >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def linked(
    sets: list[np.ndarray], signature: np.ndarray, allowed: np.ndarray, threshold: float = THRESHOLD
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) that share a band, survive pruning and have the similarity; allowed: which pairs to look at."""
    keys = bands(signature)
    candidate = np.zeros(allowed.shape, bool)
    for b in range(BANDS):
        candidate |= keys[:, b][:, None] == keys[:, b][None, :]
    i, j = np.nonzero(np.triu(candidate & allowed, 1))
    matches = np.zeros(len(i), np.int64)
    for n, least in least_matches(threshold).items():
        matches += (signature[i, n - STEP : n] == signature[j, n - STEP : n]).sum(axis=1)
        kept = matches >= least
        i, j, matches = i[kept], j[kept], matches[kept]
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 4 * len(sets):
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        shared = _intersections(sets)[i, j]
    union = sizes[i] + sizes[j] - shared
    close = shared >= threshold * union
    return i[close], j[close]


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of the values."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, 8_000_000 // len(sets))
    for low in range(0, len(values), width):
        a, b = np.searchsorted(column, [low, low + width])
        there = np.zeros((len(sets), min(width, len(values) - low)), np.float32)
        there[row[a:b], column[a:b] - low] = 1
        total += there @ there.T
    return np.rint(total).astype(np.int64)


def _verify(table: pa.Table) -> pa.Table:
    """One task: members with their texts, compared where their blocks are the task's pair of blocks."""
    text = table["text"].combine_chunks()
    text = (text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)).cast(pa.large_string())
    rows = {c: table[c].to_numpy() for c in ("node", "size", "block", "low", "high")}
    sets, signature, found = [], [], []
    for low, high, data, offsets in B.text_slices(text):
        runs, first = shingles(data, offsets)
        kept = np.flatnonzero(np.diff(first) > 0)
        first = np.append(first[:-1][kept], len(runs))
        digest, _, own = digests(runs, first)
        sets += own
        signature.append(signatures(runs, first))
        found.append(np.where(digest == rows["node"][low:high][kept], kept + low, -1))
    at = np.concatenate([*found, np.zeros(0, np.int64)])
    real = np.flatnonzero(at >= 0)
    real = real[np.unique(rows["node"][at[real]], return_index=True)[1]]  # one text of each class
    sets, at = [sets[k] for k in real], at[real]
    node, size, block, low, high = (rows[c][at] for c in ("node", "size", "block", "low", "high"))
    signature = np.concatenate(signature)[real] if len(real) else np.zeros((0, len(_A)), np.uint32)
    pair = ((block[:, None] == low[:, None]) & (block[None, :] == high[:, None])) | ((block[:, None] == high[:, None]) & (block[None, :] == low[:, None]))
    i, j = linked(sets, signature, pair) if len(at) else (np.zeros(0, int), np.zeros(0, int))
    links = np.zeros(len(at), np.int64)
    np.add.at(links, i, size[j])
    np.add.at(links, j, size[i])
    least = node.copy()
    for _ in range(len(at)):  # least node among the linked, along paths within the task
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
        if (before == least).all():
            break
    return pa.table([pa.array(node), pa.array(links), pa.array(least)], names=["node", "links", "least"])


def _rid(text: str, key: str) -> Column:
    """What tells rows apart, null keys too: a hash of key and text."""
    return F.xxhash64(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`"))


def _read(docs: DataFrame, text: str, key: str) -> DataFrame:
    """rid, doc_id, node (digest of the set), n_shingles (distinct), bands; node is null for a text without words."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            nodes, sizes, keys = [], [], []
            for low, high, data, offsets in B.text_slices(batch.column("text")):
                runs, first = shingles(data, offsets)
                n = np.diff(first)
                kept = np.flatnonzero(n)
                edge = np.append(first[:-1][kept], len(runs))
                digest, size, _ = digests(runs, edge)
                node, count = np.full(high - low, -1, np.int64), np.zeros(high - low, np.int64)
                node[kept], count[kept] = digest, size
                nodes.append(node)
                sizes.append(count)
                band = np.zeros((high - low, BANDS), np.uint64)
                if len(kept):
                    band[kept] = bands(signatures(runs, edge))
                keys.append(band.view(np.int64))
            node = np.concatenate([*nodes, np.zeros(0, np.int64)])
            flat = np.concatenate([*keys, np.zeros((0, BANDS), np.int64)])
            return {
                "node": pa.array(node, mask=node < 0),
                "n_shingles": pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)])),
                "bands": B.list_array(flat.ravel(), np.full(len(node), BANDS)),
            }

        return run

    rows = docs.select(_rid(text, key).alias("rid"), F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return B.extended(rows, "node bigint, n_shingles bigint, bands array<bigint>", make, drop=("text",))


def _groups(docs: DataFrame, text: str, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows of _read() without bands, and for each node its group's head (the least row: struct of none, doc_id, rid,
    where rows without a key come last) and n_links; both stored."""
    shingled = stored(_read(docs, text, key), "shingles")
    read = stored(shingled.drop("bands"), "rows")
    classes = shingled.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("head"), F.count("*").alias("size"),
        F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"),
    )
    classes = stored(classes, "classes")
    dropped(shingled)
    keyed = classes.select("node", F.explode("bands").alias("band"))
    # least node of each band of two or more, joined back: counts combine before the shuffle, the join may split a band
    heads = keyed.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = keyed.join(heads, "band").select(F.col("node").alias("u"), "v").filter("u <> v")
    grouped = components(stars)
    sizes = grouped.join(classes.select("node", "n_shingles"), "node").groupBy("root").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("volume"))
    members = classes.select("node", "size", "n_shingles", F.col("head.rid").alias("rid")).join(grouped, "node").join(sizes, "root")
    # blocks are bounded by their members and by their sets
    blocks = F.ceil(F.least("members", F.greatest(F.col("members") / block, F.col("volume") / BLOCK_SHINGLES))).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = stored(members.drop("volume"), "members")
    dropped(grouped)
    small = members.filter("blocks = 1").agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    tasks = 1 + max(small[0] // TASK, small[1] // BLOCK_SHINGLES)
    texts = docs.select(_rid(text, key).alias("rid"), F.col(f"`{text}`").alias("text"))
    # members grow with the corpus, so they are shuffled to the texts at every size, never broadcast
    chosen = texts.join(members.select("rid", "node", "size", "root", "blocks", "block").hint("merge"), "rid")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = chosen.select("*", other).select(
        "node", "size", "text", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))).alias("task"),
    )
    found = dealt.groupBy("task").applyInArrow(_verify, "node bigint, links bigint, least bigint")
    found = stored(found, "links")
    linked_to = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    info = classes.drop("bands").join(linked_to, "node", "left").join(roots, "node", "left")
    info = info.select("node", "head", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    heads = info.groupBy("root").agg(F.min("head").alias("head"))
    info = stored(info.drop("head").join(heads, "root").select("node", "head", (F.col("links") + F.col("size") - 1).alias("n_links")), "groups")
    dropped(classes, members, found, roots)
    return read, info


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of its near-duplicate group: documents connected by links),
    n_links (other documents with a similarity of 0.8 or more), n_shingles (distinct).

    A null text and one without words link to nothing and form a class of their own each; exact copies link to each
    other; repeated rows count each; an empty table gives an empty one; other columns are left out.
    """
    read, info = _groups(docs, text, key, block)
    out = read.join(info.select("node", F.col("head.doc_id").alias("class_id"), "n_links"), "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_shingles")


def kept(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with one of each near-duplicate group, the one of the least id (of equal ids, and without one:
    any, but always one row); the columns of docs. Rows without words are near nothing and all stay."""
    read, info = _groups(docs, text, key, BLOCK)
    heads = info.select(F.col("head.rid").alias("__rid"), F.lit(False).alias("__bare"))
    stay = heads.unionByName(read.filter("node is null").select(F.col("rid").alias("__rid"), F.lit(True).alias("__bare"))).distinct()
    rows = docs.withColumn("__own", _rid(text, key)).join(stay, F.col("__own") == F.col("__rid"))
    # copies of one key and text are one row, but for those without words
    rows = rows.withColumn("__each", F.when(F.col("__bare"), F.monotonically_increasing_id())).dropDuplicates(["__own", "__each"])
    return rows.drop("__own", "__rid", "__bare", "__each")
