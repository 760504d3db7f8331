"""Repeated passages: longest-previous-factor arrays over suffix order, on candidates that anchors bring together.

A text is a row of symbols: its bytes, or with `words` its words (cut at ASCII white space; characters of scripts without
blanks count as words; white space between them does not matter). A window is `width` symbols of one text. Each window
has an anchor: the least-hashed inner string of a quarter of the width (the leftmost of equals), so equal windows have
equal anchors at equal places. Windows in a row with the same anchor form a run; a run whose anchor occurs once has no
match, and is dropped.

Runs of equal content are copies of each other: they are counted and only the first of them goes on, so a passage with a
million copies is one run there. What is left of an anchor, one run of each content, goes to a task that puts the
windows in suffix order (ranks by prefix doubling up to the width). The previous and the next smaller position of each
window in that order are its candidates for the longest previous factor; the longer common prefix of the two is the
factor's length, and a window with a factor of the full width is a later copy of an earlier window. A text is then cut
at the windows with a match. The group of an anchor with more than HOT contents is split by what the windows of a few
neighbouring places have in common, so it is many tasks; parts of equal content (a header that every document has) are
counted like runs, and one of each goes on. Where more than HOT different parts are left, each of their windows is
counted by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulefold.llm import bytes as B
from rulefold.session import dropped, stored

WIDTH = 400
#: The fewest words of a repeated passage, where passages are counted in words.
PASSAGE_WORDS = 51
ANCHOR = 100
HOT = 20_000
NARROW = 8
TASK_BYTES = 3_000_000
BATCH_BYTES = 1_000_000
#: Texts whose runs are found together: some 130 bytes of memory for each of theirs.
FIND_BYTES = 400_000
JUMPS = 64
#: Bits of the number of a row in the sieve of rows concerned.
SIEVE = 24
#: Leading bytes of ideographs and kana (U+3000 to U+9FFF, and planes 1 to 3); bytes that continue a code point.
_UNSPACED = np.array([0xE3 <= b <= 0xE9 or b == 0xF0 for b in range(256)])
_CONTINUES = np.array([b & 0xC0 == 0x80 for b in range(256)])


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a slice, and for each text (and its end) the index of its first word."""
    starts, ends, first = B.words(data, offsets, B.NOT_SPACE)
    lead = np.flatnonzero(_UNSPACED[data])
    if len(lead):
        after = lead + np.where(data[lead] == 0xF0, 4, 3)
        begin = np.union1d(starts, np.concatenate([lead, after[(after < len(data)) & B.NOT_SPACE[data[np.minimum(after, len(data) - 1)]]]]))
        limit = np.append(begin[1:], len(data))
        stop = ends[np.searchsorted(ends, begin, "right")]
        starts, ends = begin, np.minimum(limit, stop)
        first = np.searchsorted(starts, offsets)
    return starts, ends, first


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slice as symbols of 32 bits, the hashes of its words, and the offsets of its texts in them."""
    starts, ends, first = units(data, offsets)
    return (B.span_hashes(B.prefix_sums(data), starts, ends) >> np.uint64(32)).astype(np.uint32), first


def _weights(symbols: np.ndarray) -> np.ndarray:
    return B.BYTE[symbols] if symbols.dtype == np.uint8 else B.mixed(symbols.astype(np.uint64) + np.uint64(1))


def runs(symbols: np.ndarray, offsets: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Runs of a slice: text (row), anchor (hash), content (hash), first and last window, at (the anchor's place);
    places count from the start of the text."""
    n, reach = len(symbols), width - anchor + 1
    if n < width:
        return {k: np.zeros(0, np.int64) for k in ("text", "anchor", "content", "first", "last", "at")}
    sums = B.prefix_sums_of(_weights(symbols))
    grams = B.span_hashes(sums, np.arange(n - anchor + 1), np.arange(anchor, n + 1))
    windows = len(grams) - reach + 1
    padded = np.concatenate([grams, np.full(-len(grams) % reach, np.iinfo(np.uint64).max)]).reshape(-1, reach)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:windows], before[reach - 1 : len(grams)])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:windows] == text[width - 1 :]
    begins = np.ones(windows, bool)
    begins[1:] = (least[1:] != least[:-1]) | (text[1:windows] != text[: windows - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], windows) - 1
    kept = inside[first]
    first, last = first[kept], last[kept]
    # the places that are least of their block up to them, and from them on (leftmost of equals)
    falls = np.ones(len(before), bool)
    np.not_equal(before[1:], before[:-1], out=falls[1:])
    falls[::reach] = True
    ahead = np.flatnonzero(falls)
    back = np.flatnonzero(padded.ravel() == after)
    del falls, padded

    def leftmost() -> np.ndarray:
        """The place of the least hash in the window that starts at each of `first`: in the block where that starts, or
        else in the next one."""
        own, end = after[first] == least[first], first + reach - 1
        at = np.empty(len(first), np.int64)
        at[own] = back[np.searchsorted(back, first[own])]
        at[~own] = ahead[np.searchsorted(ahead, end[~own], "right") - 1]
        return at

    at = leftmost()
    again = np.flatnonzero(at < last)
    if len(again):  # the same hash at a later place: cut where the leftmost place leaves the window
        parts = [_cut(grams, int(first[i]), int(last[i]), reach) for i in again]
        first = np.concatenate([np.delete(first, again), *(p[0] for p in parts)])
        last = np.concatenate([np.delete(last, again), *(p[1] for p in parts)])
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
        at = leftmost()
    hashes = least[first]
    row = text[first] if len(first) else np.zeros(0, np.int64)
    content = B.span_hashes(sums, first, last + width)
    base = offsets[:-1][row]
    return {
        "text": row, "anchor": hashes.view(np.int64), "content": content.view(np.int64),
        "first": first - base, "last": last - base, "at": at - base,
    }


def _cut(grams: np.ndarray, first: int, last: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    starts, at = [], first
    places = first + np.flatnonzero(grams[first : last + reach] == grams[first : first + reach].min())
    while at <= last:
        starts.append(at)
        at = int(places[np.searchsorted(places, at)]) + 1
    return np.array(starts), np.append(np.array(starts[1:], np.int64) - 1, last)


def _in_order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices that sort whole numbers of so many bits (equal ones by index), and the sorted numbers. Where both fit,
    number and index are sorted as one number, which is several times as fast as sorting indices."""
    own = len(keys).bit_length()
    if bits + own > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = keys << np.uint64(own)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << own) - 1)).view(np.int64), both >> np.uint64(own)


def suffix_ranks(symbols: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(depth, ranks of the places by the `depth` symbols that follow: equal ranks for equal symbols), with doubled
    depths and at last the width; meaningless for places with fewer left. A rank is the number of places before its
    equals, so it stays once a place has none, and only the others are sorted by the next depth."""
    n, bits = len(symbols), len(symbols).bit_length()
    depth = min(4 // symbols.itemsize, width)
    padded = np.concatenate([symbols, np.zeros(depth, symbols.dtype)])
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key = key << np.uint64(8 * symbols.itemsize) | padded[k : k + n].astype(np.uint64)
    order, keys = _in_order(key, 8 * symbols.itemsize * depth)
    del key, padded
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:n])
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, np.uint32)
    rank[order] = np.repeat(first, sizes)
    out = [(depth, rank)]
    open_ = np.zeros(n, bool)
    open_[order[np.repeat(sizes > 1, sizes)]] = True
    while depth < width:
        step = min(depth, width - depth)
        depth += step
        places = np.flatnonzero(open_)
        following = np.zeros(len(places), np.uint64)  # 0: the text ends before
        there = np.searchsorted(places, n - step)
        following[:there] = rank[places[:there] + step]
        following[:there] += np.uint64(1)
        order, keys = _in_order(rank[places].astype(np.uint64) << np.uint64(bits) | following, 2 * bits)
        places = places[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        sizes = np.diff(np.append(first, len(keys)))
        old = (keys[first] >> np.uint64(bits)).astype(np.int64)
        parts = np.append(True, old[1:] != old[:-1])[: len(old)]
        rank = rank.copy()
        rank[places] = np.repeat(old + first - np.maximum.accumulate(np.where(parts, first, 0)), sizes)
        out.append((depth, rank))
        open_[places[np.repeat(sizes == 1, sizes)]] = False
    return out


def common_prefix(symbols: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the strings at places a and b (with the width left) have in common, up to the width."""
    width, whole = ranks[-1]
    last = len(symbols) - 1
    length = np.zeros(len(a), np.int64)

    def grow(values: np.ndarray, by: int, of: np.ndarray | slice) -> np.ndarray:
        x, y = (np.minimum(p[of] + length[of], last) for p in (a, b))
        same = values[x] == values[y]
        length[of] += by * same
        return same

    for depth, rank in reversed(ranks[:-1]):
        grow(rank, depth, slice(None))
    short = np.flatnonzero(whole[a] != whole[b])
    for _ in range(ranks[0][0] - 1):  # what is left of the first depth
        short = short[grow(symbols, 1, short)]
    return np.where(whole[a] == whole[b], width, np.minimum(length, width))


def smaller_positions(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of a sequence of distinct positions the index of the nearest one before, and after, with a
    smaller position (-1: none). Indices jump over what is known to be larger, all elements at a time."""
    n = len(position)
    out = []
    for p in (position, position[::-1]):
        at = np.arange(-1, n - 1)
        todo = np.flatnonzero(at >= 0)
        for _ in range(JUMPS):
            todo = todo[p[at[todo]] > p[todo]]
            at[todo] = at[at[todo]]
            todo = todo[at[todo] >= 0]
            if not len(todo):
                break
        out.append(_by_stack(p) if len(todo) else at)
    back = out[1][::-1]
    return out[0], np.where(back < 0, -1, n - 1 - back)


def _by_stack(position: np.ndarray) -> np.ndarray:
    """The indices before, one by one, for sequences of long ascending stretches."""
    stack, out = [], []
    for i, x in enumerate(position.tolist()):
        while stack and stack[-1][0] > x:
            stack.pop()
        out.append(stack[-1][1] if stack else -1)
        stack.append((x, i))
    return np.array(out, np.int64)


def longest_previous(symbols: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest-previous-factor array of some places (ascending, each with `width` symbols left), up to the width:
    for each the longest common prefix with an earlier one of them, and the index of that one (-1: none)."""
    ranks = suffix_ranks(symbols, width)
    order, _ = _in_order(ranks[-1][1][places].astype(np.uint64), len(symbols).bit_length())  # suffix order; equal strings by place
    length, source = np.zeros(len(places), np.int64), np.full(len(places), -1)
    for near in smaller_positions(order):
        has = np.flatnonzero(near >= 0)
        own, other = order[has], order[near[has]]
        common = common_prefix(symbols, ranks, places[own], places[other])
        better = common > length[own]
        length[own[better]], source[own[better]] = common[better], other[better]
    return length, source


def _batches(table: pa.Table, kind: type) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows (sorted by group) of whole groups, about BATCH_BYTES at a time: first, end, symbols, and sizes by row."""
    group = table["group"].to_numpy()
    content = table["content"].combine_chunks()
    content = (content if isinstance(content, pa.Array) else pa.concat_arrays(content.chunks)).cast(pa.large_binary())
    sizes = np.array([len(x.as_buffer()) for x in content], np.int64)
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    edges = np.append(edges, len(group))
    volume = np.concatenate([[0], np.cumsum(sizes)])
    low = 0
    while low < len(edges) - 1:
        high = low + 1
        while high < len(edges) - 1 and volume[edges[high + 1]] - volume[edges[low]] <= BATCH_BYTES:
            high += 1
        a, b = edges[low], edges[high]
        yield a, b, np.frombuffer(b"".join(content[i].as_buffer().to_pybytes() for i in range(a, b)), kind), sizes[a:b] // np.dtype(kind).itemsize
        low = high


def _matches(table: pa.Table, width: int, first_stays: bool, kind: type) -> pa.Table:
    """One task: contents of some anchors; the intervals of symbols that matching windows cover."""
    # the order of repeated()'s heads: no text is before another by one window and behind it by the next
    order = pc.sort_indices(table, [(c, "ascending") for c in ("group", "doc_id", "rid", "first")], null_placement="at_start")
    table = table.take(order)
    rid, first, wanted = (table[c].to_numpy() for c in ("rid", "first", "wanted"))
    out: list[tuple] = []
    for a, b, symbols, own in _batches(table, kind):
        windows = own - width + 1
        row = np.repeat(np.arange(b - a), windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        length, source = longest_previous(symbols, (np.cumsum(own) - own)[row] + place, width)
        match = length >= width
        if not first_stays:
            match[source[match]] = True  # the earlier copy has a match as well, a later one
        hit = np.flatnonzero(match & wanted[a:b][row])
        if len(hit):
            cuts = np.flatnonzero((np.diff(hit) != 1) | (np.diff(row[hit]) != 0)) + 1
            for x, y in zip(np.append(0, cuts), np.append(cuts, len(hit)), strict=True):
                i = a + row[hit[x]]
                out.append((rid[i], int(first[i] + place[hit[x]]), int(first[i] + place[hit[y - 1]] + width)))
    B.give_back()
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("rid", "start", "end"), columns, strict=True)})


def _contents(batches, width: int, words: bool):
    """Rows of the runs that have to be compared, with their symbols and, for hot ones in narrow parts, their content's
    hash."""
    for batch in batches:
        out: list[tuple] = []
        texts = batch.column("text").cast(pa.large_string())
        for i in range(batch.num_rows):
            data = np.frombuffer(texts[i].as_buffer(), np.uint8)
            symbols = coded(data, np.array([0, len(data)]))[0] if words else data
            rid, doc = batch.column("rid")[i].as_py(), batch.column("doc_id")[i].as_py()
            for r in batch.column("runs")[i].as_py():
                first, last, group = r["first"], r["last"], r["anchor"]
                if not r["hot"]:
                    out.append((group, rid, doc, first, r["wanted"], symbols[first : last + width].tobytes(), None))
                    continue
                at = first
                while at <= last:  # parts: windows whose distance to the anchor has the same multiple of NARROW
                    slot = (r["at"] - at) // NARROW
                    high = r["at"] - slot * NARROW
                    stop = min(last, high)
                    core = hashlib.blake2b(symbols[high : high - NARROW + 1 + width].tobytes(), digest_size=8, salt=str(slot).encode())
                    key = group ^ int.from_bytes(core.digest(), "big", signed=True)
                    part = symbols[at : stop + width].tobytes()
                    same = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "big", signed=True)
                    out.append((key, rid, doc, at, r["wanted"], part, same))
                    at = stop + 1
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
        names = ["group", "rid", "doc_id", "first", "wanted", "content", "same"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _sieve(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with the boolean column sifted: false means that its rid is none of ids (true may be a false alarm). The
    sieve that is broadcast has 2 ** SIEVE bits at most, however many ids there are."""
    hole, bit = f"pmod(rid, {1 << SIEVE}L)", "cast(pmod(rid, 64L) as int)"
    marks = ids.select(F.expr(f"shiftright({hole}, 6)").alias("__word"), F.expr(f"shiftleft(1L, {bit})").alias("bit"))
    marks = marks.groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    keyed = rows.join(F.broadcast(marks), F.expr(f"shiftright({hole}, 6)") == F.col("__word"), "left")
    there = F.expr(f"(shiftrightunsigned(coalesce(__bits, 0L), {bit}) & 1L) = 1L")
    return keyed.withColumn("sifted", there).drop("__word", "__bits")


def repeated(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, first_stays: bool = False, hot: int = HOT, words: int | None = None
) -> DataFrame:
    """(rid, spans), stored: symbols covered by a window that also starts elsewhere (first_stays: that also starts
    earlier, in the order of key, none first, then rid, then place), as an array of struct(start, end), unordered and overlapping. rid is
    row_id(). With `words` a window is so many words, in place of `width` bytes, and places count words."""
    width = words or width
    anchor = max(1, width // 4)
    kind = np.uint32 if words else np.uint8
    rows = docs.select(row_id(key, text).alias("rid"), F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def find(batches):
        for batch in batches:
            low = 0
            for low, _, data, offsets in B.text_slices(batch.column("text"), FIND_BYTES):
                if words:
                    data, offsets = coded(data, offsets)
                r = runs(data, offsets, width, anchor)
                take = pa.array(r["text"] + low)
                columns = [batch.column("rid").take(take), batch.column("doc_id").take(take)]
                columns += [pa.array(r[k]) for k in ("anchor", "content")] + [pa.array(r[k], pa.int32()) for k in ("first", "last", "at")]
                yield pa.record_batch(columns, names=["rid", "doc_id", "anchor", "content", "first", "last", "at"])
            B.give_back()

    schema = "rid bigint, doc_id bigint, anchor bigint, content bigint, first int, last int, at int"
    everywhere = stored(rows.mapInArrow(find, schema), "found")
    # most anchors occur once; what is left is joined with a stored table, so Spark may split a frequent anchor's rows
    again = stored(everywhere.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "again")
    found = stored(everywhere.join(again, "anchor"), "found")
    dropped(everywhere, again)
    place = F.struct("doc_id", "rid", "first", "last", "at")  # Spark has nulls first, as _matches has
    contents = stored(found.groupBy("anchor", "content").agg(F.count("*").alias("same"), F.min(place).alias("head")), "contents")
    kinds = stored(contents.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    whole = ~place.eqNullSafe(F.col("head")) if first_stays else F.lit(True)
    copies = contents.filter("same > 1").select("anchor", "content", "head")
    covered = found.join(copies, ["anchor", "content"]).filter(whole)
    covered = covered.select("rid", F.col("first").cast("bigint").alias("start"), (F.col("last") + width).cast("bigint").alias("end"))
    varied = contents.join(kinds, "anchor")
    wanted = F.lit(True) if first_stays else F.col("same") == 1
    differ = varied.select("anchor", "head.rid", "head.first", "head.last", "head.at", wanted.alias("wanted"), (F.col("kinds") > hot).alias("hot"))
    differ = stored(differ, "differ")
    volume = differ.agg(F.sum(F.col("last") - F.col("first") + width)).first()[0] or 0

    def contents_of(chosen: DataFrame) -> DataFrame:
        by_text = chosen.groupBy("rid").agg(F.collect_list(F.struct("anchor", "first", "last", "at", "wanted", "hot")).alias("runs"))
        texts = _sieve(rows, chosen.select("rid")).filter("sifted").drop("sifted")
        return texts.join(by_text, "rid").dropDuplicates(["rid"]).mapInArrow(
            lambda batches: _contents(batches, width, bool(words)), "group bigint, rid bigint, doc_id bigint, first bigint, wanted boolean, content binary, same bigint"
        )

    parts, cut_up = contents_of(differ.filter("not hot")).drop("same"), []
    if not differ.filter("hot").isEmpty():
        cut_up.append(stored(contents_of(differ.filter("hot")), "parts"))
        once, more = _bounded(cut_up, width, hot, first_stays, np.dtype(kind).itemsize)
        parts, covered = parts.unionByName(once), covered.unionByName(more)
    task = F.pmod(F.xxhash64("group"), F.lit(1 + volume * np.dtype(kind).itemsize // TASK_BYTES))
    fine = parts.withColumn("task", task).groupBy("task").applyInArrow(lambda t: _matches(t, width, first_stays, kind), "rid bigint, start bigint, end bigint")
    spans = stored(covered.unionByName(fine).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    dropped(found, contents, kinds, differ, *cut_up)
    return spans


def _copies(slim: DataFrame, by: list[str], first_stays: bool) -> tuple[DataFrame, DataFrame]:
    """The first row of each of `by` with n, how many there are; and the rows that have another one as what they cover:
    the first one too unless that stays."""
    place = F.struct("doc_id", "rid", "first")
    heads = slim.groupBy(*by).agg(F.count("*").alias("n"), F.min(place).alias("head"))
    again = slim.join(heads.filter("n > 1"), by).filter("wanted")
    if first_stays:
        again = again.filter(~place.eqNullSafe(F.col("head")))
    return heads, again.select("rid", F.col("first").alias("start"), "end")


def _bounded(tables: list[DataFrame], width: int, hot: int, first_stays: bool, itemsize: int) -> tuple[DataFrame, DataFrame]:
    """Groups of at most `hot` parts of different content, and what all the other parts cover. The parts are the one
    table given; those that this adds are to be dropped with it."""
    parts = tables[0]
    end = F.col("first") + (F.octet_length("content") / itemsize).cast("bigint")
    heads, again = _copies(parts.select("group", "same", "doc_id", "rid", "first", "wanted", end.alias("end")), ["group", "same"], first_stays)
    # what is covered as a whole need not be found once more
    open_ = (F.lit(first_stays) | (F.col("n") == 1)).alias("open")
    once = parts.join(heads.select("group", "head.rid", "head.first", open_), ["group", "rid", "first"])
    once = once.select("group", "rid", "doc_id", "first", (F.col("wanted") & F.col("open")).alias("wanted"), "content")
    once = stored(once, "once")
    crowded = stored(once.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("group"), "crowded")
    tables += [once, crowded]
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("content") / itemsize).cast("int") - width)).alias("at")
    windows = once.join(crowded, "group").select("*", at)
    window = F.expr(f"xxhash64(substring(content, at * {itemsize} + 1, {width * itemsize}))").alias("window")
    windows = windows.select("group", window, "doc_id", "rid", (F.col("first") + F.col("at")).alias("first"), "wanted")
    _, single = _copies(windows.withColumn("end", F.col("first") + width), ["group", "window"], first_stays)
    return once.join(crowded, "group", "left_anti"), again.unionByName(single)


def row_id(key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))


def _bytes_of(raw: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans of words as spans of the text: each word with the blanks before it, the last with those after."""
    data = np.frombuffer(raw, np.uint8)
    _, ends, _ = units(data, np.array([0, len(data)]))
    edges = np.concatenate([[0], ends])
    edges[-1] = len(data)
    return [[int(edges[a]), int(edges[b])] for a, b in spans]


def _merged(spans: pa.Scalar) -> list[list[int]]:
    """Maximal intervals of overlapping and touching ones, ascending."""
    out: list[list[int]] = []
    if spans.is_valid:
        for a, b in sorted((s["start"], s["end"]) for s in spans.as_py()):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
    return out


def cut(
    docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False, passages: int | None = None, **options
) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the remaining bytes); with_text
    also kept_text, where a code point that is only partly covered stays. With `passages` also n_passage_words, the
    words covered by passages of so many words that also stand elsewhere (nothing is cut by those). Columns of those
    names are replaced.

    Options are those of repeated(). A null text is empty (kept_text: null); texts shorter than the width keep all;
    repeated rows are copies of each other; an empty table gives an empty one.
    """
    spans = repeated(docs, text, key, **options).select(F.col("rid").alias("__rid"), F.col("spans").alias("__spans"))
    if passages:
        more = repeated(docs, text, key, words=passages).select(F.col("rid").alias("__also"), F.col("spans").alias("__passages"))
        spans = spans.join(more, F.col("__rid") == F.col("__also"), "full").withColumn("__rid", F.coalesce("__rid", "__also")).drop("__also")
    return _cut_at(docs.withColumn("__own", row_id(key, text)).join(spans, F.col("__own") == F.col("__rid"), "left").drop("__rid", "__own"), text, with_text, bool(passages), bool(options.get("words")))


def _cut_at(rows: DataFrame, text: str, with_text: bool, passages: bool, words: bool) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> dict:
            column, spans = batch.column(text), batch.column("__spans")
            texts = column.cast(pa.large_string())
            made = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "n_passage_words")}
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                merged = _merged(spans[i])
                if words:
                    merged = _bytes_of(raw, merged)
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                made["n_bytes"].append(len(raw))
                made["n_removed"].append(len(raw) - len(kept))
                made["n_spans"].append(len(merged))
                made["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if passages:
                    made["n_passage_words"].append(sum(b - a for a, b in _merged(batch.column("__passages")[i])))
                if with_text:
                    for k, x in enumerate(edges[1:-1]):
                        # a span starts and ends between code points: later start, earlier end
                        while x < len(raw) and raw[x] & 0xC0 == 0x80:
                            x += 1 if k % 2 == 0 else -1
                        edges[k + 1] = x
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    made["kept_text"].append(kept.decode() if texts[i].is_valid else None)
            return {k: pa.array(v, pa.string() if k.startswith("kept") else pa.int64()) for k, v in made.items() if v or not batch.num_rows}

        return run

    added = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text + ", n_passage_words bigint" * passages
    return B.extended(rows, added, make, drop=("__spans", "__passages"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents without later copies of passages (the first stays), with the columns of docs. Documents of which
    nothing remains go, and of rows that repeat both key and text one stays. Only documents with something to cut, and
    repeated rows, are shuffled with their texts."""
    spans = repeated(docs, text, key, first_stays=True, **options).select(F.col("rid").alias("__rid"), F.col("spans").alias("__spans"))
    others = F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`") for c in docs.columns if c != text))
    rows = docs.select(others.alias("row"), row_id(key, text).alias("rid"), F.col(f"`{text}`").alias("t"))
    twins = rows.groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1").select("rid")
    sifted = _sieve(rows, spans.select(F.col("__rid").alias("rid")).unionByName(twins))
    concerned = sifted.filter("sifted").drop("sifted").join(spans, F.col("rid") == F.col("__rid"), "left")
    concerned = concerned.dropDuplicates(["rid"]).drop("rid", "__rid")
    made = _cut_at(concerned, "t", True, False, bool(options.get("words")))
    made = made.filter((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    whole = sifted.filter("not sifted").select("row", F.col("t").alias("kept_text"))
    made = whole.unionByName(made.select("row", "kept_text"))
    return made.select(*((F.col("kept_text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
