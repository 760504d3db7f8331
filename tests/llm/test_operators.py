"""The corpus operators against brute force, and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rulefold.llm import components, decontaminate, fingerprints, jaccard, language, licenses, lm, packing, repeats, sharding, token_files
from rulefold.llm.tokens import Encoder
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


# 1 Jaccard join


def brute_links(rows):
    sets = [(lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())(words(t), min(5, len(words(t)))) for _, t, *_ in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = list(range(len(rows)))
    for _ in rows:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    links = Counter(x for p in pairs for x in p)
    return links, group


@pytest.mark.parametrize("block", [2, 256])
def test_jaccard_join_against_all_pairs(spark, block):
    rng = random.Random(5)
    rows = []
    for g in range(8):
        base = prose(100 + g, 60 + 20 * g).split()
        for k in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), rows[-1][1]))
    links, group = brute_links(rows)
    got = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), block=block).collect()}
    assert [got[i].n_links for i in range(len(rows))] == [links[i] for i in range(len(rows))]
    assert [got[i].class_id for i in range(len(rows))] == group


def test_jaccard_join_on_odd_rows(odd, odd_rows):
    links, group = brute_links(odd_rows)
    want = sorted((str(r[0]), links[i]) for i, r in enumerate(odd_rows))
    got = jaccard.join(odd).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == want
    assert {r.class_id for r in got if r.doc_id in (7, 8, 9)} == {7}
    kept = jaccard.kept(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in odd_rows if r[0] not in (8, 9))
    assert jaccard.join(odd.limit(0)).count() == 0 and jaccard.kept(odd.limit(0)).count() == 0


def test_rows_without_or_with_equal_ids_are_judged_each(spark):
    a, b, c, d = (prose(70 + k, 60) for k in range(4))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(None, a), (None, near), (None, b), (5, c), (5, d), (6, c), (7, prose(80, 50)), (7, prose(80, 50)), (None, None), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    links, _ = brute_links(rows)
    assert sorted((r.doc_id or -1, r.n_links) for r in jaccard.join(docs).collect()) == sorted((k or -1, links[i]) for i, (k, _) in enumerate(rows))
    got = Counter((r.doc_id, r.text) for r in jaccard.kept(docs).collect())
    assert got.pop((None, a), 0) + got.pop((None, near), 0) == 1
    assert got == Counter([(None, b), (5, c), (5, d), rows[6], (None, None), (None, None), (8, "")])


def test_pruning_keeps_likely_pairs():
    least = jaccard.least_matches()
    assert all(0 <= m < 0.8 * n for n, m in least.items()) and least[128] > 60


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# 2 LM scoring


def brute_lm(rows, train, k1, k2):
    """By document: tokens, and the score from counts of words, pairs and triples, walking the automaton arc by arc."""
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\0"] for k, t in rows}
    learnt = [["<s>", *tokens[k]] for k, _ in rows if train(k)]
    grams = Counter(tuple(t[i : i + n]) for t in learnt for n in (1, 2, 3) for i in range(len(t) - n + 1))
    n, v = sum(len(t) - 1 for t in learnt), len({x for t in learnt for x in t[1:]})

    def walk(state, w):
        """log10 of the charge of a token in a state: its arc, or the failure arc and the walk from there."""
        if not state:
            return math.log10((grams[w,] + 0.5) / (n + 0.5 * (v + 1)))
        k = k1 if len(state) == 1 else k2
        if grams[*state, w]:
            return math.log10((grams[*state, w] + k * 10 ** walk(state[1:], w)) / (grams[state] + k))
        return (math.log10(k / (grams[state] + k)) if grams[state] else 0) + walk(state[1:], w)

    scores = {}
    for k, own in tokens.items():
        state, total = ("<s>",), 0.0
        for w in own:
            total += walk(state, w)
            state = (*state, w)[-2:]
        scores[k] = total
    return tokens, grams, n, v, walk, scores


def test_lm_against_the_formulas(spark, odd_rows):
    rows = [(i, t) for i, (_, t, _) in enumerate(odd_rows) if i != 5] + [(50 + i, prose(i, 80)) for i in range(20)]
    rows += [(80, "One two three one two three"), (81, "one TWO three"), (82, "one two four two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 3 != 1, concentration=(50.0, 3.0), block_bytes=3_000).collect()}
    tokens, grams, n, v, walk, scores = brute_lm(rows, lambda k: k % 3 != 1, 50, 3)
    for k, t in tokens.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(grams[w,] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(walk((), w) for w in t))
        assert r.score == pytest.approx(scores[k])
    words_there = {g[0] for g in grams if len(g) == 1} - {"<s>"}
    for s in (("one",), ("one", "two"), ("<s>", "one")):  # the arcs of a state, with one unknown word, sum to 1
        assert sum(10 ** walk(s, w) for w in [*words_there, "never seen"]) == pytest.approx(1)


def test_lm_learns_after_rare_words(spark):
    rows = [(k, prose(700 + k, 900)) for k in range(24)] + [(30, "rareone raretwo rarethree")] * 2 + [(31, "rareone raretwo rarethree never")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") != 31, block_bytes=20_000).collect()}
    *_, scores = brute_lm(rows, lambda k: k != 31, *lm.CONCENTRATION)
    assert all(got[k].score == pytest.approx(scores[k], rel=1e-9) for k in got)
    assert got[31].score > got[31].base_score + 0.4


def test_lm_on_odd_rows(odd, odd_rows):
    got = lm.score(odd, F.col("doc_id") > 6).collect()
    assert len(got) == len(odd_rows) and all(r.score <= 0 for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 1] == [1]
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.score(odd, F.lit(False)).collect())


# 3 Token files


def test_token_files_round_trip(spark, tmp_path, odd, odd_rows, vocabularies):
    path = f"file://{tmp_path}/tokens"
    manifest = token_files.write(odd, path, vocabularies["byte_bpe_50k"], length=256)
    tokenizer = Tokenizer.from_file(vocabularies["byte_bpe_50k"])
    want, start = [], 0
    for key, text, _ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    part = manifest.orderBy(F.desc("ids")).first()
    ids, mask = token_files.sequence(path, part.part, (part.ids - 1) // 256)
    assert len(ids) == len(mask) == 256 and mask.sum() == (part.ids - 1) % 256 + 1 and ids.dtype == np.uint16
    assert not ids[~mask].any()
    empty = f"file://{tmp_path}/none"
    assert token_files.write(odd.limit(0), empty, vocabularies["byte_bpe_50k"]).count() == 0
    assert token_files.read(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_cached_encoding_is_the_library_s(name, vocabularies):
    rng = random.Random(1)
    bits = [*"ab cé'\n\t .,|«»  1²Ⅷ中文Éİ<>|≠\r", "'s", "  ", "\n\n", " \n", "<|endoftext|>", "don't", " \t", "word", "Word"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(4_000)] + [None, "", prose(1, 2_000)]
    encoder = Encoder(open(vocabularies[name]).read())
    got = []
    for ids, offsets in encoder.slices(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    library = Tokenizer.from_file(vocabularies[name]).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == [[*x.ids, 0] for x in library]


# 4 Repeats


def brute_repeats(rows, width, first_stays):
    data = [(t or "").encode() for _, t, *_ in rows]
    count, seen, out = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1)), set(), []
    for t in data:
        covered = bytearray(len(t))
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            if (w in seen) if first_stays else count[w] > 1:
                covered[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        out.append((len(t), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("first_stays", "hot"), [(False, 20_000), (False, 2), (True, 20_000), (True, 2)])
def test_repeats_against_all_windows(spark, first_stays, hot):
    rng = random.Random(5)
    base = ["".join(rng.choices("ab", k=60)) for _ in range(4)] + ["a" * 80, "ab" * 50, "é" * 30]
    rows = [(k, "".join(rng.choice(base)[rng.randint(0, 30) : rng.randint(30, 90)] for _ in range(3))) for k in range(70)]
    rows += [(80, None), (81, ""), (82, "x" * 19), (83, rows[0][1])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut(spark.createDataFrame(rows, "doc_id bigint, text string"), width=20, first_stays=first_stays, hot=hot).collect()}
    assert [got[k] for k, _ in rows] == brute_repeats(rows, 20, first_stays)


@pytest.mark.parametrize("first_stays", [False, True])
def test_one_header_in_every_document(spark, monkeypatch, first_stays):
    """Parts of a hot anchor that are equal come to the tasks once, however many documents have them."""
    header, rng = "".join(random.Random(1).choices("abcdef", k=70)), random.Random(2)
    rows = [(k if k % 9 else None, "".join(rng.choices("ab", k=rng.randint(5, 30))) + header + "".join(rng.choices("ab", k=30))) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.monotonically_increasing_id())
    sizes, whole = [], repeats._bounded

    def counted(tables, *options):
        groups, covered = whole(tables, *options)
        sizes.append([df.groupBy("group").count().agg(F.max("count")).first()[0] for df in (tables[0], groups)])
        return groups, covered

    monkeypatch.setattr(repeats, "_bounded", counted)
    got = Counter((r.doc_id, r.kept_sha256) for r in repeats.cut(table, width=20, first_stays=first_stays, hot=3).collect())
    assert sizes[0][0] > 200 and sizes[0][1] <= 3
    plain = Counter((r.doc_id, r.kept_sha256) for r in repeats.cut(table, width=20, first_stays=first_stays).collect())
    assert got == plain and len(sizes) == 1
    if not first_stays:
        assert got == Counter((k, made[3]) for (k, _), made in zip(rows, brute_repeats(rows, 20, False), strict=True))


def test_factor_arrays_against_brute_force():
    rng = random.Random(3)
    for kind, width in ((np.uint8, 20), (np.uint32, 7)):
        for text in ("".join(rng.choices("ab", k=300)), "a" * 90 + "b" * 60 + "a" * 90, "ab" * 80 + "".join(rng.choices("abc", k=99))):
            symbols = np.frombuffer(text.encode(), np.uint8).astype(kind)
            places = np.array(sorted(rng.sample(range(len(text) - width + 1), 150)))
            length, source = repeats.longest_previous(symbols, places, width)
            for i, p in enumerate(places):
                common = [next((k for k in range(width) if text[q + k] != text[p + k]), width) for q in places[:i]]
                assert length[i] == max(common, default=0)
                assert source[i] == -1 and not length[i] or common[source[i]] == length[i]
    for n in (1, 2, 50, 4_000):
        position = np.random.RandomState(n).permutation(n)
        for p in (position, np.append(np.arange(1, n + 1), 0)):
            before, after = repeats.smaller_positions(p)
            for i in range(0, len(p), 1 + len(p) // 60):
                assert before[i] == max((j for j in range(i) if p[j] < p[i]), default=-1)
                assert after[i] == min((j for j in range(i + 1, len(p)) if p[j] < p[i]), default=-1)


def test_repeats_on_odd_rows(odd, odd_rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in repeats.cut(odd).collect())
    assert got == sorted((str(k), n, m) for (k, *_), (n, m, _, _) in zip(odd_rows, brute_repeats(odd_rows, 400, False), strict=True))
    counted = {r.doc_id: r.n_passage_words for r in repeats.cut(odd, passages=51).collect()}
    assert counted[7] == counted[8] == 300 and counted[9] == 300 and not counted[6] and not counted[1]
    kept = repeats.deduplicated(odd)
    assert kept.columns == odd.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 8 not in texts and texts[7] == odd_rows[6][1] and texts[1] is None and len(texts[9]) < 400
    assert kept.filter("doc_id = 9").count() == 1
    assert repeats.deduplicated(odd.limit(0)).count() == 0


# 5 Decontamination


def test_decontamination_against_windows(spark, odd, odd_rows):
    items = [(1, " ".join(words(odd_rows[6][1])[20:33]).upper()), (2, "wholly absent text"), (3, "Ünïcödé"), (4, None), (5, "!!"), (6, " ".join(words(odd_rows[5][1])[-12:])), (7, "a")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    want = []
    for key, t, _ in odd_rows:
        w, hit, found = words(t), set(), set()
        for i, n in itertools.product(range(len(w)), (1, 3, 10)):
            if items_here := windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None:
                hit |= set(range(i, i + n))
                found |= items_here
        want.append((str(key), len(w), len(hit), sorted(found)))
    for size in (32_000_000, 40):  # one block of items, and several
        got = decontaminate.scan(odd, benchmark, most_bytes=size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(want)
    clean = decontaminate.clean(odd, benchmark)
    assert clean.columns == odd.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(k for k, _, n, _ in want if not n)
    cut = decontaminate.clean(odd, benchmark, remove="spans")
    assert {r.doc_id: len(words(r.text)) for r in cut.collect()} == {int(k) if k != "None" else None: n - m for k, n, m, _ in want}
    assert decontaminate.clean(odd, benchmark.limit(0)).count() == len(odd_rows)
    assert decontaminate.clean(odd.limit(0), benchmark).count() == 0


# 6 Fingerprints


def brute_symbols(text):
    return re.findall(r"[\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF]|[^\s\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF]{1,6}", text, re.ASCII)


def brute_fingerprints(spark, texts):
    """Syncmer hashes by plain loops; Spark only hashes, symbol by symbol and run by run."""

    def hashed(rows, kind):
        width = len(rows[0])
        df = spark.createDataFrame(rows, ", ".join(f"c{i} {kind}" for i in range(width)))
        return dict(zip(rows, [r[0] for r in df.select(F.xxhash64(*df.columns)).collect()], strict=True))

    cut = [brute_symbols(t) for t in texts]
    of_symbol = hashed(sorted({(x,) for s in cut for x in s}), "string")
    pairs = sorted({(of_symbol[a,], of_symbol[b,]) for s in cut for a, b in itertools.pairwise(s)})
    of_pair = hashed(pairs, "bigint")
    runs = [[of_pair[of_symbol[a,], of_symbol[b,]] for a, b in itertools.pairwise(s)] for s in cut]
    closed = [{tuple(r[i : i + 4]) for i in range(len(r) - 3) if min(r[i : i + 4]) in (r[i], r[i + 3])} for r in runs]
    of_mer = hashed(sorted(set().union(*closed)), "bigint")
    whole = hashed([(t,) for t in sorted(set(texts))], "string")
    high = lambda h: (h % 2**64) >> 32
    sets = [sorted({high(of_mer[m]) for m in c}) or ([high(whole[t,])] if t else []) for c, t in zip(closed, texts, strict=True)]
    return [s[: max(64, -(-len(s) // 16))] for s in sets]


def brute_likeness(a, b):
    known = min([len(x) for x in (a, b) if len(x) >= 64], default=None)
    union = sorted(set(a) | set(b))[:known]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def test_fingerprints_against_brute_force(spark, odd, odd_rows):
    rows = fingerprints.fingerprint(odd).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] == "" and prints[7] == prints[8] != prints[9]
    assert fingerprints.fingerprint(odd.limit(0)).count() == 0
    more = [(20 + i, prose(800, n)) for i, n in enumerate((20, 62, 63, 64, 65, 70, 2_500))]
    more += [(40, "今天天气很好" * 9), (41, "今天天气很好" * 8 + "我"), (42, "x" * 500), (43, "x" * 450 + "y" * 30)]
    plain = [(k, t) for k, t, _ in odd_rows if k != 9] + more
    docs = spark.createDataFrame(plain, "doc_id bigint, text string")
    order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    found = brute_fingerprints(spark, texts + edited)
    own, changed = found[: len(texts)], found[len(texts) :]
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    assert len(got) == len(plain)
    for i, (key, _) in enumerate(order):
        r, digits = got[key], lambda s: "".join(f"{h:08x}" for h in s)
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digits(own[i]), digits(changed[i]))
        assert r.near_edited == pytest.approx(brute_likeness(own[i], changed[i]))
        assert r.near_next == pytest.approx(brute_likeness(own[i], own[(i + 1) % len(own)]))
    assert got[23].near_next > 0.9 and got[8].near_next == 1.0 and len(got[26].fingerprint) > 8 * 64
    assert fingerprints.compare_edited(odd).count() == len(odd_rows) and fingerprints.compare_edited(odd.limit(0)).count() == 0


def test_syncmers_are_free_of_context(spark):
    core = prose(9, 80)
    rows = [(1, f"{prose(10, 40)} {core} {prose(11, 50)}"), (2, f"{prose(12, 55)} {core} {prose(13, 40)}")]
    found = fingerprints.anchors(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    at = [{r.hash: r.position for r in found if r.doc_id == k} for k in (1, 2)]
    shared = {at[1][h] - at[0][h] for h in at[0].keys() & at[1].keys()}
    assert len(shared) == 1 and len(at[0].keys() & at[1].keys()) > 20


# 7 Language


def test_language(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["zh", "ich", "ung", "sch"], "cc": ["при", "вет", "мир", "да"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text(k, 60), k) for i, k in enumerate(list(sounds) * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    asked = [(0, text("aa", 50)), (1, text("bb", 50)), (2, text("cc", 50)), (3, None), (4, ""), (5, "12 34 !"), (6, text("aa", 40) + " " + text("bb", 90)), (7, text("cc", 2) + " " + text("aa", 30))]
    docs = spark.createDataFrame(asked, "doc_id bigint, text string").withColumn("Score", F.lit("own"))
    got = {r.doc_id: r for r in language.identify(docs, model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["aa", "bb", "cc", "und", "und", "und", "bb", "aa"]
    assert [s.lang for s in got[6].spans] == ["aa", "bb"] and [s.lang for s in got[7].spans] == ["cc", "aa"] and got[3].spans == []
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6, 7]
    none = language.fit(docs.limit(0).withColumn("lang", F.lit("x")))
    assert language.identify(docs, none).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0


def test_language_on_odd_rows(spark, odd, odd_rows):
    model = language.fit(odd)
    assert model.languages == ["de", "en", "fr"] or model.languages == ["de", "en"]
    got = language.identify(odd, model).collect()
    assert len(got) == len(odd_rows) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 5)} == {"und"}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (7, 8)}) == 1
    kept = language.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 5})
    assert kept.filter("lang is null").count() == 0
    unknown = language.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.doc_id for r in language.accepted(odd, unknown).collect()} == {r[0] for r in odd_rows if r[0] not in (1, 2, 3, 5)}
    alien = spark.createDataFrame([(1, "今天天气很好" * 30, None), (2, prose(5, 80), None), (3, "qzxv kjwq xzzk vvqk " * 60, "en")], "doc_id bigint, text string, lang string")
    many = spark.createDataFrame([(i, prose(600 + i, 90), "en") for i in range(40)], alien.schema)
    assert [r.doc_id for r in language.accepted(alien, language.fit(many)).collect()] == [2]


def test_long_texts_are_learnt_from(spark):
    rows = [(0, prose(1, 60_000), "xx"), *((i, "привет мир да " * 20, "yy") for i in range(1, 5))]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["xx", "yy"] and model.trigrams[:, 0].std() > 0


def test_best_path_is_the_best_of_all():
    rng = np.random.RandomState(4)
    model = language.Model(["a", "b", "c"], *[np.zeros((1, 3))] * 3, 3.0)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = -rng.exponential(2.0, (n, 3))
        first = np.array([0, n])

        def value(path, scores=scores):
            return sum(scores[i, k] for i, k in enumerate(path)) - 3 * sum(x != y for x, y in itertools.pairwise(path))

        best = max(map(value, itertools.product(range(3), repeat=n)))
        assert value(model.labels(scores, first)) == pytest.approx(best)


# 8 Licences


@pytest.fixture(scope="module")
def license_model():
    spoken = [
        "the general public met the person without rights", "all the free files", "my driving license was not renewed by the public office", "wir gehen mit der Bahn zum Hafen",
        "Er kam mit dem Schiff und ging mit dem Zug.", "published by the author under the bridge", "todos los barcos de la ciudad", "the public domain of the sea", "la licencia del barco",
    ]
    return licenses.train([prose(i, 30) for i in range(200)] + spoken * 3)


#: Notices in words that no training form has, and the family each names.
NOTICES = [
    ("This package is made available to you under the terms of the MIT license.", "mit"), ("MIT", "mit"), ("License MIT", "mit"), ("Lizenziert unter der MIT-Lizenz", "mit"),
    ("Code: MIT License", "mit"), ("CC BY-SA 4.0", "cc-by-sa"), ("Text is shared under CC BY-SA 3.0 by its writers", "cc-by-sa"), ("CC BY-NC 4.0", "cc-by-nc"),
    ("Images: CC BY 4.0", "cc-by"), ("CC0 1.0", "cc0"), ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("GPL v2", "gpl"), ("Distributed under the GNU GPL version 2 or later", "gpl"),
    ("You can use it under the GNU General Public License, version 3 of the foundation.", "gpl"), ("AGPL v3", "agpl"), ("BSD", "bsd"), ("Published with a BSD 3-Clause License", "bsd"),
    ("Apache License 2.0", "apache-2.0"), ("The software is under the Apache License, Version 2.0, January 2004", "apache-2.0"), ("MPL 2.0 applies to all files", "mpl-2.0"),
    ("LGPL v3", "lgpl"), ("Copyright 2020 by them. All rights reserved.", "proprietary"), ("Tous droits réservés.", "proprietary"), ("Unlicense", "unlicense"), ("ISC License", "isc"),
    ("Publié sous la licence MIT", "mit"), ("Released under EPL-2.0", "epl"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
]


def test_license_notices_held_out(spark, license_model):
    docs = spark.createDataFrame([(i, f"{prose(i, 40)}\n{n}\n{prose(i + 90, 30)}") for i, (n, _) in enumerate(NOTICES)], "doc_id int, text string")
    got = {r.doc_id: r.family for r in licenses.scan(docs, license_model).collect()}
    missed = [(n, got[i]) for i, (n, family) in enumerate(NOTICES) if got[i] != family]
    assert len(missed) <= 0.1 * len(NOTICES), missed
    clean = spark.createDataFrame([(i, prose(500 + i, 60)) for i in range(60)] + [(90, "Wir fahren mit dem Bus"), (91, "the rights of all"), (92, "free software")], "doc_id int, text string")
    assert licenses.scan(clean, license_model).filter("family not in ('none', 'unknown')").count() == 0


def test_license_scan_against_every_line(spark, odd_rows, license_model):
    rng = random.Random(4)
    bits = [w for k, texts in licenses.templates().items() for t in texts for w in t.split()] + prose(5, 60).split() + licenses.LEADS
    lines = [" ".join(rng.choices(bits, k=rng.randint(1, 7))) for _ in range(300)] + [n for n, _ in NOTICES] + ["", "…", "İSTANBUL MIT"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for i in range(150)] + [(200 + i, t) for i, (_, t, _) in enumerate(odd_rows)]
    rows.append(rows[3])
    index = {g: i for i, g in enumerate(license_model.features)}
    stated, known = licenses.patterns(), licenses.sentences()

    def judged(line):
        g = licenses.grams(line)
        z = license_model.bias + sum((license_model.weights[index[x]] for x in g if x in index), np.zeros(len(license_model.bias)))
        if not g or z[:-1].max() <= z[-1]:
            return None
        p, k = np.exp(z - z.max()) / np.exp(z - z.max()).sum(), license_model.families[z.argmax()]
        n = max(len(licenses.words(line)) - 1, licenses.WHOLE)
        agreement = max((len(g & own) / min(n, len(own)) for f, own in known if f == k), default=0)
        if k in stated and re.search(stated[k], " ".join(licenses.cased(line))):
            agreement = 1.0
        return k, p.max(), agreement, p.max() >= licenses.LEAST and agreement >= licenses.AGREE

    want = Counter()
    for key, text in rows:
        found = [(i, *j) for i, line in enumerate((text or "").split("\n")) if (j := judged(line))]
        good = [f for f in found if f[4]]
        best = max(good, key=lambda f: (round(f[2], 9), -f[0]))[1] if good else "unknown" if found else "none"
        want[key, best, ",".join(sorted({f[1] for f in good})), len(good)] += 1
    got = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), license_model).collect()
    assert Counter((r.doc_id, r.family, r.families, r.n_paragraphs) for r in got) == want
    assert sum(n for k, n in want.items() if k[3]) > 60


#: Lines that name no licence, though their words stand in names of licences.
NO_NOTICES = [
    "Mit und.", "Einver chenheit eräieä den mit.", "He studied physics at MIT in Boston", "the bsd conference met in ottawa", "isc", "... as by nd insh", "Die Software wird mit Lizenz geliefert",
    "Students at MIT licensed the patent", "licensed by MIT to a company", "MIT FREUNDLICHEN GRÜSSEN", "wurde veröffentlicht mit Bildern", "the public domain", "a licence of the boat", "cc by nd",
]
#: Lines of wrapped licence texts, and notices in lower case.
WRAPPED = [
    ("IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,", "mit"), ("it under the terms of the GNU General Public License as published by", "gpl"),
    ("Permission to use, copy, modify, and distribute this software for any", "isc"), ("license: mit", "mit"), ("license = apache-2.0", "apache-2.0"), ("EUPL-1.2", "eupl"), ("WTFPL", "wtfpl"),
    ("Boost Software License - Version 1.0", "bsl-1.0"), ("Python Software Foundation License Version 2", "psf-2.0"), ("GNU Free Documentation License", "gfdl"), ("zlib License", "zlib"),
]


def test_licenses_are_stated_not_only_spelt(spark, license_model):
    lines = [(n, "") for n in NO_NOTICES] + WRAPPED
    got = licenses.scan(spark.createDataFrame([(i, n) for i, (n, _) in enumerate(lines)], "doc_id int, text string"), license_model).collect()
    families = {lines[r.doc_id][0]: r.families for r in got}
    assert {n: f for n, f in families.items() if n in NO_NOTICES and f} == {}
    missed = [(n, families[n]) for n, family in WRAPPED if families[n] != family]
    assert len(missed) <= 1, missed


def test_licenses_of_the_documents(spark):
    """Every finding on the table is a notice that its line spells out, and every such line is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spelt = {
        r"Apache License, Version 2\.0": "apache-2.0", r"MIT License": "mit", r"GNU General Public License, version 3": "gpl", r"All rights reserved\.": "proprietary", r"CC BY-NC 4\.0": "cc-by-nc",
    }
    want = {r.doc_id: ",".join(sorted({f for p, f in spelt.items() if re.search(p, r.text or "")})) for r in docs.collect()}
    got = {r.doc_id: r.families for r in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_licenses_on_odd_rows(spark, odd, odd_rows, license_model):
    assert licenses.scan(odd, license_model).filter("family not in ('none', 'unknown')").count() == 0
    assert licenses.scan(odd, license_model).count() == len(odd_rows) and licenses.scan(odd.limit(0), license_model).count() == 0
    assert licenses.fit(odd).families[-1] == "unknown" and licenses.fit(odd.limit(0)).families[-1] == "unknown"


def test_license_classes_are_calibrated(license_model):
    p = license_model.probabilities(["Distributed under the terms of the Mozilla Public License, version 2.0.", prose(5, 20), ""])
    names = [license_model.families[k] for k in p.argmax(axis=1)]
    assert names == ["mpl-2.0", "unknown", "unknown"] and p.max(axis=1).min() > 0.5


# 9 Packing


def test_packing(spark, odd, odd_rows, vocabularies):
    got = packing.pack(odd, vocabularies["word_bpe_49k"], capacity=128).toPandas()
    tokenizer = Tokenizer.from_file(vocabularies["word_bpe_49k"])
    want = Counter()
    for key, text, _ in odd_rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 128)):
            part = ids[start : start + 128]
            want[str(key), piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    keys = ["None" if k != k else str(int(k)) for k in got["doc_id"]]
    assert Counter(zip(keys, got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == list(np.cumsum(s["length"]) - s["length"]) and s["length"].sum() <= 128
    assert packing.pack(odd.limit(0), vocabularies["word_bpe_49k"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_near_the_bound(seed):
    rng = np.random.RandomState(seed)
    lengths = np.clip(rng.lognormal(4, 1, 4_000).astype(int), 1, 256)
    counts = np.bincount(lengths, minlength=257)
    chosen = packing.configurations(counts)
    packed = np.zeros(257, int)
    for config, n in chosen.items():
        assert packing.fill(config) <= 256
        for length, each in config:
            packed[length] += n * each
    assert (packed == counts).all()
    bound = -(-lengths.sum() // 256)
    assert bound <= sum(chosen.values()) <= 1.01 * bound + 1


def test_program_places_the_bulk():
    """Lengths like those of the documents of sf0.1: about 11,000 pieces of 1,850 lengths, some of them full."""
    rng = np.random.RandomState(11)
    lengths = np.append(np.clip(rng.lognormal(6.2, 1.1, 10_000).astype(int), 1, 2_047), np.full(1_300, 2_048))
    for times in (1, 10):
        counts = times * np.bincount(lengths, minlength=2_049)
        chosen, left = packing.programmed(counts)
        rest = packing.best_fit(left)
        assert all(packing.fill(c) <= 2_048 for c in chosen) and sum(chosen.values()) > 0.9 * (sum(chosen.values()) + sum(rest.values()))
        held = sum((Counter({x: a * n for x, a in c}) for c, n in chosen.items()), Counter())
        assert all(held[x] + left[x] == counts[x] for x in range(2_049))
        assert sum(chosen.values()) + sum(rest.values()) <= sum(packing.best_fit(counts).values())
    uneven = np.zeros(2_049, int)
    uneven[[1_500, 400]] = 1_000, 2_000  # no sequence of these is full: pairs, and fives of what is left
    assert sum(packing.programmed(uneven)[0].values()) > 1_000 and sum(packing.configurations(uneven).values()) == 1_200


def test_knapsack_is_exact():
    value = np.full(13, -np.inf)
    value[[3, 5, 7]] = 3.1, 5.5, 6.9
    best, choice = packing.knapsack(value)
    exact = [max(a * 3.1 + b * 5.5 + c * 6.9 for a in range(5) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= room) for room in range(13)]
    assert best == pytest.approx(exact)
    assert sum(x * a for x, a in packing.traced(choice, 12, Counter())) <= 12


# 10 Sharding


def test_sharding(spark, odd, odd_rows):
    names = ["a", "b", "c", "d"]
    table = sharding.lookup_table(names, 997)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.lookup_table(names[:3], 997)
    moved = sum(x != y for x, y in zip(table, fewer, strict=True) if x < 3)
    assert moved < 0.2 * 997
    weighted = Counter(sharding.lookup_table(["a", "b"], 997, [3, 1]))
    assert weighted[0] == pytest.approx(3 * weighted[1], abs=4)
    got = sharding.place(odd, names, size=997)
    assert got.count() == len(odd_rows) and {"slot", "shard"} <= set(got.columns) and len(got.columns) == len(odd.columns)
    for r in got.collect():
        slot = sharding.digest_number("" if r.doc_id is None else str(r.doc_id)) % 997
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.place(odd.limit(0), names, size=997).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 997)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_lookup_table_against_whole_permutations():
    names, size = ["one", "two", "three"], 101
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    preference = {n: [(number(f"{n}/offset") % size + k * (number(f"{n}/skip") % (size - 1) + 1)) % size for k in range(size)] for n in names}
    assert all(sorted(p) == list(range(size)) for p in preference.values())
    owner = {}
    while len(owner) < size:
        for n in names:
            if len(owner) < size:
                owner[next(s for s in preference[n] if s not in owner)] = n
    assert [names[i] for i in sharding.lookup_table(names, size)] == [owner[s] for s in range(size)]


def test_written_shards(spark, tmp_path, odd, odd_rows):
    placed = sharding.place(odd.select("doc_id", "text"), ["a", "b"], size=997)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(odd_rows)
