"""No text is lost from all copies of a passage, whatever the ids; words that powers cannot tell apart get their own ids."""

import bisect
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rulefold.llm import repeats
from rulefold.llm.tokens import Encoder
from tests.llm.conftest import prose


@pytest.mark.parametrize("ids", ["distinct", "one null", "both null", "equal"])
def test_every_passage_stays_in_one_document(spark, ids):
    rows, passages = [], []
    for k in range(40):
        passage = [f"p{k}x{i}" for i in range(160)]
        passages.append(passage)
        a, b = {"distinct": (2 * k, 2 * k + 1), "one null": (None, k), "both null": (None, None), "equal": (k, k)}[ids]
        rows += [(a, f"{prose(5 * k, 30 + k % 7)} {' '.join(passage)} {prose(5 * k + 1, 20)}"), (b, f"{prose(5 * k + 2, 25)} {' '.join(passage)} {prose(5 * k + 3, 40 - k % 5)}")]
    kept = repeats.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), words=51).collect()
    found = [w for r in kept for w in r.text.split() if w.startswith("p") and "x" in w]
    assert sorted(found) == sorted(w for p in passages for w in p)  # once each


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_ids_of_words_that_powers_confuse(vocabularies, name):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    library = Tokenizer.from_file(vocabularies[name])
    text = f"{word} {other} {word.upper()}"
    got = Encoder(open(vocabularies[name]).read()).encode(pa.array([text]))
    assert got[0][0].tolist()[:-1] == library.encode(text, add_special_tokens=False).ids


def test_settled_ranks_are_not_sorted_again(monkeypatch):
    sizes, whole = [], repeats._in_order
    monkeypatch.setattr(repeats, "_in_order", lambda keys, bits: sizes.append(len(keys)) or whole(keys, bits))
    rng = random.Random(4)
    for kind, width in ((np.uint8, 30), (np.uint32, 30)):
        text = "".join(rng.choices("abc", k=400)) + "a" * 60 + "".join(rng.choices("ab", k=90)) * 2
        sizes.clear()
        for depth, ranks in repeats.suffix_ranks(np.frombuffer(text.encode(), np.uint8).astype(kind), width):
            places = [text[i : i + depth] for i in range(len(text) - width + 1)]
            tails = sorted(text[i : i + depth] for i in range(len(text)))
            assert ranks[: len(places)].tolist() == [bisect.bisect_left(tails, p) for p in places]
        assert sizes[0] == len(text) and sizes[-1] < len(text) / 2
    keys = np.random.RandomState(1).randint(0, 2**63, 999).astype(np.uint64) % np.uint64(2**62) // np.uint64(2**50)
    for bits in (12, 62):  # sorted with the indices, and by them
        order, numbers = whole(keys, bits)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and numbers.tolist() == sorted(keys.tolist())


def test_anchors_are_the_leftmost_least():
    rng = random.Random(6)
    text = "".join(rng.choices("ab", k=300)) + "ab" * 60 + "".join(rng.choices("ab", k=70)) * 2
    symbols, width, anchor = np.frombuffer(text.encode(), np.uint8), 20, 5
    grams = repeats.B.span_hashes(repeats.B.prefix_sums(symbols), np.arange(len(text) - anchor + 1), np.arange(anchor, len(text) + 1)).tolist()
    found = {}
    made = repeats.runs(symbols, np.array([0, len(text)]), width, anchor)
    for first, last, at in zip(*(made[k].tolist() for k in ("first", "last", "at")), strict=True):
        found |= dict.fromkeys(range(first, last + 1), at)
    reach = width - anchor + 1
    assert found == {i: i + min(range(reach), key=lambda k: grams[i + k]) for i in range(len(text) - width + 1)}
