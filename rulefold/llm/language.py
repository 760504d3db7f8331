"""Language identification of mixed texts: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters. The Unicode ranges its letters lie in narrow the candidates to the languages that use that
script in the training texts. Each candidate scores the word by a naive Bayes model of its byte trigrams and 4-grams
(word ends included). The labels of a text are the best path over its words, where each change of language costs
`penalty`; runs of one label are the language spans. The text's language is the one that labels most of its letters.

Training uses a bounded sample: of each language about `sample` labelled texts or SAMPLE_BYTES of text, whichever is less
(drawn by a hash of the text, whatever its length, and always the text of the least hash), collected to the driver.
Prediction is one pass without a shuffle.

Evidence that a text is in a language at all is the mean log likelihood of its n-grams in the likeliest language of each
word. The least that a language's own training texts have, less a margin, is what a document needs to be accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefold.llm import bytes as B

SAMPLE = 1_500
SAMPLE_BYTES = 8_000_000
#: Added to what the training texts show when evidence is asked of a document: nats an n-gram, and more for few n-grams.
MARGIN = 1.0
MARGIN_FEW = 20.0
#: Letters from which on a training text counts for that.
FEW = 200
PENALTY = 14.0
UNKNOWN = "und"
BITS = 16
#: A word outside a language's scripts costs that language this much.
FOREIGN = 60.0
#: Unicode ranges of the common scripts (first and last code point).
SCRIPTS = {
    "latin": [(0x0000, 0x024F), (0x1E00, 0x1EFF)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
_NAMES = list(SCRIPTS)
#: Script of each block of 64 code points of the basic plane; len(_NAMES): some other one.
_BLOCKS = np.full(1024, len(_NAMES), np.int8)
for _i, _ranges in enumerate(SCRIPTS.values()):
    for _low, _high in _ranges:
        _BLOCKS[_low >> 6 : (_high >> 6) + 1] = _i
_LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_SEEN = np.where(_LETTERS, B.LOWER, 32).astype(np.uint8)


@dataclass
class Slice:
    """The words of some texts: places of their letters in `codes` (texts padded by spaces), n-gram buckets, scripts."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    trigrams: np.ndarray
    quads: np.ndarray
    scripts: np.ndarray


def read_slice(data: np.ndarray, offsets: np.ndarray) -> Slice:
    lengths = np.diff(offsets)
    shift = np.repeat(np.arange(1, len(lengths) + 1), lengths)
    codes = np.full(len(data) + len(lengths) + 3, 32, np.uint8)
    codes[np.arange(len(data)) + shift] = _SEEN[data]
    moved = offsets + np.arange(1, len(offsets) + 1)
    starts, ends, first = B.words(codes, moved, codes_are_letters())
    wide = codes.astype(np.uint32)
    tri = np.zeros(len(codes), np.uint32)
    tri[2:] = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    quad = tri.copy()
    quad[3:] |= np.where(codes[1:-2] == 32, 0, codes[:-3]).astype(np.uint32) << 24
    down = np.uint32(32 - BITS)
    tri = (tri * np.uint32(0x9E3779B1)) >> down
    quad = (quad * np.uint32(0x85EBCA6B)) >> down
    scripts = np.zeros(len(starts), np.int8)
    leads = np.flatnonzero(codes >= 0xC2)
    if len(leads):
        lead, second = codes[leads].astype(np.int32), codes[leads + 1].astype(np.int32)
        block = np.where(lead < 0xE0, lead & 31, np.where(lead < 0xF0, (lead & 15) << 6 | (second & 63), 1023))
        found = _BLOCKS[np.minimum(block, 1023)]
        other = found != 0
        scripts[np.searchsorted(starts, leads[other], "right") - 1] = found[other]
    return Slice(starts, ends, first, tri, quad, scripts)


def codes_are_letters() -> np.ndarray:
    table = np.ones(256, bool)
    table[32] = False
    return table


@dataclass
class Model:
    languages: list[str]
    trigrams: np.ndarray  # bucket x language, log probabilities
    quads: np.ndarray
    allowed: np.ndarray  # script x language
    penalty: float
    least: float = -np.inf  # the least mean log likelihood of an n-gram in the training texts

    def evidence(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: sum of the log likelihoods of its words in their likeliest languages (of those that use the word's
        script), n-grams in these words, and letters in words of a script that no language uses."""
        best = np.full(len(s.starts), -np.inf)
        known = self.allowed[s.scripts]
        for k in range(len(self.languages)):
            sums = np.zeros(len(s.trigrams) + 1)
            np.cumsum(self.trigrams[:, k][s.trigrams] + self.quads[:, k][s.quads], out=sums[1:])
            best = np.where(known[:, k], np.maximum(best, sums[s.ends + 1] - sums[s.starts + 1]), best)
        size = s.ends - s.starts
        readable = known.any(axis=1)
        return tuple(
            _by_text(np.where(which, value, 0), s.first) for which, value in ((readable, best), (readable, size), (~readable, size))
        )

    def word_scores(self, s: Slice) -> np.ndarray:
        """Words x languages: log likelihood of the word's n-grams, less the best candidate's."""
        out = np.empty((len(s.starts), len(self.languages)))
        for k in range(len(self.languages)):
            sums = np.zeros(len(s.trigrams) + 1)
            np.cumsum(self.trigrams[:, k][s.trigrams] + self.quads[:, k][s.quads], out=sums[1:])
            out[:, k] = sums[s.ends + 1] - sums[s.starts + 1]
        allowed = self.allowed[s.scripts]
        allowed = allowed | ~allowed.any(axis=1, keepdims=True)
        out[~self.allowed.any(axis=1)[s.scripts]] = 0  # a script of no language says nothing
        out -= out.max(axis=1, keepdims=True, initial=-np.inf, where=allowed)
        out[~allowed] = -FOREIGN
        return np.maximum(out, -FOREIGN)

    def labels(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language of each word on the best path of its text."""
        counts = np.diff(first)
        filled = np.flatnonzero(counts)
        out = np.zeros(len(scores), np.int32)
        if not len(filled):
            return out
        totals = np.add.reduceat(scores, first[filled], axis=0)
        best = totals.argmax(axis=1)
        row = np.repeat(np.arange(len(filled)), counts[filled])
        out[:] = best[row]
        # If no run of words speaks for another language by more than half the penalty, no path with a change wins.
        against = scores - scores[np.arange(len(scores)), out][:, None]
        far = 1e3 + 2 * FOREIGN * counts.max()
        sums = np.zeros((len(scores) + 1, scores.shape[1]))
        np.cumsum(against, axis=0, out=sums[1:])
        sums[1:] -= far * row[:, None]
        before = np.vstack([sums[:1], sums[1:-1]])
        starts = first[filled]
        before[starts] = np.vstack([sums[:1], sums[starts[1:]] - far])
        gain = (sums[1:] - np.minimum.accumulate(before, axis=0)).max(axis=1)
        mixed = np.flatnonzero(np.maximum.reduceat(gain, starts) > self.penalty / 2)
        if len(mixed):
            self._viterbi(scores, starts[mixed], counts[filled][mixed], out)
        return out

    def _viterbi(self, scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Step by step through the words, all texts at a time."""
        order = np.argsort(-counts, kind="stable")
        starts, counts = starts[order], counts[order]
        active = np.searchsorted(-counts, -np.arange(counts[0]), "left")  # texts with more words than t
        origin = np.zeros((counts.sum(), scores.shape[1]), np.int16)
        base = np.concatenate([[0], np.cumsum(active)])
        value = scores[starts].copy()
        own = np.arange(scores.shape[1])
        for t in range(1, counts[0]):
            a = active[t]
            now = value[:a]
            top = now.argmax(axis=1)
            switched = now[np.arange(a), top] - self.penalty
            stays = now >= switched[:, None]
            origin[base[t] : base[t] + a] = np.where(stays, own, top[:, None])
            value[:a] = scores[starts[:a] + t] + np.where(stays, now, switched[:, None])
        label = value.argmax(axis=1)
        for t in range(counts[0] - 1, -1, -1):
            a = active[t]
            out[starts[:a] + t] = label[:a]
            if t:
                label[:a] = origin[base[t] : base[t] + a][np.arange(a), label[:a]]

    def predict(self, column: pa.Array, with_spans: bool) -> tuple[list, list, list]:
        names, confidence, spans = [], [], []
        for low, high, data, offsets in B.text_slices(column):
            s = read_slice(data, offsets)
            scores = self.word_scores(s)
            labels = self.labels(scores, s.first)
            letters = s.ends - s.starts
            rows = np.repeat(np.arange(high - low), np.diff(s.first))
            weight = np.zeros((high - low, len(self.languages)))
            np.add.at(weight, (rows, labels), letters)
            total = np.zeros((high - low, len(self.languages)))
            for k in range(len(self.languages)):
                total[:, k] = np.bincount(rows, scores[:, k], high - low)
            # a path's letters decide; among equal shares the likelier language
            chosen = (weight + 1e-9 * (total - total.min(axis=1, keepdims=True))).argmax(axis=1)
            at = np.arange(high - low)
            share = weight[at, chosen] / np.maximum(weight.sum(axis=1), 1)
            rest = total.copy()
            rest[at, chosen] = -np.inf
            margin = total[at, chosen] - (rest.max(axis=1) if rest.shape[1] > 1 else -np.inf)
            sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            for i in range(high - low):
                said = bool(weight[i].sum()) and has_letter(data[offsets[i] : offsets[i + 1]])
                names.append(self.languages[chosen[i]] if said else UNKNOWN)
                confidence.append(float(share[i] * max(sure[i], 0.5)) if said else 0.0)
            if with_spans:
                for i in range(high - low):
                    a, b = s.first[i], s.first[i + 1]
                    own, move = labels[a:b], int(offsets[i]) + i + 1
                    cuts = np.flatnonzero(np.diff(own)) + 1 if b > a else []
                    edges = [0, *cuts, b - a] if b > a else []
                    spans.append(
                        [
                            {"lang": self.languages[own[x]], "start": int(s.starts[a + x]) - move, "end": int(s.ends[a + y - 1]) - move}
                            for x, y in zip(edges[:-1], edges[1:], strict=True)
                        ]
                    )
        return names, confidence, spans


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return sums[first[1:]] - sums[first[:-1]]


def has_letter(data: np.ndarray) -> bool:
    return bool((_LETTERS[data] & (data < 128)).any()) or any(c.isalpha() for c in data.tobytes().decode(errors="ignore"))


def _one(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return made if isinstance(made, pa.Array) else pa.concat_arrays([c.cast(pa.large_string()) for c in made.chunks] or [pa.array([], pa.large_string())])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """Learn from rows with a text and a language. Without any the model knows no language and calls every text `und`."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    of_each = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(draw).alias("least")).collect()
    counts = {r["lang"]: max(r["least"] + 1e-9, min(1.0, sample / r["n"], SAMPLE_BYTES / max(r["bytes"], 1))) for r in of_each}
    if not counts:
        none = np.zeros((1 << BITS, 0), np.float32)
        return Model([], none, none, np.zeros((len(_NAMES) + 1, 0), bool), penalty)
    rate = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))
    drawn = rows.filter(draw < rate[F.col("lang")]).toArrow()
    languages = sorted(counts)
    size = 1 << BITS
    tri, quad = np.zeros((size, len(languages))), np.zeros((size, len(languages)))
    scripts = np.zeros((len(_NAMES) + 1, len(languages)))
    for k, name in enumerate(languages):
        for _, _, data, offsets in B.text_slices(_one(drawn.filter(pa.compute.equal(drawn["lang"], name))["text"])):
            s = read_slice(data, offsets)
            inside = np.zeros(len(s.trigrams) + 1, np.int32)
            np.add.at(inside, s.starts + 1, 1)
            np.add.at(inside, s.ends + 1, -1)
            at = np.cumsum(inside[:-1]) > 0
            tri[:, k] += np.bincount(s.trigrams[at], minlength=size)
            quad[:, k] += np.bincount(s.quads[at], minlength=size)
            scripts[:, k] += np.bincount(s.scripts, minlength=len(_NAMES) + 1)
    logs = [np.log((x + 0.2) / (x.sum(axis=0) + 0.2 * size)).astype(np.float32) for x in (tri, quad)]
    # the two orders overlap; together they count once
    allowed = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    allowed[len(_NAMES)] = False
    model = Model(languages, logs[0] / 2, logs[1] / 2, allowed, penalty)
    least = []
    for _, _, data, offsets in B.text_slices(_one(drawn["text"])):
        total, n, _ = model.evidence(read_slice(data, offsets))
        many = n >= FEW
        least.append(total[many] / n[many])
    least = np.concatenate([*least, np.zeros(0)])
    model.least = float(least.min()) if len(least) else -np.inf
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", with_spans: bool = False) -> DataFrame:
    """docs with lang_pred and score (0 to 1), and with_spans also spans (lang, first byte, byte after the last).

    A null text and one without a letter is `und` with score 0 and no spans; equal texts get equal results; columns of
    those names are replaced; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if not model.languages:
        nothing = docs.drop("lang_pred", "score").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
        return nothing.withColumn("spans", F.expr("cast(array() as array<struct<lang:string,start:int,end:int>>)")) if with_spans else nothing

    def make():
        known = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            names, confidence, spans = known.predict(batch.column(text), with_spans)
            out = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(confidence, pa.float64())}
            if with_spans:
                kind = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
                out["spans"] = pa.array(spans, pa.list_(kind))
            return out

        return run

    added = "lang_pred string, score double" + (", spans array<struct<lang:string,start:int,end:int>>" if with_spans else "")
    return B.extended(docs, added, make)


def accepted(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in a language the model knows, with the columns of docs. Documents go whose text is null or has no
    letter, most of whose letters are in scripts that no known language uses, or whose words are unlike those of every
    known language (evidence below that of any training text by more than the margin). A null lang (where there is such
    a column) becomes the predicted one. A model without languages judges by letters alone. Repeated rows are judged
    alike and stay; an empty table gives an empty one."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("judged"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            names, good = [], []
            for low, high, data, offsets in B.text_slices(batch.column("judged")):
                letters = [has_letter(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                if not known.languages:
                    names += [None] * (high - low)
                    good += letters
                    continue
                names += known.predict(batch.column("judged").slice(low, high - low), False)[0]
                total, n, foreign = known.evidence(read_slice(data, offsets))
                like = total >= n * (known.least - MARGIN) - MARGIN_FEW * np.sqrt(np.maximum(n, 1))
                good += (np.array(letters, bool) & (n >= foreign) & like).tolist()
            return {"pred": pa.array(names, pa.string()), "good": pa.array(good, pa.bool_())}

        return run

    judged = B.extended(packed, "pred string, good boolean", make, drop=("judged",)).filter("good")
    filled = F.coalesce(F.col(f"row.`{lang}`"), F.col("pred")) if lang in docs.columns else None
    return judged.select(*((filled if c == lang else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
