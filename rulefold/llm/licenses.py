"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by template comparison.

Paragraphs are lines. Features are the words of a line and its pairs of words in a row, its beginning and end counting
as words (so a bare "MIT" differs from the word in a sentence). A multinomial logistic regression with an L1 penalty (so
that few features keep a weight) is trained on the driver: on notices made from the families' names and on their
standard sentences, whole and with words left out, and on a bounded sample of the corpus' own lines as class `unknown`.
Its probabilities are calibrated by a temperature fitted on held-out notices and lines. A line is judged if a family is
likelier than unknown, and is given that family if the calibrated probability is at least `least` and it agrees with one
of the family's names or sentences. A name agrees if the line states it (see stated()): a name that speaks of a licence
stands there in any case; an acronym stands there as it is written, with a version, as the whole line, or next to a
word that speaks of a licence, so "MIT in Boston" or the German "mit" are none. A sentence agrees by the share of its
pairs of words in a line of six or more, so a line of a wrapped text agrees as well.

Features need a word that says something (COMMON lists those that do not).

Scanning is DataFrame functions alone. Words pick lines first, the rarest of each picked feature: a feature
may be left out of those only while all left out together cannot lift any family above unknown, so no line is lost that
the classifier would judge. The n-grams of the lines join the broadcast weights, whose size is bounded by the templates.
"""

from __future__ import annotations

import itertools
import random
import re
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 3_000
SAMPLE_BYTES = 20_000_000
LEAST = 0.6
AGREE = 0.5
UNKNOWN = "unknown"
NONE = "none"
#: Names of public licences by family.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL v3", "AGPL-3.0-or-later", "AGPL 3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "CC BY"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-NC"],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC BY-ND"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA"],
    "cc0": ["CC0 1.0 Universal", "CC0-1.0", "CC0 1.0", "CC0", "Creative Commons Zero"],
    "artistic": ["Artistic License 2.0", "Artistic-2.0", "Artistic License"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "BSL-1.0", "Boost Software License"],
    "busl-1.1": ["Business Source License 1.1", "BUSL-1.1", "Business Source License"],
    "eupl": ["European Union Public Licence", "EUPL-1.2", "EUPL v1.2"],
    "gfdl": ["GNU Free Documentation License, version 1.3", "GNU Free Documentation License", "GFDL-1.3-or-later", "GFDL 1.3"],
    "psf-2.0": ["Python Software Foundation License", "PSF-2.0", "PSF License Agreement"],
    "sspl": ["Server Side Public License, version 1", "SSPL-1.0", "SSPL v1"],
    "wtfpl": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "zlib": ["zlib License", "zlib/libpng License"],
    "epl": ["Eclipse Public License 2.0", "EPL-2.0", "Eclipse Public License"],
    "gpl": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0-or-later", "GPL-2.0-only", "GPL v2", "GPLv3", "GPL", "GNU GPL version 2"],
    "isc": ["ISC License", "ISC"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1-or-later", "LGPL v3", "LGPL"],
    "mit": ["MIT License", "MIT-Lizenz", "licence MIT", "licencia MIT", "MIT"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"],
    "unlicense": ["Unlicense", "The Unlicense"],
}
#: Sentences that stand for a family without its name.
SENTENCES = {
    "apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ],
    "bsl-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "cc0": ["The author has dedicated this work to the public domain by waiving all rights under copyright law.", "dedicated to the public domain"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "proprietary": ["All rights reserved.", "No part may be reproduced without written permission.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados."],
}
#: What stands before and after a name in notices.
LEADS = [
    "", "Licensed under", "Licensed under the", "Released under the", "Distributed under the terms of the", "This work is licensed under a", "License:", "SPDX-License-Identifier:",
    "Available under the", "Lizenziert unter der", "Veröffentlicht unter der", "Publié sous la", "Sous licence", "Publicado bajo la", "Licencia:",
]
TAILS = ["", "or later", "see the file LICENSE for details", "copyright the authors"]


#: Words that say nothing of a licence by themselves; a feature needs another one.
COMMON = set(
    "a all an and any are as at be by can copy do for form free from has in into is it made may no not of on or other out part that the this to under use version was with without you "
    "alle aus das der die ein eine im in ist nicht und unter von zu au bajo ce con de del des du el en est et la las le les los par por pour que se sous sur un una une y".split()
)


#: A name with one of these speaks of a licence by itself.
SPEAKING = {"license", "licence", "licencia", "public", "commons", "unlicense"}
#: What makes a notice of an acronym behind it: in any case, and only of one as it is written; what may
#: stand between the two.
CUES = "licen[cs]ed?|licencia|spdx license identifier"
WEAK_CUES = "lizenz|lizenziert|released|available|distributed|published|shared|terms|publi|publicado|ffentlicht"
LINKS = "under|the|a|an|terms|of|is|as|sous|bajo|la|el|de|unter|der|einer|are"
#: Pairs of words below which a sentence has to stand in a line as a whole.
WHOLE = 6


def cased(text: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", text) if w]


def words(text: str) -> list[str]:
    """Words of ASCII letters and digits, in lower case."""
    return [w.lower() for w in cased(text)]


def stated(name: str) -> str:
    """A pattern (for Java and Python) of lines that state a name, over their cased() words joined by blanks."""
    w = cased(name)
    kept, free = " ".join(w), f"(?i:{' '.join(w)})"
    if SPEAKING & set(words(name)):
        return rf"\b{free}\b"
    if len(w) > 2 or len(w[0]) > 4 or any(c.isdigit() for c in kept) or "Lizenz" in w:
        forms = [rf"\b{kept}\b"]
    else:
        forms = [rf"^{kept}(?: (?i:or later|see|copyright)\b.*)?$", rf"\b{kept} (?i:lizenz)\b", rf"\b(?i:{WEAK_CUES})(?: (?i:{LINKS}))* {kept}\b"]
    return "|".join([*forms, rf"\b(?i:{CUES})(?: (?i:{LINKS}))* {free}\b", rf"\b{free} (?i:licen[cs]es?)\b"])


def grams(text: str) -> set[str]:
    w = words(text)
    return set(w) | {f"{a} {b}" for a, b in itertools.pairwise(["^", *w, "$"])} if w else set()


def telling(feature: str) -> list[str]:
    """The words of a feature that are neither common nor numbers or single letters."""
    return [w for w in feature.split(" ") if len(w) > 1 and w not in COMMON and not w.isdigit()]


def known_pairs(text: str) -> set[str]:
    return {f"{a} {b}" for a, b in itertools.pairwise(words(text))}


def patterns() -> dict[str, str]:
    """By family: lines that state one of its names, or a sentence of fewer than WHOLE pairs."""
    short = {k: [rf"\b(?i:{' '.join(cased(t))})\b" for t in texts if len(known_pairs(t)) < WHOLE] for k, texts in SENTENCES.items()}
    made = {k: [*map(stated, NAMES.get(k, [])), *short.get(k, [])] for k in templates()}
    return {k: "|".join(v) for k, v in made.items() if v}


def sentences() -> list[tuple[str, set[str]]]:
    """Pairs of words of the longer sentences, by family."""
    return [(k, p) for k, texts in sorted(SENTENCES.items()) for t in texts if len(p := known_pairs(t)) >= WHOLE]


def templates() -> dict[str, list[str]]:
    return {k: NAMES.get(k, []) + SENTENCES.get(k, []) for k in sorted(NAMES | SENTENCES)}


def variants(family: str, rng: random.Random) -> list[str]:
    """Notices of a family: its names with what stands around them, and all with words left out (never a name's)."""
    out = [f"{a} {name} {b}" for name in NAMES.get(family, []) for a, b in itertools.product(LEADS, TAILS)]
    for sentence in SENTENCES.get(family, []):
        w = words(sentence)
        out += [sentence] * 4 + [f"{sentence} {tail}" for tail in TAILS]
        out += [" ".join(x for x in w if rng.random() > 0.12) for _ in range(2 * len(w) if len(w) > 5 else 0)]
        out += [" ".join(w[i : i + rng.randint(9, 14)]) for i in range(0, len(w) - 8, 2)]  # lines of a wrapped text
    return out


@dataclass
class Model:
    families: list[str]  # the last is UNKNOWN
    features: list[str]
    weights: np.ndarray  # feature x family, calibrated
    bias: np.ndarray
    common: Counter = field(default_factory=Counter)  # features in the sample of the corpus

    def probabilities(self, texts: list[str]) -> np.ndarray:
        index = {g: i for i, g in enumerate(self.features)}
        x = np.zeros((len(texts), len(self.features)))
        for row, text in enumerate(texts):
            x[row, [index[g] for g in grams(text) if g in index]] = 1
        return _softmax(x @ self.weights + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(negatives: list[str], penalty: float = 2e-4, rounds: int = 250) -> Model:
    """Fit and calibrate; negatives are lines without a licence (those that hold a whole name of two words or more, or a
    sentence, or are a name, are left out)."""
    rng = random.Random(7)
    by_family = templates()
    families = [*by_family, UNKNOWN]
    known = [words(t) for texts in by_family.values() for t in texts]
    whole = re.compile("|".join(rf"\b{' '.join(k)}\b" for k in known if len(k) > 1))
    single = {k[0] for k in known if len(k) == 1}
    plain = [" ".join(words(n)) for n in negatives]
    plain = [n for n in plain if not whole.search(n) and n not in single]
    stray = sorted({w for k in known for w in k} | {w for t in LEADS + TAILS for w in words(t)})
    mixed = [" ".join(rng.choices(stray, k=rng.randint(2, 7))) for _ in range(200)]  # stray licence words prove nothing
    mixed = [m for m in mixed if not whole.search(m)]
    framed = [f"{a} {rng.choice(plain or ['it'])}" for a in LEADS if a] + [" ".join(words(a)) for a in LEADS]
    pairs = [(v, i) for i, family in enumerate(by_family) for v in variants(family, rng)]
    pairs += [(n, len(by_family)) for n in [*plain, *mixed, *framed, ""]]
    of_lead = {g for t in LEADS + TAILS for g in grams(t)}
    features = sorted(g for g in {g for texts in by_family.values() for t in texts for g in grams(t)} | of_lead if telling(g))
    index = {g: i for i, g in enumerate(features)}
    x = np.zeros((len(pairs), len(features)))
    for row, (text, _) in enumerate(pairs):
        x[row, [index[g] for g in grams(text) if g in index]] = 1
    labels = np.array([label for _, label in pairs])
    each = 1 / np.bincount(labels, minlength=len(families))[labels] / len(families)  # classes weigh alike
    held = np.arange(len(pairs)) % 4 == 3
    # equal rows count once, with their weights added up
    rows, place = np.unique(np.column_stack([x, labels, held]).astype(np.int16), axis=0, return_inverse=True)
    cost = np.bincount(place.ravel(), each)
    x, y, held = rows[:, :-2].astype(np.float32), np.eye(len(families))[rows[:, -2]], rows[:, -1] == 1
    seen, target, weight = x[~held], y[~held], cost[~held, None]
    w, b, step = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32), 4.0
    momentum, previous = w.copy(), w.copy()
    for k in range(rounds):
        error = (_softmax(seen @ momentum + b) - target) * weight
        moved = momentum - step * (seen.T @ error)
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        b -= step * error.sum(axis=0)
        momentum, previous = w + k / (k + 3) * (w - previous), w

    def loss(temperature: float) -> float:
        p = _softmax((x[held] @ w + b) / temperature)
        return -(cost[held] * np.log((p * y[held]).sum(axis=1) + 1e-12)).sum()

    temperature = min((0.25 * 1.15**i for i in range(20)), key=loss)
    b[-1] = max(b[-1], b[:-1].max() + 0.1)  # a line without features is unknown
    common = Counter(g for n in plain for g in grams(n) if g in index)
    return Model(families, features, w / temperature, b / temperature, common)


def picking(model: Model) -> list[str]:
    """Features of which a line must have one for a family to be likelier than unknown.

    The commonest features of the corpus are left out first, as long as for every family what all those left out add
    does not reach what it lacks."""
    gain = np.maximum(model.weights[:, :-1] - model.weights[:, -1:], 0)
    lacks = model.bias[-1] - model.bias[:-1]
    out, kept = np.zeros(gain.shape[1]), []
    for i in sorted(range(len(gain)), key=lambda i: (-model.common[model.features[i]], gain[i].max(), i)):
        if (out + gain[i] < lacks - 1e-6).all():
            out += gain[i]
        else:
            kept.append(model.features[i])
    return kept


def picking_words(model: Model) -> list[str]:
    """Words of which a line must have one to have a feature of picking(): of each the rarest in the corpus' sample."""
    return sorted({min(telling(f), key=lambda w: (model.common[w], -len(w), w)) for f in picking(model)})


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Train with about `sample` lines of the corpus, or SAMPLE_BYTES of them, as class unknown: one line of each row
    drawn by a hash of key and text."""
    rows = docs.filter(F.col(f"`{text}`").isNotNull()).select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("draw"), F.col(f"`{text}`").alias("text"))
    lines = F.split("text", "\n")
    line = F.get(lines, F.pmod(F.xxhash64("draw"), F.size(lines)).cast("int"))
    rows = rows.select(F.pmod("draw", F.lit(1_000_003)).alias("draw"), "text")
    n, volume = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rate = min(1.0, sample / max(n, 1), SAMPLE_BYTES / max(volume or 0, 1))
    drawn = rows.filter(F.col("draw") < 1_000_003 * rate).select("draw", line.alias("line"))
    return train([r["line"] for r in drawn.orderBy("draw", "line").limit(2 * sample).collect()])


def _tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """Weights by feature; what names and sentences are compared by."""
    rows = [(f, [float(v) for v in w]) for f, w in zip(model.features, model.weights, strict=True) if any(w)]
    known = [(k, p, [], 0) for k, p in patterns().items()] + [(k, None, sorted(p), len(p)) for k, p in sentences()]
    weights = spark.createDataFrame(rows, "gram string, weight array<double>")
    return weights, spark.createDataFrame(known, "family string, pattern string, known array<string>, size int")


def scan(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least: float = LEAST, agree: float = AGREE) -> DataFrame:
    """One row a document: doc_id, family (of its likeliest confirmed line; `unknown`: a family is likelier than unknown
    for some line, but none is confirmed; `none`: for no line), families (all confirmed, sorted), n_paragraphs
    (confirmed ones), paragraph (line number of the likeliest, from 0), probability and agreement of that one.

    A null or empty text is `none`; rows of the same key and text are judged once and stay repeated; other columns
    are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    weights, known = _tables(spark, model)
    pick = F.split(F.lit(" ".join(picking_words(model))), " ")
    base = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # ids and texts are told apart by a hash of the text, so equal keys with other texts stay apart
    base = base.withColumn("hash", F.xxhash64("text"))
    lines = base.select("doc_id", "hash", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    ascii_lower = F.translate("line", string.ascii_uppercase, string.ascii_lowercase)
    lines = lines.filter(F.arrays_overlap(F.split(ascii_lower, "[^a-z0-9]+"), pick)).dropDuplicates(["doc_id", "hash", "paragraph"])
    said = F.trim(F.regexp_replace("line", "[^A-Za-z0-9]+", " "))
    cut = lines.select("doc_id", "hash", "paragraph", said.alias("said"), F.array_remove(F.split(ascii_lower, "[^a-z0-9]+"), "").alias("w"))
    pairs = F.zip_with(F.concat(F.array(F.lit("^")), "w"), F.concat("w", F.array(F.lit("$"))), lambda x, y: F.concat_ws(" ", x, y))
    cut = cut.withColumn("grams", F.array_distinct(F.concat("w", pairs))).withColumn("n", F.greatest(F.size("w") - 1, F.lit(1)))
    at = ["doc_id", "hash", "paragraph"]
    hits = cut.select(*at, "grams", "n", "said", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram")
    n = len(model.families)
    sums = [F.sum(F.get("weight", F.lit(i))) + float(model.bias[i]) for i in range(n)]
    scored = hits.groupBy(*at).agg(F.array(*sums).alias("z"), F.first("grams").alias("grams"), F.first("n").alias("n"), F.first("said").alias("said"))
    scored = scored.filter(F.array_max(F.slice("z", 1, n - 1)) > F.get("z", F.lit(n - 1)))
    top = F.array_max("z")
    mass = F.aggregate("z", F.lit(0.0), lambda total, z: total + F.exp(z - top))
    names = F.split(F.lit(",".join(model.families)), ",")
    judged = scored.select(*at, "grams", "n", "said", (F.lit(1.0) / mass).alias("probability"), F.element_at(names, F.array_position("z", top).cast("int")).alias("family"))
    share = F.size(F.array_intersect("grams", "known")) / F.least(F.greatest("n", F.lit(WHOLE)), "size")
    share = F.when(F.col("pattern").isNotNull(), F.expr("said rlike pattern").cast("double")).otherwise(share)
    compared = judged.join(F.broadcast(known), "family", "left").groupBy(*at, "family", "probability").agg(F.coalesce(F.max(share), F.lit(0.0)).alias("agreement"))
    good = (F.col("family") != UNKNOWN) & (F.col("probability") >= least) & (F.col("agreement") >= agree)
    marked = compared.withColumn("good", good)
    best = F.max_by(F.struct("family", "paragraph", "probability", "agreement"), F.struct("good", "probability", -F.col("paragraph")))
    found = marked.groupBy("doc_id", "hash").agg(
        F.max("good").alias("good"), best.alias("best"), F.sum(F.col("good").cast("bigint")).alias("n_paragraphs"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("good"), F.col("family")))), ",").alias("families"),
    )
    ids = base.select(F.col("doc_id").alias("id"), F.col("hash").alias("own"))
    rows = ids.join(found, ids["id"].eqNullSafe(found["doc_id"]) & (ids["own"] == found["hash"]), "left")
    sure = F.coalesce("good", F.lit(False))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.when(sure, F.col("best.family")).when(F.col("good").isNotNull(), UNKNOWN).otherwise(NONE).alias("family"),
        F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.when(sure, F.col("best.paragraph")).alias("paragraph"), F.when(sure, F.col("best.probability")).alias("probability"),
        F.when(sure, F.col("best.agreement")).alias("agreement"),
    )
