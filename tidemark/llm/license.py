"""Operator 7: licence scans with a trained paragraph classifier and template comparison.

Texts are parted into sentences, which may be wrapped over lines but end at blank lines; in a sentence of any length the
passages are the runs of words near 3-word shingles of licence templates.  A multinomial logistic regression over sparse word
1- and 2-grams of the templates gives a passage a licence family or `unknown`.  Templates are the wording of public
notices, and short forms ("Released under the ...") filled in with licence names.  It is trained on the driver from the
templates (whole, cut, and with words dropped, changed or foreign words around them) and, as unknown, from at most
`most_negatives` sentences of a bounded sample of the table (`sample_docs` documents of at most `sample_chars` characters,
chosen by a hash of id and text over all rows), from licence-like sentences, and from template words in random order.  A
temperature is fitted on held-out examples, and the unknown class is calibrated there: the probability that all families
together need is raised until at most `unknown_error` of the held-out unknown sentences would pass.

A prediction counts only if template comparison confirms it: the passage holds a name of the family, of two words or more; or at
least `LEAST_SHINGLES` of its shingles are the family's, and they are at least `confirm` of the passage's or of one
template's.  Families with equal wording are told apart by the classifier alone.  Passages of one family, or whose
wording two families share, that follow each other in a paragraph count once.  A text without a template shingle has no passage; every such shingle holds one of a few
marker words, and texts without a marker are passed over without changing a result.

Defined results: null or empty text has no licence; a document with several families reports the one with the highest
probability (ties to the name) and lists all; repeated rows and null ids get a row each; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, tidy

# The wording of public licence notices, by family.
NOTICES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSL": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    ],
    "CC": [
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
}
# Names of licences, as they stand in short notices.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "Apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "BSL": ["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"],
    "CC": ["Creative Commons license"] + [f"{c} {v}" for c in ("CC BY", "CC BY-SA", "CC BY-NC", "CC BY-ND", "CC BY-NC-SA", "CC BY-NC-ND") for v in ("3.0", "4.0")] + ["CC0 1.0"] + [f"Creative Commons {c} 4.0 International License" for c in ("Attribution", "Attribution-ShareAlike", "Attribution-NonCommercial", "Attribution-NoDerivatives", "Attribution-NonCommercial-ShareAlike")],
    "EPL": ["Eclipse Public License", "Eclipse Public License, version 2.0", "EPL-2.0"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0-or-later", "GPL-2.0-only"],
    "ISC": ["ISC License", "ISC"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-2.1-or-later"],
    "MIT": ["MIT License", "MIT licence", "MIT"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "zlib/libpng license", "Zlib"],
}
#: Short notices to be filled in with a name.
FORMS = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "Available under the {}.", "Published under the {}.", "This work is licensed under the {}.", "This software is licensed under a {}.", "This project is released under the {}.", "License: {}", "SPDX-License-Identifier: {}", "the {}"]
TEMPLATES = {family: [*texts, *(form.format(name) for form in FORMS for name in NAMES[family])] for family, texts in NOTICES.items()}
#: Sentences that share words with licences and are none.
LIKE = [
    "The driver must carry a license at all times and show it on request.",
    "All rights reserved by the publisher of this edition.",
    "The terms of the agreement were not made public by either party.",
    "He was granted permission to use the software for a year.",
    "The committee released the report under the condition of secrecy.",
    "Public notice is given that the work is subject to conditions.",
    "The foundation published a free version of the general handbook.",
    "A copy of the document may be obtained at the office.",
    "She wrote the software under a commercial contract without warranty.",
    "The version released last year was distributed in the hope of quick sales.",
]
STOP = frozenset("the of a and or in to is are be with for as at by this that it you may not on any an if".split())
TOKEN = re.compile(r"[^\W_]+")
UNKNOWN = "unknown"
SAMPLE_DOCS, SAMPLE_CHARS, MOST_NEGATIVES = 1500, 20_000, 4_000
CONFIRM, UNKNOWN_ERROR, LEAST_SHINGLES = 0.6, 0.001, 2
SHINGLE = 3
#: Words between shingles of one passage at most, and words that a passage takes on either side.
GAP, MARGIN = 8, 2
BLANK = re.compile(r"\n[^\S\n]*\n")
#: The end of a sentence: a mark before white space and a capital, a digit or a bracket; or a mark at the end of a line.
SENTENCE = re.compile(r"(?<=[.!?:;])[\"')\]]*(?:[^\S\n]+(?=[\"'(\[]?[A-Z])|[^\S\n]*\n)")


def tokens(paragraph: str) -> list[str]:
    return TOKEN.findall(paragraph.lower())


def sentences(paragraph: str) -> list[list[str]]:
    """Words of the sentences of a paragraph, whether or not they are wrapped over lines."""
    return [w for x in SENTENCE.split(paragraph) if (w := tokens(x))]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """3-word shingles with a word that is no stop word; the whole of a shorter paragraph."""
    found = {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()
    return {s for s in found if not STOP.issuperset(s)}


def passages(words: list[str], known: set[tuple[str, ...]]) -> list[list[str]]:
    """Runs of words near known shingles."""
    hits = [i for i in range(len(words) - SHINGLE + 1) if tuple(words[i : i + SHINGLE]) in known]
    if not hits and 0 < len(words) < SHINGLE and tuple(words) in known:
        hits = [0]
    out: list[list[int]] = []
    for i in hits:
        if out and i - out[-1][1] <= GAP:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [words[max(0, a - MARGIN) : b + SHINGLE + MARGIN] for a, b in out]


def template_shingles() -> dict[str, list[set[tuple[str, ...]]]]:
    return {family: [shingles(tokens(t)) for t in texts] for family, texts in TEMPLATES.items()}


def known_shingles(templates: dict[str, list[set[tuple[str, ...]]]]) -> set[tuple[str, ...]]:
    return set().union(*(s for ts in templates.values() for s in ts))


def markers(templates: dict[str, list[set[tuple[str, ...]]]]) -> frozenset[str]:
    """Words, none of them a stop word, of which every template shingle holds one."""
    left = known_shingles(templates)
    out = set()
    while left:
        n = Counter(w for s in left for w in set(s) if w not in STOP)
        word = max(n, key=lambda w: (n[w], w))
        out.add(word)
        left = {s for s in left if word not in s}
    return frozenset(out)


@dataclass
class LicenseModel:
    families: list[str]  # the last is UNKNOWN
    vocabulary: dict[tuple[str, ...], int]
    weights: np.ndarray
    temperature: float
    least: float

    def rows(self, paragraphs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _rows(paragraphs, self.vocabulary)

    def probabilities(self, paragraphs: list[list[str]]) -> np.ndarray:
        return _softmax(_scores(self.rows(paragraphs), self.weights, len(paragraphs)) / self.temperature)


def _grams(words: list[str]) -> Iterator[tuple[str, ...]]:
    yield from ((w,) for w in words)
    yield from zip(words, words[1:], strict=False)


def _rows(paragraphs: list[list[str]], vocabulary: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: row, column, value; column 0 is the bias, column 1 the share of n-grams outside the vocabulary."""
    r, c, v = [], [], []
    for i, words in enumerate(paragraphs):
        grams = Counter(vocabulary.get(g, 1) for g in _grams(words))
        total = sum(grams.values()) or 1
        r += [i] * (len(grams) + 1)
        c += [0, *grams]
        v += [1.0, *(n / total if k == 1 else min(n, 3) / total**0.5 for k, n in grams.items())]
    return np.array(r, np.int64), np.array(c, np.int64), np.array(v)


def _scores(rows, weights: np.ndarray, n: int) -> np.ndarray:
    r, c, v = rows
    return np.stack([np.bincount(r, weights[c, k] * v, n) for k in range(weights.shape[1])], 1)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(negatives: list[list[str]], *, rounds: int = 120, seed: int = 11, unknown_error: float = UNKNOWN_ERROR) -> LicenseModel:
    """Train on the templates and the given unknown paragraphs."""
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    noise = sorted({w for p in negatives for w in p}) or ["lorem", "ipsum", "dolor"]
    strange = lambda n: [noise[int(i)] for i in rng.integers(0, len(noise), n)]
    x: list[list[str]] = []
    y: list[int] = []
    every = [tokens(t) for texts in TEMPLATES.values() for t in texts]
    for k, family in enumerate(families[:-1]):
        for text in TEMPLATES[family]:
            words = tokens(text)
            for j in range(max(6, 2 * len(words) if len(words) > 15 else 0)):  # longer texts in more of their parts
                w = words
                if j % 3 and len(w) > 8:
                    n = int(rng.integers(7, len(w)))
                    at = int(rng.integers(0, len(w) - n + 1))
                    w = w[at : at + n]
                if j % 4 == 2 and len(w) > 5:
                    w = [t for t in w if rng.random() > 0.1] or w
                if j % 4 == 1 and len(w) > 8:
                    w = [strange(1)[0] if rng.random() < 0.1 else t for t in w]
                if j % 4 == 3:
                    extra = strange(int(rng.integers(1, 6)))
                    w = [*extra, *w] if rng.random() < 0.5 else [*w, *extra]
                x.append(w)
                y.append(k)
    pool = [w for words in every for w in words]
    mixed = [[pool[int(i)] for i in rng.integers(0, len(pool), int(rng.integers(4, 25)))] for _ in range(800)]
    unknown = [p for p in negatives if p] + [tokens(s) for s in LIKE for _ in range(8)] + mixed
    x += unknown
    y += [len(families) - 1] * len(unknown)
    vocabulary: dict[tuple[str, ...], int] = {}
    for texts in TEMPLATES.values():
        for text in texts:
            for g in _grams(tokens(text)):
                vocabulary.setdefault(g, len(vocabulary) + 2)
    order = rng.permutation(len(x))
    held, used = order[::5], np.delete(order, np.s_[::5])
    label = np.array(y)
    r, c, v = _rows([x[i] for i in used], vocabulary)
    held_in = np.zeros((len(used), len(vocabulary) + 2), np.float32)  # bounded: some thousand examples, some thousand n-grams
    held_in[r, c] = v
    target = np.eye(len(families), dtype=np.float32)[label[used]]
    weight = np.where(label[used] == len(families) - 1, 1.0, 2.0)[:, None].astype(np.float32)
    w = np.zeros((len(vocabulary) + 2, len(families)), np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for i in range(rounds):
        g = held_in.T @ (weight * (target - _softmax(held_in @ w))) - 0.01 * w
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w += 0.2 * (m / (1 - 0.9 ** (i + 1))) / (np.sqrt(s / (1 - 0.99 ** (i + 1))) + 1e-8)
    w = w.astype(np.float64)
    scores = _scores(_rows([x[i] for i in held], vocabulary), w, len(held))
    truth = label[held]
    loss = {t: -np.log(_softmax(scores / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 8, 31)}
    temperature = float(min(loss, key=lambda t: loss[t]))
    p = _softmax(scores / temperature)
    wrong = np.sort(1 - p[(truth == len(families) - 1) & (held < len(y) - len(mixed)), -1])
    least = max(0.5, float(wrong[max(0, int(np.ceil(len(wrong) * (1 - unknown_error))) - 1)])) if len(wrong) else 0.5
    return LicenseModel(families, vocabulary, w, temperature, min(least, 0.99))


def train(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, most_negatives: int = MOST_NEGATIVES) -> LicenseModel:
    """A model whose unknown class knows sentences of a bounded sample of docs (doc_id, text)."""
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    n = rows.count()
    h = F.pmod(F.xxhash64(F.lit("license"), F.col("doc_id"), F.col("text")), F.lit(1 << 30))
    drawn = rows.select(h.alias("h"), "text").where(F.col("h") < int(min(1.0, 1.2 * (sample_docs + 50) / max(n, 1)) * (1 << 30)))
    picked = drawn.groupBy("h").agg(F.min("text").alias("text")).collect()  # about 1.2 * (sample_docs + 50) rows
    known = known_shingles(template_shingles())
    found = [w for r in sorted(picked, key=lambda r: r["h"])[:sample_docs] for part in BLANK.split(r["text"]) for w in sentences(part)]
    found = [p for p in found if known.isdisjoint(shingles(p))]
    at = np.linspace(0, len(found) - 1, min(len(found), most_negatives)).astype(int)
    return fit([found[i] for i in at])


class Scanner:
    def __init__(self, model: LicenseModel, confirm: float = CONFIRM) -> None:
        self.model, self.least = model, confirm
        self.templates = template_shingles()
        self.any = {family: set().union(*ts) for family, ts in self.templates.items()}
        self.known = known_shingles(self.templates)
        self.names = {family: [f" {' '.join(n)} " for name in names if len(n := tokens(name)) > 1] for family, names in NAMES.items()}
        self.markers = markers(self.templates)

    def confirmed(self, words: list[str], family: str) -> bool:
        text = f" {' '.join(words)} "
        if any(name in text for name in self.names[family]):
            return True
        own = shingles(words)
        same = len(own & self.any[family])
        if same < min(LEAST_SHINGLES, len(own)) or not own:
            return False
        if same >= self.least * len(own):
            return True
        return any(len(own & t) >= max(self.least * len(t), LEAST_SHINGLES) for t in self.templates[family])

    def scan(self, text: str | None) -> list[tuple[str, float]]:
        """(family, probability) of what is confirmed licence text; passages of one family in a row are one."""
        if not text or self.markers.isdisjoint(tokens(text)):
            return []
        out: list[tuple[str, float]] = []
        for paragraph in BLANK.split(text):
            found = [p for words in sentences(paragraph) for p in passages(words, self.known)]
            if not found:
                continue
            last, before = "", []
            for words, row in zip(found, self.model.probabilities(found), strict=True):
                k = int(row[:-1].argmax())
                family = self.model.families[k]
                if 1 - row[-1] < self.model.least or not self.confirmed(words, family):
                    continue
                here = (family, float(row[k]))
                # wording that families share goes with its neighbour
                shared = last and (family == last or self.confirmed(words, last) or self.confirmed(before, family))
                if shared:
                    out[-1] = max(out[-1], here, key=lambda e: e[1])
                else:
                    out.append(here)
                last, before = out[-1][0], words
        return out


def scan(docs: DataFrame, model: LicenseModel | None = None, *, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, family, probability, families, n_paragraphs) of every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # bounded by the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held.value, confirm)
        for batch in in_parts(tidy(batches), 1000, "text", 8_000_000):
            rows = []
            for text in batch.column(1).to_pylist():
                found = scanner.scan(text)
                best = min(found, key=lambda x: (-x[1], x[0]), default=(None, 0.0))
                rows.append((*best, ",".join(sorted({f for f, _ in found})), len(found)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.string(), pa.float64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "family", "probability", "families", "n_paragraphs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, family string, probability double, families string, n_paragraphs long")
