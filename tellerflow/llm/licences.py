"""Licence notices in text: a trained paragraph classifier whose predictions a template must confirm.

Words in small letters form n-grams of two and three words. A multinomial logistic regression over
the n-grams of the templates tells the licence families and an unknown class apart; it is trained on
distorted copies of the templates and on paragraphs of the corpus itself; a scale and the limit below which
a prediction counts as unknown are fitted on examples kept back: the scale makes probabilities
honest there, the limit keeps the share of wrong verdicts low. A paragraph may hold several notices:
the places of whole templates and the lines around them are classified one by one.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, texts

UNKNOWN = "unknown"
#: Paragraphs of the corpus that train the unknown class, at most, from so many documents.
NEGATIVES, NEGATIVE_DOCS = 1_500, 1_000
EXAMPLE_CHARS = 400
#: Distorted copies made of each template.
VARIANTS = 24
#: Words of a shingle and the share of shared shingles that confirm a prediction.
SHINGLE, SIMILARITY = 5, 0.8
#: Share of the verdicts above the limit that may be wrong, on examples kept back and counting one more wrong one.
FALSE_SHARE = 0.02
#: Probability bands of the reported calibration curve.
BANDS = 10

WORD = re.compile(r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*")
FOUND = "array<struct<start:int,end:int,family:string,probability:double,similarity:double,confirmed:boolean>>"
FOUND_TYPE = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()),
    ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

#: Notices as the licences' publishers recommend them, passages of their texts that no other family shares, and usual
#: short forms of a shingle's words at least. Fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is licensed under the Apache License 2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly "
        "display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License v3.0",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
        "the License, or (at your option) any later version.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
        "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "This project is licensed under the BSD 2-Clause \"Simplified\" License",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "This project is licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "Zlib": (
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ),
    "Unlicense": (
        "This project is released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> set[tuple[str, ...]]:
    return {*zip(words, words[1:]), *zip(words, words[1:], words[2:])}


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


@cache
def template_shingles(template: str, size: int = SHINGLE) -> frozenset[tuple[str, ...]]:
    return frozenset(shingles(words_of(template), size))


def similarity(words: list[str], family: str) -> float:
    """How much of a template's shingles the words hold, or of the words' own a template: the best of the family's."""
    own, best = shingles(words), 0.0
    for template in TEMPLATES[family]:
        theirs = template_shingles(template, min(SHINGLE, max(1, len(words))))
        mine = own if len(words) >= SHINGLE else shingles(words, len(words))
        shared = len(mine & theirs)
        best = max(best, shared / len(theirs) if theirs else 0, shared / len(mine) if mine and len(words) >= SHINGLE else 0)
    return best


@dataclass
class Model:
    classes: list[str]
    place: dict[tuple[str, ...], int]
    weights: np.ndarray  # a row per n-gram, the constant last
    limit: float
    scale: float = 1.0
    curve: tuple[tuple[float, float, int], ...] = ()  # mean probability, share right, examples, of each band of kept-back ones

    def probabilities(self, words: list[str]) -> np.ndarray:
        rows = [k for g in grams(words) if (k := self.place.get(g)) is not None]
        score = self.weights[-1] + self.weights[rows].sum(axis=0) / max(1, len(rows)) ** 0.5
        raised = np.exp((score - score.max()) * self.scale)
        return raised / raised.sum()

    def read(self, words: list[str]) -> tuple[str, float, float, bool]:
        """Family (or unknown), its probability, its best template's similarity, and whether that confirms it."""
        chance = self.probabilities(words)
        best = int(chance[:-1].argmax())
        like = similarity(words, self.classes[best])
        known = bool(chance[best] >= self.limit)
        return self.classes[best] if known else UNKNOWN, float(chance[best]), like, known and like >= SIMILARITY


def _distort(words: list[str], rng: random.Random, noise: list[str]) -> list[str]:
    """A copy with some words lost, changed or cut off, and others around it."""
    kind = rng.random()
    if kind < 0.3 and len(words) > 12:
        start = rng.randrange(len(words) - 8)
        words = words[start:start + rng.randrange(8, len(words) - start + 1)]
    out = [w if rng.random() > 0.06 else rng.choice(noise) for w in words if rng.random() > 0.05]
    before = [rng.choice(noise) for _ in range(rng.randrange(6))]
    after = [rng.choice(noise) for _ in range(rng.randrange(6))]
    return before + out + after


def fit(negatives: list[list[str]], seed: int = 11, rounds: int = 300) -> Model:
    """The model from the templates and from paragraphs of the corpus (the unknown class)."""
    rng = random.Random(seed)
    noise = sorted({w for p in negatives[:200] for w in p}) or ["text"]
    classes = [*TEMPLATES, UNKNOWN]
    examples: list[tuple[list[str], int]] = []
    for k, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = words_of(template)
            examples += [(words, k)] + [(_distort(words, rng, noise), k) for _ in range(VARIANTS)]
    # shuffled and half replaced, licence words say nothing
    everything = [w for t in TEMPLATES.values() for x in t for w in words_of(x)]
    mixed = [[rng.choice(everything if rng.random() < 0.5 else noise) for _ in range(rng.randrange(4, 30))] for _ in range(len(examples) // 4)]
    examples += [(p, len(classes) - 1) for p in [*negatives, *mixed]]
    place: dict[tuple[str, ...], int] = {}
    for family in TEMPLATES.values():
        for template in family:
            for gram in sorted(grams(words_of(template))):
                place.setdefault(gram, len(place))
    rng.shuffle(examples)
    held = len(examples) // 5
    known = [[place[g] for g in grams(words) if g in place] for words, _ in examples]
    matrix = np.zeros((len(examples), len(place) + 1), np.float32)
    for row, cells in enumerate(known):
        matrix[row, cells] = 1 / max(1, len(cells)) ** 0.5
    matrix[:, -1] = 1
    target = np.eye(len(classes), dtype=np.float32)[[k for _, k in examples]]
    train, rest = matrix[held:], matrix[:held]
    weights, speed = np.zeros((matrix.shape[1], len(classes)), np.float32), np.zeros((matrix.shape[1], len(classes)), np.float32)
    for _ in range(rounds):
        score = train @ weights
        chance = np.exp(score - score.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + train.T @ (chance - target[held:]) / len(train) + 1e-5 * weights
        weights -= 4.0 * speed
    own = np.array([k for _, k in examples[:held]], int)
    scale, limit, curve = calibrate((rest @ weights).astype(float), own)
    return Model(classes, place, weights, limit, scale, curve)


def calibrate(scores: np.ndarray, own: np.ndarray) -> tuple[float, float, tuple[tuple[float, float, int], ...]]:
    """Scale, limit and calibration curve from scores by class (unknown the last) and true classes of kept-back examples.

    The scale is the one under which the true classes are likeliest. The limit is the smallest probability
    of a family, at least a half, from which on all verdicts together hold their share of wrong ones.
    Without examples the scale is one and the limit a half; where no limit holds, nothing is accepted.
    """
    if not len(own):
        return 1.0, 0.5, ()

    def chances(scale: float) -> np.ndarray:
        raised = np.exp((scores - scores.max(axis=1, keepdims=True)) * scale)
        return raised / raised.sum(axis=1, keepdims=True)

    # the likelihood is concave in the scale: its slope is the true score less the expected one
    true, low, high = scores[np.arange(len(own)), own], 0.05, 20.0
    for _ in range(40):
        scale = (low * high) ** 0.5
        low, high = (scale, high) if (true - (chances(scale) * scores).sum(axis=1)).sum() > 0 else (low, scale)
    families = chances(scale)[:, :-1]
    best = families.argmax(axis=1)
    top, right = families.max(axis=1), best == own
    down = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[down])
    good = ((wrong + 1) / (np.arange(len(own)) + 2) <= FALSE_SHARE) & (np.append(top[down][1:], -1) < top[down])
    limit = max(0.5, float(top[down][np.flatnonzero(good)[-1]])) if good.any() else float(np.nextafter(1.0, 2.0))
    band = np.minimum((top * BANDS).astype(int), BANDS - 1)
    curve = tuple((float(top[band == k].mean()), float(right[band == k].mean()), int((band == k).sum())) for k in range(BANDS) if (band == k).any())
    return scale, limit, curve


def paragraphs(text: str, place: dict[tuple[str, ...], int]) -> Iterator[tuple[int, int, list[str]]]:
    """Lines that hold a known n-gram, neighbouring ones joined: start, end and words of each."""
    at, held = 0, None
    for line in text.split("\n"):
        end = at + len(line)
        words = words_of(line)
        if any(pair in place for pair in zip(words, words[1:])):
            held = (held[0], end, held[2] + words) if held else (at, end, words)
        elif held:
            yield held
            held = None
        at = end + 1
    if held:
        yield held


def _template_shingles() -> dict[tuple[str, ...], list[int]]:
    """The templates that hold each shingle."""
    found: dict[tuple[str, ...], list[int]] = {}
    for k, own in enumerate(WHOLE):
        for shingle in own:
            found.setdefault(shingle, []).append(k)
    return found


WHOLE = [shingles(words_of(x)) for t in TEMPLATES.values() for x in t]
HOLDERS = _template_shingles()
#: Words between two notices of a family that still count as one, at most: the longest template.
LONGEST = max(len(words_of(x)) for t in TEMPLATES.values() for x in t)


def _occurrences(hits: list[tuple[int, tuple[str, ...]]], size: int) -> Iterator[tuple[int, int]]:
    """Word ranges that hold the share of a template's ``size`` shingles that confirms, from places of its shingles."""
    held: list[tuple[int, tuple[str, ...]]] = []
    for place, shingle in hits:
        seen = next((k for k, (_, x) in enumerate(held) if x == shingle), -1)
        if len(held) / size >= SIMILARITY and (seen >= 0 or place - held[-1][0] > SHINGLE):
            yield held[0][0], held[-1][0] + SHINGLE
            held, seen = [], -1
        held = held[seen + 1:] + [(place, shingle)]
        while place - held[0][0] > 2 * (size + SHINGLE) or (
                len(held) > 1 and (len(held) - 1) / size >= SIMILARITY and held[1][0] - held[0][0] > SHINGLE):
            held = held[1:]
    if len(held) / size >= SIMILARITY:
        yield held[0][0], held[-1][0] + SHINGLE


def _places(words: list[str]) -> tuple[list[tuple[int, int]], list[int]]:
    """Word ranges of whole templates, those that share half of the shorter one as one, and where any shingle begins."""
    by: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
    hits = []
    for k, shingle in enumerate(zip(*[words[j:] for j in range(SHINGLE)])):
        if (holders := HOLDERS.get(shingle)) is not None:
            hits.append(k)
            for template in holders:
                by.setdefault(template, []).append((k, shingle))
    places: list[tuple[int, int]] = []
    for start, end in sorted(x for t, own in by.items() for x in _occurrences(own, len(WHOLE[t]))):
        if places and 2 * (min(end, places[-1][1]) - start) >= min(end - start, places[-1][1] - places[-1][0]):
            places[-1] = places[-1][0], max(end, places[-1][1])
        else:
            places.append((start, end))
    return places, hits


def _own_share(words: list[str], family: str) -> float:
    """The share of the words' shingles that one template of the family holds."""
    own = shingles(words)
    return max(len(own & template_shingles(t)) / len(own) for t in TEMPLATES[family]) if len(words) >= SHINGLE else 0.0


def _line_ranges(text: str, start: int, end: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Each line's word range and offsets, and each word's offsets."""
    lines, words, at = [], [], start
    for line in text[start:end].split("\n"):
        low = line.lower()
        # small letters may be longer
        back = range(len(line) + 1) if len(low) == len(line) else [k for k, c in enumerate(line) for _ in c.lower()] + [len(line)]
        first = len(words)
        words += [(at + back[m.start()], at + back[m.end() - 1] + 1) for m in WORD.finditer(low)]
        lines.append((first, len(words), at, at + len(line)))
        at += len(line) + 1
    return lines, words


def notices(text: str, model: Model) -> Iterator[tuple[int, int, str, float, float, bool]]:
    """Start, end and verdict of every licence-like piece of a text, in order.

    A paragraph with one notice is one piece, without the lines around it that only chained. Otherwise whole templates wherever they lie and what
    remains of each line are read one by one; neighbours are joined where they continue one template
    or have the same family. A part of a template counts where it makes up its line.
    """
    for start, end, words in paragraphs(text, model.place):
        places, hits = _places(words)
        whole = model.read(words)
        if hits and not (whole[3] and _own_share(words, whole[0]) >= SIMILARITY):
            kept = _pieces(text, start, end, words, places, hits, model)
            sure = [x for x in kept if x[5]]
            if len(sure) > 1 or (sure and not (whole[3] and sure[0][2] == whole[0])):
                yield from kept
                continue
        if whole[0] != UNKNOWN or whole[2] >= SIMILARITY:
            yield _without_prose(text, start, end, words, hits, whole, model)


def _without_prose(text: str, start: int, end: int, words: list[str], hits: list[int], whole: tuple[str, float, float, bool],
                   model: Model) -> tuple[int, int, str, float, float, bool]:
    """A paragraph's verdict without the lines before the first and after the last shingle of a template, if that reads no worse."""
    if hits:
        lines, _ = _line_ranges(text, start, end)
        inner = [x for x in lines if x[1] > hits[0] and x[0] < hits[-1] + SHINGLE]
        if len(inner) < len(lines):
            own = model.read(words[inner[0][0]:inner[-1][1]])
            if own[0] == whole[0] and own[3] >= whole[3]:
                return inner[0][2], inner[-1][3], *own
    return start, end, *whole


def _pieces(text: str, start: int, end: int, words: list[str], places: list[tuple[int, int]], hits: list[int],
            model: Model) -> list[tuple[int, int, str, float, float, bool]]:
    lines, offsets = _line_ranges(text, start, end)
    ranges = list(places)
    free, at = [], 0
    for low, high in [*places, (len(words), len(words))]:
        if low > at:
            free.append((at, low))
        at = max(at, high)
    marks, line = iter(free), 0
    for low, high in marks:
        while lines[line][1] <= low:
            line += 1
        k = line
        while k < len(lines) and lines[k][0] < high:
            ranges.append((max(low, lines[k][0]), min(high, lines[k][1])))
            k += 1
    known = np.array(hits)
    found: list[tuple[int, int, tuple[str, float, float, bool]]] = []
    for low, high in sorted(ranges):
        # what holds no shingle cannot be confirmed
        if np.searchsorted(known, low) == np.searchsorted(known, high - SHINGLE, side="right"):
            continue
        verdict = model.read(words[low:high])
        if found:
            before, close, last = found[-1]
            near = low <= close and high - before <= 2 * LONGEST
            both = model.read(words[before:high]) if near else verdict
            if near and both[3] and _own_share(words[before:high], both[0]) >= SIMILARITY:
                found[-1] = before, max(close, high), both
                continue
            if verdict[0] == last[0] != UNKNOWN and low - close <= LONGEST:
                found[-1] = before, max(close, high), (last[0], max(last[1], verdict[1]), max(last[2], verdict[2]), last[3] or verdict[3])
                continue
        found.append((low, high, verdict))
    firsts, lasts = {x[0]: x[2] for x in lines if x[0] < x[1]}, {x[1]: x[3] for x in lines if x[0] < x[1]}
    return [(firsts.get(low, offsets[low][0]), lasts.get(high, offsets[high - 1][1]), *verdict) for low, high, verdict in found
            if verdict[0] != UNKNOWN or verdict[2] >= SIMILARITY]


def train(docs: DataFrame, negatives: int = NEGATIVES, documents: int = NEGATIVE_DOCS) -> Model:
    """A model whose unknown class comes from a bounded sample of the corpus: parts of lines that no template resembles."""
    chosen_ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    lines = docs.select("doc_id", "text").join(F.broadcast(chosen_ids), "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
    # an example is a stretch of a line, from a place the line itself decides
    place = F.pmod(F.xxhash64("line"), F.greatest(F.length("line") - EXAMPLE_CHARS, F.lit(1))).cast("int") + 1
    examples = lines.select(F.xxhash64("line", F.lit(1)).alias("h"), F.substring("line", place, F.lit(EXAMPLE_CHARS)).alias("line"))
    chosen = [words_of(r.line) for r in examples.distinct().orderBy("h", "line").limit(negatives).collect()]
    theirs = {s for t in TEMPLATES.values() for x in t for s in shingles(words_of(x), 4)}
    return fit([p for p in chosen if len(p) > 1 and not shingles(p, 4) & theirs])


def finder(model: Model):
    """An expression over a text column: every licence-like piece with its verdict, in order."""
    shared = SparkSession.active().sparkContext.broadcast((model.classes, model.place, model.weights, model.limit, model.scale))

    def find(column: pa.Array) -> pa.Array:
        own = Model(*shared.value)
        rows = []
        for text in texts(column):
            found = []
            for start, end, family, chance, like, confirmed in notices(text, own):
                found.append({"start": start, "end": end, "family": family, "probability": chance, "similarity": like, "confirmed": confirmed})
            rows.append(found)
        return pa.array(rows, FOUND_TYPE)

    return arrow_column(find, FOUND)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)`` per row of ``docs(doc_id, text, ...)``: pieces with family, probability, similarity, confirmed.

    Offsets are code points. Every line of every text is read; only the training of the unknown class
    is on a bounded sample. Null and empty texts find nothing; repeated rows stay repeated; extra
    columns, one named ``found`` included, are ignored. An empty table gives no row. Where two families
    are equally likely the first in the order of :data:`TEMPLATES` counts.
    """
    return docs.select("doc_id", finder(train(docs))(F.col("text")).alias("found"))
