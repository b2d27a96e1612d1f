"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a line. Its features are word 1- and 2-grams of a vocabulary from training; a multinomial logistic
regression over them gives a probability for each licence family and for the class ``unknown``. A temperature fitted
on held-out templates and lines calibrates the probabilities; a family is predicted if its probability is at least
``least_probability``. A prediction counts only if the paragraph also resembles a template of that family:
their shared word 2-grams make up at least ``least_overlap`` of the shorter's. Adjacent lines of one family
are one span.

Training data: the templates below with random drops, cuts and neighbouring words, and, for ``unknown``, near
misses and lines of a bounded sample of the documents (see ``fit``). Everything else covers all rows. A bare
"All rights reserved." counts as Proprietary.

Null and empty texts have no paragraphs. Repeated rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, batches, rows_of

#: Public notices and opening sentences of the licence families.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under the CC0 1.0 Universal dedication."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "Proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced or distributed without prior written permission.", "Confidential and proprietary. All rights reserved."],
}
#: Lines that use the words without granting or naming a licence.
NEAR_MISSES = [
    "A driving license must be renewed every ten years.", "The version of the software is shown on the first page.", "He was granted permission to use the library.",
    "Apache helicopters flew over the public square.", "MIT is a university near Boston.", "The general public was invited to the opening.", "Copies of the book were sold without a cover.",
    "The license plate was found in the file.", "Version 2.0 of the plan is under review.", "Creative people share their work in common rooms.",
]
UNKNOWN = "unknown"
#: Bytes that part words within a line.
BREAKS = bytes(b if b >= 128 or b == 10 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in FOLD)


def line_words(text: str) -> list[list[bytes]]:
    return [line.split() for line in text.encode().translate(BREAKS).split(b"\n")]


@dataclass
class Classifier:
    families: list[str]
    words: dict[bytes, int]
    pairs: np.ndarray
    weights: np.ndarray
    temperature: float
    templates: list[list[set[int]]]
    least_probability: float = 0.6
    least_overlap: float = 0.6

    def grams(self, lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all lines, and the line of each. Words first, pairs after them."""
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        get = self.words.get
        ids = np.fromiter((get(w, -1) for line in lines for w in line), np.int64, int(lengths.sum()))
        line = np.repeat(np.arange(len(lines)), lengths)
        known = ids >= 0
        pair = np.flatnonzero(known[:-1] & known[1:] & (line[:-1] == line[1:])) if len(ids) > 1 else np.zeros(0, np.int64)
        code = ids[pair] * len(self.words) + ids[pair + 1] if len(pair) else np.zeros(0, np.int64)
        k = np.searchsorted(self.pairs, code)
        hit = (k < len(self.pairs)) & (self.pairs[np.minimum(k, max(0, len(self.pairs) - 1))] == code) if len(self.pairs) else np.zeros(len(code), bool)
        feature = np.concatenate([ids[known], len(self.words) + k[hit]])
        where = np.concatenate([line[known], line[pair][hit]])
        return feature, where

    def probabilities(self, lines: list[list[bytes]]) -> np.ndarray:
        """Of each line, for each family and last for unknown."""
        feature, where = self.grams(lines)
        scale = 1 / np.sqrt(np.maximum(1, np.fromiter((2 * len(x) - 1 for x in lines), float, len(lines))))
        z = np.zeros((len(lines), len(self.families) + 1))
        for c in range(z.shape[1]):
            z[:, c] = np.bincount(where, self.weights[feature, c], len(lines)) * scale + self.weights[-1, c]
        z /= self.temperature
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def overlap(self, line: list[bytes], family: int) -> float:
        """The greatest share of word pairs that the line and a template of the family have in common."""
        own = _pair_set(line)
        return max((len(own & t) / max(1, min(len(own), len(t))) for t in self.templates[family]), default=0.0) if own else 0.0

    def scan(self, text: str) -> list[tuple[int, int, str, float, float]]:
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str]) -> list[list[tuple[int, int, str, float, float]]]:
        """Of each text: (first line, line after the last, family, probability, overlap)."""
        split = [line_words(t) for t in texts]
        lines = [x for t in split for x in t]
        p = self.probabilities(lines)
        best = p[:, :-1].argmax(1)
        sure = np.flatnonzero(p[np.arange(len(lines)), best] >= self.least_probability)
        ends = np.cumsum([len(t) for t in split])
        out: list[list[tuple]] = [[] for _ in texts]
        for k, d in zip(sure.tolist(), np.searchsorted(ends, sure, "right").tolist()):
            share = self.overlap(lines[k], int(best[k]))
            if share < self.least_overlap:
                continue
            at, name, q = k - int(ends[d] - len(split[d])), self.families[best[k]], float(p[k, best[k]])
            if out[d] and out[d][-1][1] == at and out[d][-1][2] == name:
                a, _, _, q0, s0 = out[d][-1]
                out[d][-1] = (a, at + 1, name, max(q, q0), max(share, s0))
            else:
                out[d].append((at, at + 1, name, q, share))
        return out


def _pair_set(words: list[bytes]) -> set[bytes]:
    return {a + b" " + b for a, b in zip(words, words[1:])} or set(words)


def _examples(other_lines: list[str], copies: int, pool_lines: int, folds: int, seed: int) -> list[tuple[list[bytes], int, int]]:
    """(words, class, fold): made paragraphs of all templates, near misses and other lines.

    A template's paragraphs are in one fold, so that a fold holds whole templates that the others lack.
    """
    rng = np.random.default_rng(seed)
    made: list[tuple[list[bytes], int, int]] = []
    pool = [w for line in other_lines[:pool_lines] for w in line_words(line)[0]] or [b"text"]
    for c, templates in enumerate(TEMPLATES.values()):
        for fold, text in enumerate(templates):
            w = line_words(text)[0]
            for k in range(copies):
                v = list(w)
                if k % 4 == 1:
                    v = [x for x in v if rng.random() > 0.1] or v
                if k % 4 == 2 and len(v) > 12:
                    a = int(rng.integers(0, len(v) // 3))
                    v = v[a : a + max(8, int(len(v) * 0.6))]
                if k % 4 == 3:
                    n = int(rng.integers(1, 5))
                    v = [pool[i] for i in rng.integers(0, len(pool), n)] + v + [pool[i] for i in rng.integers(0, len(pool), n)]
                made.append((v, c, fold % folds))
    whole = [_pair_set(line_words(t)[0]) for ts in TEMPLATES.values() for t in ts]
    for k, text in enumerate([*(m for m in NEAR_MISSES for _ in range(copies)), *other_lines]):
        w = line_words(text)[0]
        own = _pair_set(w)
        # Lines of the sample that hold a template aren't examples of unknown.
        if w and max((len(own & t) / min(len(own), len(t)) for t in whole), default=0) < 0.5:
            made.append((w, len(TEMPLATES), (k // copies if k < copies * len(NEAR_MISSES) else k) % folds))
    return made


def _regression(made: list[tuple[list[bytes], int, int]], rounds: int, rate: float, ridge: float, **limits) -> Classifier:
    """Word 1- and 2-grams that three made paragraphs share, and their weights by AdaGrad steps over all examples."""
    families = list(TEMPLATES)
    counts = Counter(w for v, c, _ in made if c < len(families) for w in set(v))
    pairs = Counter(p for v, c, _ in made if c < len(families) for p in set(zip(v, v[1:])))
    words = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= 3))}
    codes = np.array(sorted(words[a] * len(words) + words[b] for (a, b), n in pairs.items() if n >= 3 and a in words and b in words), np.int64)
    n_features = len(words) + len(codes) + 1
    model = Classifier(families, words, codes, np.zeros((n_features, len(families) + 1)), 1.0, [[_pair_set(line_words(t)[0]) for t in TEMPLATES[f]] for f in families], **limits)
    lines, y = [v for v, _, _ in made], np.array([c for _, c, _ in made])
    feature, where = model.grams(lines)
    x = np.zeros((len(lines), n_features), np.float32)
    np.add.at(x, (where, feature), (1 / np.sqrt(np.maximum(1, np.array([2 * len(v) - 1 for v in lines]))))[where].astype(np.float32))
    x[:, -1] = 1
    target = np.eye(len(families) + 1, dtype=np.float32)[y]
    # Classes count alike, however many lines stand for unknown.
    weight = (len(y) / (len(families) + 1) / np.maximum(1, np.bincount(y, minlength=len(families) + 1)))[y].astype(np.float32)[:, None]
    acc = np.zeros_like(model.weights)
    for _ in range(rounds):
        z = x @ model.weights.astype(np.float32)
        e = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ ((e / e.sum(1, keepdims=True) - target) * weight) + ridge * len(y) * model.weights
        acc += g * g
        model.weights -= rate * g / (np.sqrt(acc) + 1e-9)
    return model


#: Temperatures that calibration may choose between.
COLDEST, HOTTEST = 0.05, 20.0


def calibrated(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature that makes held-out log loss least, by golden sections of its logarithm.

    scores: log probabilities at temperature 1. Raises if the loss is still falling at an end of the range.
    """
    def loss(t: float) -> float:
        z = scores / np.exp(t)
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), truth]).mean())

    lo, hi, cut = np.log(COLDEST), np.log(HOTTEST), (5**0.5 - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    t = float(np.exp((lo + hi) / 2))
    if not COLDEST * 1.01 < t < HOTTEST / 1.01:
        raise ValueError("the temperature lies at the edge of its range")
    return t


def train(
    other_lines: list[str], seed: int = 7, copies: int = 40, rounds: int = 250, rate: float = 0.5, ridge: float = 1e-4, folds: int = 3, pool_lines: int = 2000,
    least_probability: float = 0.6, least_overlap: float = 0.6,
) -> Classifier:
    """Fits the regression on all examples, and its temperature on held-out ones.

    For each fold the regression is fitted on the others and scores the fold's templates and lines, none of which it has seen.
    Words around made paragraphs come from the first ``pool_lines`` of the other lines.
    """
    limits = {"least_probability": least_probability, "least_overlap": least_overlap}
    made = _examples(other_lines, copies, pool_lines, folds, seed)
    scores, truth = [], []
    for fold in range(folds):
        model = _regression([m for m in made if m[2] != fold], rounds, rate, ridge, **limits)
        held = [m for m in made if m[2] == fold]
        scores.append(np.log(np.maximum(1e-30, model.probabilities([v for v, _, _ in held]))))
        truth += [c for _, c, _ in held]
    model = _regression(made, rounds, rate, ridge, **limits)
    model.temperature = calibrated(np.concatenate(scores), np.array(truth))
    return model


def fit(spark: SparkSession, docs: DataFrame, most_docs: int = 300, most_chars: int = 5000, most_lines: int = 6000) -> Classifier:
    """Unknown lines come from a bounded sample: at most most_lines lines of at most most_docs rows of up to most_chars characters.

    Documents are chosen by a hash of doc_id, lines by a hash of the line, so neither depends on the order of rows or
    files. Rows without doc_id aren't sampled; of rows of one id those of the least text hashes are.
    """
    order = F.xxhash64("doc_id", F.lit("licence"))
    ids = [r.doc_id for r in docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(order, "doc_id").limit(2 * most_docs).collect()]
    light = docs.select("doc_id", "text").filter(F.col("doc_id").isin(ids) & (F.char_length("text") <= most_chars))
    rows = light.orderBy(order, "doc_id", F.xxhash64("text"), "text").limit(most_docs).collect()
    lines = sorted((line for r in rows for line in r.text.split("\n")), key=lambda x: (xxhash.xxh64_intdigest(x), x))
    return train(lines[:most_lines])


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_paragraphs, n_licence, families, top_family, probability, spans) of each row.

    spans: JSON-like text ``first-after:family:probability:overlap``, one for each span, comma-joined.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("n_licence", pa.int64()), ("families", pa.string()), ("top_family", pa.string()), ("probability", pa.float64()), ("spans", pa.string())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value

        def each() -> Iterator[tuple]:
            held: list[tuple] = []
            size = 0

            def flush() -> Iterator[tuple]:
                for (doc_id, text), spans in zip(held, found.scan_all([t for _, t in held])):
                    top = max(spans, key=lambda s: (s[3], s[2]), default=None)
                    yield (
                        doc_id, sum(1 for x in text.split("\n") if x.strip()), sum(b - a for a, b, *_ in spans), ",".join(sorted({s[2] for s in spans})), top and top[2] or UNKNOWN, top and top[3] or 0.0,
                        ",".join(f"{a}-{b}:{f}:{p:.3f}:{o:.3f}" for a, b, f, p, o in spans),
                    )

            for doc_id, text in rows_of(part, "doc_id", "text"):
                held.append((doc_id, text or ""))
                size += len(text or "")
                if size > 2_000_000:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        return batches(each(), schema)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_paragraphs long, n_licence long, families string, top_family string, probability double, spans string")
