"""License scans: a trained paragraph classifier with templates to confirm it.

Sparse word n-grams (single words and pairs, hashed) of each paragraph (a line) go
through multinomial logistic regression over the licence families and an unknown
class. It is trained on paragraphs made from the families' templates (whole, cut,
joined, with words dropped or changed) against a bounded sample of corpus
paragraphs and prose about licences as unknown. A temperature, fitted on held-out
made paragraphs, calibrates the probabilities; a paragraph whose likeliest family
is below a threshold is unknown. A prediction counts once the family's templates
confirm it: some template's words, in order, are in the paragraph to a minimal
share of its pairs.

Licence texts are wrapped, so a passage of several lines is scanned too: where words
of at most twice a template's length hold a minimal share of its pairs, line breaks
between them or not, the passage from the first of those pairs to the last is
classified and confirmed like a paragraph.

Null and empty texts have no paragraphs. Rows are scanned where they are; rows
without a find come back with none, repeated rows as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import ALNUM, buffers, hashes, mix, spans
from .common import text_batches

#: Wordings by which licences of each family are given or named.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
        "Released under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Prose that speaks of licences without giving one.
_NEAR_MISSES = [
    "He renewed his driving license last week.", "The license plate was hard to read.", "A public library lends books free of charge to any person.",
    "The general public was asked to use the other door.", "Version 3 of the report was published in January 2004.", "The committee granted permission to build a bridge.",
    "You may copy the recipe and use it as you like.", "The institute is in Massachusetts.", "They distribute software and sell copies of books.",
    "The foundation gives free lessons in common law.", "The restaurant lost its liquor license in the spring.", "Apache helicopters were seen over the valley.",
    "All rights come with duties.", "We met the following conditions on the road: rain, snow and fog.", "The work is in the public eye.",
]
_BITS = 18


def paragraphs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines of all texts that hold a byte, as one large_string array; the row and
    the first byte's offset within its text of each."""
    data, offsets = buffers(texts)
    kind = np.ones(256, bool)
    kind[[0x0A, 0x0D]] = False
    starts, ends, firsts = spans(data, offsets, kind)
    row = np.repeat(np.arange(len(texts)), np.diff(firsts))
    if not len(starts):
        return pa.array([], pa.large_string()), row, starts
    # lines keep their places in the bytes: what lies between two of them goes
    keep = kind[data]
    cut = np.concatenate([[0], np.cumsum(ends - starts)])
    lines = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data[keep]))
    return lines, row, starts - offsets[:-1][row]


def grams(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, hash) of single words and pairs; and the words of each line as offsets."""
    data, offsets = buffers(lines)
    starts, ends, firsts = spans(data, offsets, ALNUM)
    words = hashes(data, starts, ends)
    line = np.repeat(np.arange(len(lines)), np.diff(firsts))
    pair = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    same = line[:-1] == line[1:]
    return np.concatenate([line, line[:-1][same]]), np.concatenate([words, pair[same]]), firsts


@dataclass
class Classifier:
    families: list[str]  # class 0 is unknown
    weights: np.ndarray  # 2^_BITS x classes, float32
    bias: np.ndarray
    temperature: float
    threshold: float
    templates: list[list[np.ndarray]]  # by family, distinct pair hashes of each template
    confirm: float

    def logits(self, lines: pa.Array) -> np.ndarray:
        line, h, _ = grams(lines)
        at = (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        # most grams weigh nothing: they need no sum
        some = self.used[at]
        line, at = line[some], at[some]
        n = np.bincount(line, minlength=len(lines))
        z = np.tile(self.bias, (len(lines), 1))
        if len(line):
            order = np.argsort(line, kind="stable")
            line, at = line[order], at[order]
            first = np.flatnonzero(np.diff(line, prepend=-1))
            z[line[first]] += np.add.reduceat(self.weights[at], first, axis=0) / np.sqrt(n[line[first]])[:, None]
        return z

    def __post_init__(self):
        self.used = np.abs(self.weights).max(axis=1) > 0 if len(self.weights) else np.zeros(0, bool)

    def predict(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The class of each line (0: unknown) and its calibrated probability."""
        z = self.logits(lines) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(best)), best]
        return np.where(score >= self.threshold, best, 0), score

    def share(self, line: str, family: int) -> float:
        """The largest share of a template's pairs that a line holds."""
        own = np.unique(_pairs(line))
        return max((float(np.isin(t, own).mean()) for t in self.templates[family - 1] if len(t)), default=0.0)


def passages(texts: pa.Array, net: Classifier) -> Iterator[tuple[int, int, int, int]]:
    """(row, family, first byte, end) of passages over several lines that hold the
    minimal share of a template's pairs; bytes count from the text's first one."""
    data, offsets = buffers(texts)
    starts, ends, firsts = spans(data, offsets, ALNUM)
    if len(starts) < 2:
        return
    words = hashes(data, starts, ends)
    row = np.repeat(np.arange(len(texts)), np.diff(firsts))
    pair = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    known = np.unique(np.concatenate([t for own in net.templates for t in own]))
    maybe = np.zeros(1 << 16, bool)
    maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(pair & np.uint64(0xFFFF)).astype(np.int64)] & (row[:-1] == row[1:]))
    at = at[np.isin(pair[at], known)]
    line = np.concatenate([[0], np.cumsum((data == 0x0A) | (data == 0x0D))])
    for family, own in enumerate(net.templates, 1):
        for template in own:
            hits = at[np.isin(pair[at], template)]
            least, width = net.confirm * len(template), 2 * (len(template) + 1)
            # texts lie further apart than a passage is long
            far = hits + row[hits] * (width + 1)
            count = np.searchsorted(far, far + width) - np.arange(len(far))
            k, some = 0, np.flatnonzero(count >= least)
            while k < len(some):
                # of the starts within one template's length the one that holds most
                near = some[k : k + int(np.searchsorted(far[some[k:]], far[some[k]] + len(template)))]
                i = int(near[np.argmax(count[near])])
                held = hits[i : i + int(count[i])]
                if len(np.unique(pair[held])) < least:
                    k += 1
                    continue
                a, b = int(starts[held[0]]), int(ends[held[-1] + 1])
                if line[a] != line[b]:
                    r = int(row[held[0]])
                    yield r, family, a - int(offsets[r]), b - int(offsets[r])
                k = int(np.searchsorted(some, i + int(count[i])))


def _pairs(line: str) -> np.ndarray:
    data, offsets = buffers(pa.array([line], pa.large_string()))
    starts, ends, _ = spans(data, offsets, ALNUM)
    words = hashes(data, starts, ends)
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def _made(rng: np.random.Generator, n: int, noise: list[str]) -> tuple[list[str], list[int]]:
    """Paragraphs of each family, with the noise a corpus puts on them."""
    lines, y = [], []
    words = [w for t in noise for w in t.split()] or ["the"]
    for k, (_, own) in enumerate(TEMPLATES.items(), 1):
        for i in range(n):
            w = own[i % len(own)].split()
            if i >= len(own):
                if len(w) > 14 and rng.random() < 0.4:
                    a = int(rng.integers(0, len(w) - 12))
                    w = w[a : a + int(rng.integers(12, len(w) - a + 1))]
                w = [x for x in w if rng.random() > 0.04] or w
                if rng.random() < 0.3:
                    pick = [words[j] for j in rng.integers(0, len(words), int(rng.integers(1, 12)))]
                    w = pick + w if rng.random() < 0.5 else w + pick
                if rng.random() < 0.2:
                    w = [x.upper() for x in w]
            lines.append(" ".join(w))
            y.append(k)
    return lines, y


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_unknown: int = 4000, per_family: int = 120, threshold: float = 0.6, confirm: float = 0.5, seed: int = 3) -> Classifier:
    """max_unknown bounds the corpus paragraphs in training: one paragraph, by hash,
    of documents chosen by a hash of the id. Paragraphs that hold half of a
    template's pairs are not taken as unknown."""
    count = docs.count()
    unit = 1 << 30
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(unit)) < int(min(1.0, max_unknown / max(count, 1)) * unit)).select(F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "t"):
            lines, row, _ = paragraphs(texts)
            if len(lines):
                last = np.flatnonzero(np.diff(row, append=-1))
                first = np.concatenate([[0], last[:-1] + 1])
                pick = first + (np.arange(len(first)) * 7919 + last) % (last - first + 1)
                yield pa.RecordBatch.from_arrays([pa.array([x[:2000] for x in lines.take(pa.array(pick)).to_pylist()], pa.string())], names=["line"])

    corpus = sorted({r["line"] for r in some.mapInArrow(run, "line string").toLocalIterator()})
    templates = [[np.unique(_pairs(t)) for t in own] for own in TEMPLATES.values()]
    whole = [t for own in templates for t in own]
    corpus = [x for x in corpus if not any(np.isin(t, own).mean() >= 0.5 for own in [np.unique(_pairs(x))] for t in whole)]
    rng = np.random.default_rng(seed)
    made, y = _made(rng, per_family, corpus)
    lines = made + corpus + _NEAR_MISSES * 8
    y = np.array(y + [0] * (len(lines) - len(made)))
    test = rng.random(len(lines)) < 0.2
    net = Classifier(["unknown", *TEMPLATES], np.zeros((1 << _BITS, len(TEMPLATES) + 1), np.float32), np.zeros(len(TEMPLATES) + 1), 1.0, threshold, templates, confirm)
    _fit(net, [x for x, t in zip(lines, test) if not t], y[~test])
    z = net.logits(pa.array([x for x, t in zip(lines, test) if t], pa.large_string()))
    loss = {}
    for t in np.geomspace(0.2, 5, 33):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        loss[float(t)] = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[test]]).mean())
    net.temperature = min(loss, key=loss.get) if len(z) else 1.0
    return net


def _fit(net: Classifier, lines: list[str], y: np.ndarray, epochs: int = 30, rate: float = 0.5, l2: float = 1e-4) -> None:
    line, h, _ = grams(pa.array(lines, pa.large_string()))
    at = (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    # only grams of licence paragraphs weigh: what only the corpus has says nothing of a family
    known = np.zeros(1 << _BITS, bool)
    known[at[y[line] > 0]] = True
    some = known[at]
    line, at = line[some], at[some]
    bins, col = np.unique(at, return_inverse=True)
    n = np.bincount(line, minlength=len(y))
    value = 1 / np.sqrt(n[line])
    k = len(net.families)
    w, b = np.zeros((len(bins), k)), np.zeros(k)
    gw2, gb2 = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    target = np.eye(k)[y]
    order = np.argsort(col, kind="stable")
    first = np.flatnonzero(np.diff(col[order], prepend=-1))
    r_order = np.argsort(line, kind="stable")
    r_first = np.flatnonzero(np.diff(line[r_order], prepend=-1))
    rows = line[r_order][r_first]
    for _ in range(epochs * 4):
        z = np.tile(b, (len(y), 1))
        z[rows] += np.add.reduceat((w[col] * value[:, None])[r_order], r_first, axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = p - target
        gw = np.add.reduceat((d[line] * value[:, None])[order], first, axis=0) / len(y) + l2 * w
        gb = d.mean(axis=0)
        gw2 += gw * gw
        gb2 += gb * gb
        w -= rate * gw / np.sqrt(gw2)
        b -= rate * gb / np.sqrt(gb2)
    net.weights[bins] = w
    net.bias = b
    net.__post_init__()


SCHEMA = "n_paragraphs long, families array<string>, finds array<struct<family:string,start:long,n_chars:long,score:double,confirmed:double>>"


def scan(docs: DataFrame, net: Classifier, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_paragraphs, families (sorted, confirmed ones) and finds (the confirmed
    paragraphs and passages: byte offset, length, probability, share of the template) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        find = pa.struct([("family", pa.string()), ("start", pa.int64()), ("n_chars", pa.int64()), ("score", pa.float64()), ("confirmed", pa.float64())])
        for batch, texts in text_batches(batches, "t"):
            lines, row, start = paragraphs(texts)
            finds: list[list[dict]] = [[] for _ in range(len(texts))]
            ends: list[list[dict]] = [[] for _ in range(len(texts))]  # finds with their last bytes
            if len(lines):
                best, score = model.predict(lines)
                for i in np.flatnonzero(best > 0).tolist():
                    line = lines[i].as_py()
                    share = model.share(line, int(best[i]))
                    if share >= model.confirm:
                        finds[row[i]].append({"family": model.families[best[i]], "start": int(start[i]), "n_chars": len(line), "score": float(score[i]), "confirmed": share})
                        ends[row[i]].append(finds[row[i]][-1] | {"end": int(start[i]) + len(line.encode())})
            found = list(passages(texts, model))
            if found:
                parts = [texts[r].as_py().encode()[a:b].decode() for r, _, a, b in found]
                best, score = model.predict(pa.array(parts, pa.large_string()))
                for (r, family, a, b), part, k, p in zip(found, parts, best.tolist(), score.tolist()):
                    name = model.families[family]
                    if k == family and not any(f["family"] == name and f["start"] < b and a < f["end"] for f in ends[r]):
                        f = {"family": name, "start": a, "n_chars": len(part), "score": p, "confirmed": model.share(part, family)}
                        finds[r].append(f)
                        ends[r].append(f | {"end": b})
            for x in finds:
                x.sort(key=lambda f: f["start"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(row, minlength=len(texts)), pa.int64()), pa.array([sorted({f["family"] for f in x}) for x in finds], pa.list_(pa.string())), pa.array(finds, pa.list_(find))],
                names=[id_col, "n_paragraphs", "families", "finds"],
            )

    return docs.select(F.col(id_col), F.col(text).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
