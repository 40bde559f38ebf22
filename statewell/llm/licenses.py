"""Licence families of paragraphs, by a trained classifier and their templates.

A paragraph is a run of lines that aren't blank, comment marks stripped. Its windows of
1 to ``lines`` lines are candidates if their lines, but for single ones, have a distinctive word pair of some
template, so wrapped notices count. Features are hashed word unigrams and bigrams;
multinomial logistic regression over the families and an ``unknown`` class is trained
here. Positives are licence passages, crops of them and notices made from frames and
names; negatives are lines of a bounded sample of documents, as long as no template
confirms them, and sentences that talk of licences without granting one. A temperature
is fitted on notices whose frames training doesn't have. A window is reported if its
likeliest class is a family with ``sure`` or more, and if a template of the family
confirms it: a share ``agree`` of the template's word pairs stands in the window.
Neighbouring windows of one family are one row.

Defined results: null or empty texts have no paragraphs; a null doc_id is reported as
it is; repeated rows are reported each; of tied classes the first in order; other
columns are dropped; empty tables give no rows, and without a corpus the negatives are
the made ones only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, steps, text_buffers, tidy
from .decontamination import token_values

SLOTS = 1 << 16
#: Documents, by smallest hash of their id, whose lines are negatives; a parameter of :func:`train`.
SAMPLE_DOCS = 400
#: Most lines of one notice's window; a parameter of :func:`scan_licenses`.
LINES = 8
#: Lines without a distinctive word pair that may stand between two with one, in one notice.
GAP = 1
FOUND = "doc_id long, paragraph long, family string, probability double, confirmed double"

# Names, SPDX identifiers and passages of public licences.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPLv3"],
    "all-rights-reserved": [],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-style license"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "Creative Commons Attribution License"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "epl": ["Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "EPL-2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPLv3"],
    "isc": ["ISC License", "ISC license"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPLv3"],
    "mit": ["MIT License", "MIT license", "MIT/X11 license"],
    "mpl-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "public-domain": ["Unlicense", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero v1.0 Universal"],
}
SPDX = {
    "agpl": ["AGPL-3.0-or-later", "AGPL-3.0-only"],
    "apache-2.0": ["Apache-2.0"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause"],
    "cc-by": ["CC-BY-4.0"],
    "cc-by-nc": ["CC-BY-NC-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"],
    "epl": ["EPL-2.0"],
    "gpl": ["GPL-3.0-or-later", "GPL-2.0-only"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.1-or-later", "LGPL-3.0-only"],
    "mit": ["MIT"],
    "mpl-2.0": ["MPL-2.0"],
    "public-domain": ["CC0-1.0", "Unlicense"],
}
PASSAGES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
    "apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
    ],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit."],
    "cc-by-nc": ["You are free to share and adapt the material, but you may not use the material for commercial purposes."],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
}
#: What names are put into; the second list is for calibration only.
FRAMES = [
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "Distributed under the terms of the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "This project is released under the {}, see the LICENSE file.",
    "This file is made available under {}.",
    "License: {}",
]
HELD_FRAMES = ["Published under the {}.", "The code in this repository is covered by the {}.", "Available under the terms of {}.", "This software is provided to you under the {}."]
#: Sentences that grant nothing.
HARD = [
    "We license nothing here, under no version of terms.",
    "The driver lost his license and walked home.",
    "The general public was invited to the version of the play.",
    "MIT is a university in Cambridge, and its students are free.",
    "An Apache helicopter landed near the village.",
    "All rights of way are reserved for the farmers in this county.",
    "The commons are creative places, said the international guests.",
    "The software was distributed to all schools without charge.",
    "Which license should I choose for my project?",
    "He was permitted to use the copy machine for any purpose.",
    "Conditions of work are met with or without modification of hours.",
    "A public library released the list of new books.",
    "The eclipse was public and lasted two minutes.",
]
FAMILIES = list(NAMES)
CLASSES = ["unknown", *FAMILIES]


def notices(family: str, frames: list[str]) -> list[str]:
    return [f.format(x) for x in NAMES[family] for f in frames]


def templates(family: str) -> list[str]:
    """Passages, identifiers and the plain notices of a family."""
    return PASSAGES[family] + [f"SPDX-License-Identifier: {x}" for x in SPDX.get(family, [])] + notices(family, ["licensed under the {}"])


def grams(values: np.ndarray, bound: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``n`` tokens inside a row."""
    row = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    if len(values) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = values[: len(values) - n + 1]
    for i in range(1, n):
        h = mix(h * U64(31) + values[i : len(values) - n + 1 + i])
    same = row[: len(h)] == row[n - 1 :]
    return row[: len(h)][same], h[same]


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each feature."""
    raw = [x.lower().encode() for x in lines]
    values, bound = token_values(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
    return _slots(values, bound)


def _slots(values, bound):
    one, two = grams(values, bound, 1), grams(values, bound, 2)
    row, h = np.r_[one[0], two[0]], np.r_[one[1], two[1]]
    return row, (h & U64(SLOTS - 1)).astype(np.int64)


def _scores(weights: np.ndarray, bias: np.ndarray, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(row, minlength=n), 1)
    out = np.stack([np.bincount(row, weights[slot, c], n) for c in range(weights.shape[1])], 1)
    return out / np.sqrt(size)[:, None] + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Classifier:
    """Weights, bias and temperature; the word pairs of each template."""

    def __init__(self, negatives: list[str], rounds: int = 150, rate: float = 0.5, decay: float = 1e-4, seed: int = 5, agree: float = 0.6) -> None:
        r = np.random.default_rng(seed)
        self.templates = [(c, np.unique(pairs_of(t))) for c, name in enumerate(CLASSES) if c for t in templates(name)]
        self.size = np.array([len(t) for _, t in self.templates])
        self.of = np.repeat(np.arange(len(self.templates)), self.size)
        flat = np.concatenate([t for _, t in self.templates])
        order = np.argsort(flat, kind="stable")
        self.pairs, self.of = flat[order], self.of[order]
        common = np.unique(np.concatenate([pairs_of(x) for x in HARD + ["of the in the to the and the for the with the a copy is a this is"]]))
        self.cues = np.setdiff1d(np.unique(flat), common)

        lines, label, held = [], [], []

        def put(line: str, c: int, apart: bool) -> None:
            lines.append(line)
            label.append(c)
            held.append(apart)

        for c, name in enumerate(CLASSES):
            if c == 0:
                continue
            for text in PASSAGES[name]:
                words = text.split()
                for i in range(24):  # whole, or without some of its ends
                    lo = 0 if i < 8 else int(r.integers(0, max(1, len(words) // 3)))
                    hi = len(words) if i < 14 else int(r.integers(len(words) - len(words) // 3, len(words) + 1))
                    put(" ".join(words[lo:hi]), c, False)
            for text in notices(name, FRAMES) + [f"SPDX-License-Identifier: {x}" for x in SPDX.get(name, [])] * 6:
                put(text, c, False)
            for text in notices(name, HELD_FRAMES):
                put(text, c, True)
        pool = [w for c in FAMILIES for t in templates(c) for w in t.split()]
        made = [" ".join(r.choice(pool, int(r.integers(1, 12)))) for _ in range(300)]
        for i, line in enumerate(HARD * 6 + made + negatives):
            if not self.confirms(np.unique(pairs_of(line)), agree):
                put(line, 0, i % 5 == 0)
        label, held = np.array(label), np.array(held)
        row, slot = features(lines)
        n, used = len(lines), np.unique(slot)
        at = np.searchsorted(used, slot)
        x = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
        weight = np.where(held, 0.0, 1.0)
        weight *= np.where(label == 0, 1.0, max(1.0, (label == 0).sum() / max(1, (label > 0).sum()))) / n
        want = np.eye(len(CLASSES))[label]
        w, b = np.zeros((len(used), len(CLASSES))), np.zeros(len(CLASSES))
        gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)

        def logits() -> np.ndarray:
            return np.stack([np.bincount(row, x * w[at, c], n) for c in range(len(CLASSES))], 1) + b

        for _ in range(rounds):
            d = (_softmax(logits()) - want) * weight[:, None]
            dw = np.stack([np.bincount(at, x * d[row, c], len(used)) for c in range(len(CLASSES))], 1) + decay * w
            db = d.sum(0)
            gw += dw**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
        z = logits()[held]
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(z)), label[held]] + 1e-12).mean() for t in np.geomspace(0.1, 8, 45)}
        self.temperature = float(min(loss, key=loss.get))
        self.weights = np.zeros((SLOTS, len(CLASSES)), np.float32)
        self.weights[used] = w
        self.bias = b.astype(np.float32)

    def shares(self, own: np.ndarray) -> np.ndarray:
        """Share of each template's word pairs that stand in ``own``."""
        lo, hi = np.searchsorted(self.pairs, own, "left"), np.searchsorted(self.pairs, own, "right")
        found = [self.of[a:b] for a, b in zip(lo, hi) if b > a]
        return np.bincount(np.concatenate(found) if found else np.zeros(0, int), minlength=len(self.size)) / self.size

    def confirms(self, own: np.ndarray, agree: float) -> bool:
        return bool((self.shares(own) >= agree).any())

    def judge(self, values: np.ndarray, bound: np.ndarray, breaks: np.ndarray, sure: float, agree: float, lines: int = LINES):
        """First line, class, probability and agreement of the windows of a family.

        ``breaks`` says which lines begin a row; no window crosses one or a blank line. Of the
        windows of up to ``lines`` lines that start at a line the one that agrees most with
        its template counts; of equal ones the likelier, then the shorter.
        """
        n = len(bound) - 1
        row, pair = grams(values, bound, 2)
        cue = np.zeros(n, bool)
        cue[row[np.isin(pair, self.cues)]] = True
        start, out = 0, []
        hits = np.flatnonzero(cue)
        blank, begun = np.r_[0, np.cumsum(np.diff(bound) == 0)], np.cumsum(breaks)
        joined = (np.diff(hits) <= GAP + 1) & (blank[hits[1:]] == blank[hits[:-1]]) & (begun[hits[1:]] == begun[hits[:-1]])
        apart = np.flatnonzero(np.r_[True, ~joined]) if len(hits) else []
        for a, b in zip(apart, [*apart[1:], len(hits)]):
            start, stop = int(hits[a]), int(hits[b - 1]) + 1
            while start < stop:
                got, end = None, start + 1
                for stops in range(start + 1, min(start + lines, stop) + 1) if cue[start] else ():
                    found = self.window(values[bound[start] : bound[stops]], sure, agree)
                    if found and (got is None or (found[2], found[1]) > (got[2], got[1])):
                        got, end = found, stops
                if got and out and out[-1][4] == start and out[-1][1] == got[0] and not breaks[start]:
                    line, c, p, share, _ = out.pop()
                    out.append((line, c, max(p, got[1]), max(share, got[2]), end))
                elif got:
                    out.append((start, *got, end))
                start = end if got else start + 1
        return [x[:4] for x in out]

    def window(self, values: np.ndarray, sure: float, agree: float) -> tuple[int, float, float] | None:
        bound = np.array([0, len(values)])
        shares = self.shares(np.unique(grams(values, bound, 2)[1]))
        if shares.max() < agree:
            return None
        p = _softmax(_scores(self.weights, self.bias, *_slots(values, bound), 1) / self.temperature)[0]
        best = int(p.argmax())
        share = max((s for s, (c, _) in zip(shares.tolist(), self.templates) if c == best), default=0.0)
        return (best, float(p[best]), float(share)) if best and p[best] >= sure and share >= agree else None


def pairs_of(line: str) -> np.ndarray:
    """Hashes of the word pairs of a line."""
    raw = line.lower().encode()
    values, bound = token_values(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return grams(values, bound, min(2, max(1, len(values))))[1]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text") -> Classifier:
    """A classifier with negatives from ``sample_docs`` documents, those of the smallest id hash.

    The hashes alone choose the documents; tasks cut these into lines and send each distinct line once.
    """
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"), F.xxhash64("doc_id").alias("h"))
    last = hashed.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last)).orderBy("h", "t").limit(sample_docs)
    lines = sample.select(F.explode(F.split("t", "\n")).alias("line")).where("trim(line) != ''").distinct().orderBy("line")
    return Classifier([r.line for r in lines.collect()])


def scan_licenses(docs: DataFrame, model: Classifier, sure: float = 0.5, agree: float = 0.6, text: str = "text", lines: int = LINES) -> DataFrame:
    """A row for each notice of a licence family: number of its first line, family, probability, template agreement.

    A notice is at most ``lines`` lines as they are wrapped; a longer one gives a row for each window that agrees.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]

    @tidy
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids, out = batch.column(0).to_pylist(), []
            for i, j in steps(offsets):
                # str.lower can change lengths, so offsets are taken anew
                raw = [x.lower().encode() for x in batch.column(1)[i:j].fill_null("").to_pylist()]
                part = np.frombuffer(b"".join(raw), np.uint8)
                off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
                cuts = np.union1d(off, np.flatnonzero(part == 10) + 1)
                row = np.searchsorted(off, cuts[:-1], "right") - 1
                values, bound = token_values(part, cuts)
                breaks = np.r_[True, row[1:] != row[:-1]]
                for line, c, p, share in model.judge(values, bound, breaks, sure, agree, lines):
                    first = np.searchsorted(cuts, off[row[line]])
                    out.append((ids[i + row[line]], int(line - first), CLASSES[c], p, share))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, FOUND)
