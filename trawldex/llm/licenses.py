"""License scans of paragraphs.

A softmax regression over hashed word 1- to 3-grams names the licence family, or `none`, of every window of 8 words; windows
overlap by half and cover each paragraph whole, however long it is, so a statement of up to 5 words lies in one of them. It is
trained on variants and parts of the templates below, each with as many words of prose around it as a window has room for, and on the
windows of at most `sample` distinct paragraphs of the corpus, whole, that hold no licence word (those with the least hash), of
windows of words seen nowhere else, and of prose that uses licence words otherwise, as `none`. How licences of no listed family speak is a
class of its own (`other`), so that they end as `unknown`. A temperature set on held-out variants calibrates the probabilities.

Neighbouring windows that speak like a licence, or share word pairs with a template, are one passage. A passage counts as a family only
if the probability of one of its windows, or of the words that match the family's closest template, reaches the calibrated threshold and
that template confirms it: enough of its word pairs occur in the passage or within two windows of it. Passages that speak like a
licence or match a template without both are `unknown`. A paragraph is listed once for each family (or `unknown`) of its passages.

Paragraphs are the newline-separated lines with a word. Texts are read whole, in batches of bounded size, and no prefix is taken.

Defined results: null and empty texts have no paragraph; repeated paragraphs count each time; an empty table gives an
empty result (the classifier is then trained on templates alone); other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawldex.llm.arrays import PLAIN, mix, word_hashes
from trawldex.llm.common import materialize
from trawldex.llm.linear import Softmax

#: Licence statements by family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Distributed under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content on this site is available under a Creative Commons Attribution-ShareAlike license.",
    ],
    "mozilla": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.",
        "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this publication may be reproduced without permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: How licences of no listed family speak. They teach the class `other`, which is reported as unknown.
OTHER = [
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability.",
    "This software is provided by the contributors and any express or implied warranties are disclaimed.",
    "This program and the accompanying materials are made available under the terms of the Common Public License.",
    "By using this software you agree to be bound by the terms of this end user license agreement.",
    "You may not rent, lease, lend, sell, redistribute or sublicense the licensed application.",
    "Use of this source code is governed by a license that can be found in the LICENSE file.",
    "Distributed under the Open Software License, see the accompanying file for the full license text.",
    "The licensor grants you a worldwide, royalty-free, non-exclusive license to reproduce and distribute the work.",
    "This font is licensed under an open font license and may be bundled with any software.",
    "This document may be freely copied and distributed provided this notice is preserved.",
    "Everyone is permitted to copy and distribute verbatim copies of this license document.",
    "This material is subject to license terms; consult the license before you copy or modify it.",
    "Licensed under the Example License, version 1.1.",
    "This package is released under the terms of the Sample Licence.",
]
#: Prose with words that licences use, as `none`.
HARD = [
    "She lost her driving license after the accident and asked the court for permission to drive to work.",
    "He asked permission to leave the room and went out without a word.",
    "The copyright office is on the second floor of the old building.",
    "All seats in the front rows were reserved for guests of the family.",
    "The fishing licence costs ten pounds a year and is sold at the post office.",
    "A permit is required to sell food in the park and you can obtain a copy of the rules there.",
    "The new version of the program was published last week and runs twice as fast.",
    "They distribute free meals to any person who comes to the door.",
    "Redistribution of land was the promise of the new government.",
    "The company said its software was used by many people around the world.",
    "The terms of the peace were agreed to in writing and signed by both sides.",
    "The warranty of the car covers parts and work for five years.",
    "The source of the river is in the mountains and its form changes with the seasons.",
    "This work of art was made in the public square without a fee.",
    "The children had permission to use the garden behind the church in summer.",
    "With the permission of the owner they could use the boat and copy the old maps.",
    "The rights of the workers were granted by law and the notice was published in all papers.",
]
#: Words that a paragraph of the `none` sample must not hold.
LICENCE_WORDS = ["license", "licensed", "licence", "copyright", "reserved", "permission", "redistribution"]
CLASSES = ["none", *TEMPLATES, "other"]
SAMPLE = 3000
SAMPLE_BYTES = 2 << 20
VARIANTS = 120
UNSEEN = 800
BITS = 16
CONFIRM = 0.6
WINDOW, STRIDE = 8, 4
BATCH_BYTES = 2 << 20


def _pairs(w: np.ndarray, once: bool = True) -> np.ndarray:
    """Hashes of neighbouring words, by default each once."""
    pairs = mix(w[:-1], 0x9E3779B97F4A7C15) + w[1:]
    return np.unique(pairs) if once else pairs


def _hashes(text: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), PLAIN)[0]


def _words(text: bytes) -> list[bytes]:
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", text)


def _windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, first word and end of the windows of lines of n words each, by line; they overlap and cover every word."""
    k = np.where(n > 0, np.maximum(1, -(-n // STRIDE) - 1), 0)
    line = np.repeat(np.arange(len(n)), k)
    start = (np.arange(len(line)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE
    return line, start, np.minimum(start + WINDOW, n[line])


class Scanner:
    """Classifier, threshold and template word pairs: a fixed size, sent to every task."""

    def __init__(self, negatives: list[str], templates: dict[str, list[str]] | None = None):
        """templates: statements to learn, by default all of them."""
        templates = TEMPLATES if templates is None else templates
        rng = np.random.default_rng(7)
        prose = [_words(t.encode()) for t in negatives]
        fill = [w for ws in prose for w in ws] or [b"the"]
        line, start, end = _windows(np.array([len(ws) for ws in prose], np.int64))
        texts = [b" ".join(prose[i][a:b]) for i, a, b in zip(line, start, end, strict=True)]
        new = iter(range(1 << 62))  # words seen nowhere else stand for vocabulary that the sample does not have
        texts += [b" ".join(b"\x80%d" % next(new) for _ in range(1 + k % WINDOW)) for k in range(UNSEEN)]
        hard = [_words(t.encode()) for t in HARD]
        line, start, end = _windows(np.array([len(ws) for ws in hard], np.int64))
        texts += [b" ".join(hard[i][a:b]) for i, a, b in zip(line, start, end, strict=True) for _ in range(VARIANTS // 3)]  # as often as a statement
        labels = [0] * len(texts)
        for c, statements in enumerate([*(templates[f] for f in TEMPLATES), OTHER], 1):
            for t in statements:
                whole = _words(t.encode())
                for k in range(VARIANTS if c < len(CLASSES) - 1 else VARIANTS // 2):
                    words = whole
                    if k % 2:  # what a window sees of a longer statement
                        size = int(rng.integers(min(STRIDE + 1, len(whole)), len(whole) + 1))
                        at = int(rng.integers(0, len(whole) - size + 1))
                        words = whole[at : at + size]
                    if k % 3 == 1:
                        words = [w for w in words if rng.random() > 0.1] or words
                    words = words[:WINDOW] if k else words
                    room = max(0, WINDOW - len(words))
                    at = int(rng.integers(0, len(fill)))
                    extra = fill[at : at + int(rng.integers(0, room + 1))] if k else []
                    extra = [b"\x80%d" % next(new) for _ in extra] if k % 5 == 2 else extra
                    cut = int(rng.integers(0, len(extra) + 1))
                    texts.append(b" ".join(extra[:cut] + words + extra[cut:]))
                    labels.append(c)
        order = rng.permutation(len(texts))
        texts, y = [texts[i] for i in order], np.array(labels)[order]
        self.model = Softmax(BITS, 3, CLASSES, once=False).fit(texts, y, rate=2.0)
        aside = [i for i in range(len(texts)) if i % 5 == 4 and 0 < y[i] < len(CLASSES) - 1]
        p = self.model.of([texts[i] for i in aside])[0][np.arange(len(aside)), y[aside]] if aside else np.ones(1)
        self.threshold = float(np.quantile(p, 0.01))  # all but one in a hundred held-out variants reach it
        self.templates = [[_pairs(_hashes(t.encode())) for t in ts] for ts in (templates[f] for f in TEMPLATES)]
        self.shared = np.unique(np.concatenate([t for ts in self.templates for t in ts]))
        self.fewest = min(int(np.ceil(CONFIRM * len(t))) for ts in self.templates for t in ts)

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[dict]]]:
        """Per text: its number of paragraphs, and what its licence paragraphs hold (index, family, probability, similarity)."""
        x = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.cumsum([0] + [len(t) for t in texts])
        lines = np.unique(np.r_[starts, np.flatnonzero(x == 10) + 1])
        w, at = word_hashes(x, lines, PLAIN) if len(x) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        n = np.diff(at)
        has = n > 0
        owner = np.searchsorted(starts, lines[:-1], "right") - 1
        count = np.bincount(owner[has], minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
        out: list[tuple[int, list[dict]]] = [(int(c), []) for c in count]
        if not len(w):
            return out
        line, start, end = _windows(n)
        start, end = start + at[line], end + at[line]
        p = self.model.spans(w, start, end)
        shared = np.zeros(len(w) + 1, np.int64)
        np.cumsum(np.isin(_pairs(w, False), self.shared), out=shared[1 : max(1, len(w))])
        shared[-1] = shared[-2]
        speaks = p[:, 0] < 0.5
        likely = np.flatnonzero(speaks | (shared[end - 1] - shared[start] >= self.fewest))
        number = np.cumsum(has) - 1
        before = np.r_[0, np.cumsum(count)[:-1]]
        held: dict[tuple[int, str], dict] = {}
        for passage in np.split(likely, np.flatnonzero((np.diff(likely) > 1) | (np.diff(line[likely]) > 0)) + 1) if len(likely) else []:
            i = line[passage[0]]
            near_by = w[max(at[i], start[passage[0]] - 2 * WINDOW) : min(at[i + 1], end[passage[-1]] + 2 * WINDOW)]
            pairs = _pairs(near_by, False)
            match = [[np.isin(pairs, t) for t in ts] for ts in self.templates]
            near = [[len(np.unique(pairs[m])) / len(t) for m, t in zip(ms, ts, strict=True)] or [0.0] for ms, ts in zip(match, self.templates, strict=True)]
            closest = [int(np.argmax(x)) for x in near]
            near = [max(x) for x in near]
            if not speaks[passage].any() and max(near) < CONFIRM:
                continue
            best = p[passage, 1:-1].max(axis=0)  # of the families; `other` only speaks
            named = set(p[passage, 1:-1].argmax(axis=1).tolist())
            for f in range(len(near)):
                if near[f] >= CONFIRM:
                    where = np.flatnonzero(match[f][closest[f]])
                    where = max(np.split(where, np.flatnonzero(np.diff(where) > 2) + 1), key=len)
                    q = self.model.spans(near_by, where[:1], where[-1:] + 2)[0, 1:-1]
                    if q.argmax() == f:
                        named.add(f)
                        best[f] = max(best[f], q[f])
            sure = [f for f in sorted(named) if best[f] >= self.threshold and near[f] >= CONFIRM]
            for f in sure or [int(best.argmax())]:
                family = CLASSES[1 + f] if sure else "unknown"
                f = f if sure or speaks[passage].any() else int(np.argmax(near))
                one = held.setdefault((i, family), {"paragraph": int(number[i] - before[owner[i]]), "family": family, "probability": 0.0, "similarity": 0.0})
                one["probability"] = max(one["probability"], float(best[f]))
                one["similarity"] = max(one["similarity"], near[f])
        for (i, _), one in held.items():
            out[owner[i]][1].append(one)
        return out


def train(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Scanner:
    """The documented bound: at most `sample` distinct paragraphs, whole, of `sample_bytes` together come to the driver.

    The number of distinct paragraphs, estimated first, gives a bound on the hash that lets about twice the sample pass, so that
    little is sorted or sent; it is raised if it lets too few pass. A paragraph that no longer fits `sample_bytes` is left out.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike("[0-9A-Za-z]"))
    lines = lines.filter(~F.lower("line").rlike("|".join(map(re.escape, LICENCE_WORDS)))).withColumn("h", F.xxhash64("line"))
    found = lines.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 2 * sample / max(1, found))
    while True:
        least = lines if share >= 1 else lines.filter(F.col("h") < int(-(1 << 63) + share * (1 << 64)))
        least = materialize(least.select("h", "line").distinct().orderBy("h", "line").limit(sample), "licences")
        sizes = least.select("h", F.octet_length("line").alias("size")).collect()
        if len(sizes) >= sample or share >= 1:
            break
        share = min(1.0, 8 * share)
    left, fit = sample_bytes, []
    for r in sorted(sizes):
        if r.size <= left:
            left -= r.size
            fit.append(r.h)
    rows = least.filter(F.col("h").isin(fit)).collect() if fit else []
    return Scanner(sorted(r.line for r in rows))


def scan(docs: DataFrame, scanner: Scanner, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry plus n_paragraphs and licences (paragraph, family, probability, similarity) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    rows = docs.select(F.struct(*carry).alias("__doc"), F.col(text).cast("binary").alias("__text"))
    found = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches):
        s = sent.value
        for batch in batches:
            texts, start, size = batch.column("__text").to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or b"")
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    res = s.scan([t or b"" for t in texts[start : i + 1]])
                    yield pa.RecordBatch.from_arrays([batch.column("__doc").slice(start, i + 1 - start), pa.array([n for n, _ in res], pa.int64()), pa.array([f for _, f in res], found)], names=["__doc", "n_paragraphs", "licences"])
                    start, size = i + 1, 0

    from pyspark.sql import types as T

    one = T.StructType([T.StructField("paragraph", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType())])
    schema = T.StructType([rows.schema["__doc"], T.StructField("n_paragraphs", T.LongType()), T.StructField("licences", T.ArrayType(one))])
    return rows.mapInArrow(run, schema).select("__doc.*", "n_paragraphs", "licences")
