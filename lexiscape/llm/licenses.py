"""Licence notices in paragraphs: a sparse word n-gram logistic regression with a calibrated unknown class.

A paragraph is a line of text, with the lines that go on a notice: those directly behind it that are likeliest of its
family and share word triples with its templates, without being notices of their own. Features are its words and word pairs, hashed to FEATURES columns and
scaled to unit length; a multinomial logistic regression tells the families of TEMPLATES from `none`. It
is trained on the templates (each whole, and with words left out) and, for `none`, on paragraphs of a
bounded sample of documents (of the lines of NEGATIVE_DOCS of smallest id hash, the NEGATIVES of smallest hash) that
share no word triple with a template. A paragraph is a candidate if a family is likelier than `none`; it is `unknown` if its
probability lies below the family's calibrated cut (the CUT quantile of left-out variants of its own
templates) or if the comparison fails: of the words of the best template, or of the paragraph's if it has
fewer, a share of CONFIRM must be common to both, in order of word triples. Of families at least CLOSE times as likely
as the likeliest, the one with the largest share is taken (ties: the likelier),
with the probability of all of them. Candidates without licence words are
no notices and are dropped; other candidates stay as `unknown`.

One row a notice: doc_id, paragraph (number from 0), start, end (code points), family, probability,
template_share. Null and empty texts and empty tables give none; null doc_ids are carried; repeated rows repeat their notices; very long
texts are scanned whole. 
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.llm import text as T

STEPS = 150
FEATURES, NEGATIVE_DOCS, NEGATIVES, CUT, CONFIRM, CLOSE = 1 << 14, 400, 1500, 0.05, 0.5, 0.01
# Short public notices of licence families.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."],
}
# Words that make an unconfirmed candidate an unknown notice.
CUES = frozenset(("license", "licensed", "licence", "licenced", "copyright", "rights", "spdx", "permission", "redistribution"))

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(paragraph: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", paragraph.lower())


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, their paragraph, and words a paragraph."""
    raw = _LOWER[raw]
    starts, ends, par = T.runs(_WORD[raw], off)
    h = T.run_hashes(raw, starts, ends)
    pairs = T.shingle_hashes(h, 2)
    same = np.flatnonzero(par[:-1] == par[1:]) if len(par) > 1 else np.zeros(0, np.int64)
    columns = np.concatenate([h, pairs[same]]) % np.uint64(FEATURES)
    return columns.astype(np.int64), np.concatenate([par, par[same]]), np.bincount(par, minlength=len(off) - 1)


class Model:
    def __init__(self, negatives: list[str]):
        rng = np.random.default_rng(42)
        self.classes = ["none", *sorted(TEMPLATES)]
        texts, y, whole = [], [], []
        for family, own in TEMPLATES.items():
            for t in own:
                w = t.split()
                for i in range(24):
                    keep = [x for x in w if i == 0 or rng.random() > 0.15] or w
                    texts.append(" ".join(keep))
                    y.append(self.classes.index(family))
                    whole.append(i % 4 != 3)  # every fourth variant calibrates
        texts += negatives
        y += [0] * len(negatives)
        whole += [True] * len(negatives)
        y, whole = np.array(y), np.array(whole)
        enc = [t.encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(e) for e in enc])])
        col, par, _ = features(np.frombuffer(b"".join(enc), np.uint8), off)
        norm = 1 / np.sqrt(np.maximum(np.bincount(par, minlength=len(texts)), 1))
        self.weights = np.zeros((FEATURES + 1, len(self.classes)))
        self.weights[FEATURES, 0] = 1.0
        target = np.eye(len(self.classes))[y] * whole[:, None]
        balance = whole / np.maximum(np.bincount(y, whole, len(self.classes)), 1)[y]
        for step in range(STEPS):
            p = self._softmax(col, par, norm, len(texts))
            g = (p * whole[:, None] - target) * balance[:, None]
            share = g * norm[:, None]
            grad = np.stack([np.append(np.bincount(col, share[par, c], FEATURES), g[:, c].sum()) for c in range(len(self.classes))], axis=1)
            self.weights -= 8.0 * grad + 1e-5 * self.weights
        p = self._softmax(col, par, norm, len(texts))
        self.cut = np.array([0.0] + [min(0.5, float(np.quantile(p[(y == c) & ~whole, c], CUT))) for c in range(1, len(self.classes))])
        self.grams = [(self.classes.index(f), n_grams(words(t))) for f, own in TEMPLATES.items() for t in own]

    def _softmax(self, col, par, norm, n) -> np.ndarray:
        z = np.tile(self.weights[FEATURES], (n, 1))
        for c in range(len(self.classes)):
            z[:, c] += np.bincount(par, self.weights[col, c], n) * norm
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def classify(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        col, par, _ = features(raw, off)
        n = len(off) - 1
        return self._softmax(col, par, 1 / np.sqrt(np.maximum(np.bincount(par, minlength=n), 1)), n)

    def confirm(self, family: int, paragraph: str) -> float:
        own = n_grams(words(paragraph))
        return max((len(own & g) / max(1, min(len(own), len(g))) for f, g in self.grams if f == family), default=0.0)


def n_grams(w: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def train(docs: DataFrame, negative_docs: int = NEGATIVE_DOCS, negatives: int = NEGATIVES) -> Model:
    known = set().union(*(n_grams(words(t)) for own in TEMPLATES.values() for t in own))
    rows = T.sample(T.id_text(docs).where("text is not null"), negative_docs, "doc_id").select("text").toLocalIterator()
    lines = (p for r in rows for p in r["text"].split("\n") if p.strip() and not (n_grams(words(p)) & known) and not (CUES & set(words(p))))
    return Model(heapq.nsmallest(negatives, lines, key=lambda p: (zlib.crc32(p.encode()), p)) or ["no licence here"])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Notices of all documents."""
    spark = docs.sparkSession
    T.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in T.slices(batches):
            raw, off = T.flat(b.column("text"))
            line = np.unique(np.concatenate([off, np.flatnonzero(raw == 10) + 1, [len(raw)]]))
            p = m.classify(raw, line) if len(line) > 1 else np.zeros((0, len(m.classes)))
            best = p.argmax(axis=1)
            out = []
            doc_of = np.searchsorted(off, line[:-1], "right") - 1
            first = np.searchsorted(line, off[:-1])
            ids, data, last = b.column("doc_id"), None, -1
            place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
            for i in np.flatnonzero(best > 0).tolist():
                data = data or raw.tobytes()
                d = int(doc_of[i])
                text = data[line[i] : line[i + 1]].decode().rstrip("\n")
                own = set(words(text))
                close = np.flatnonzero(p[i, 1:] >= CLOSE * p[i, best[i]]) + 1
                share, _, c = max((m.confirm(c, text), p[i, c], c) for c in close.tolist())
                best[i] = c
                chance = float(p[i, close].sum())
                sure = share >= CONFIRM and chance >= m.cut[best[i]]
                start = int(place[line[i]] - place[off[d]])
                if not sure and share > 0 and last == i - 1 and i > first[d] and out[-1][4] == m.classes[best[i]]:
                    out[-1] = (*out[-1][:3], start + len(text), *out[-1][4:])
                    last = i
                    continue
                if not sure and not own & CUES:
                    continue
                last = i
                out.append((ids[d].as_py(), i - int(first[d]), start, start + len(text), m.classes[best[i]] if sure else "unknown", chance, share))
            names = ["doc_id", "paragraph", "start", "end", "family", "probability", "template_share"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array([x[j] for x in out], kinds[j]) for j in range(7)], names=names)

    return T.id_text(docs).mapInArrow(each, "doc_id long, paragraph long, start long, end long, family string, probability double, template_share double")
