"""Licence scanning: a trained paragraph classifier, confirmed by comparison with templates.

Sparse multinomial logistic regression over word unigrams and bigrams (those of the training notices)
names a paragraph's licence family, or none. It is trained in numpy on varied copies of the templates
and, for the unknown class, on a bounded sample of the corpus's own paragraphs (`SAMPLE_WINDOWS` windows, the
least by a hash, of about `SAMPLE_DOCUMENTS` whole documents spread over all by a hash). A temperature fitted on held-back rows calibrates the probabilities, so that
the unknown class keeps what is unsure. A prediction counts if the paragraph also holds enough of one of
the family's templates, in order. Whatever is predicted, the templates of every family are also compared
where a stretch of text, across line ends, holds enough of their words: notices are wrapped, and a paragraph
may name several licences.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import documents, slices
from wayfold.llm.decontamination import changes, common_length, plain_words

#: Short notices by which families of licences are usually named.
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0", "This software is distributed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "Released under the BSD License", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc": ("Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1"),
    "mit": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"),
    "proprietary": ("All rights reserved", "Copyright, all rights reserved. Unauthorized copying is prohibited"),
    "public_domain": ("This is free and unencumbered software released into the public domain", "Dedicated to the public domain under CC0 1.0 Universal"),
}
FAMILIES = (*sorted(TEMPLATES), "unknown")
#: Longer paragraphs are classified in windows of so many words, each half over the one before.
WINDOW = 32
#: Words of a stretch that is compared with all templates, and how far apart stretches start.
STRETCH, STEP = 48, 16
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS, VARIANTS = 1000, 4000, 60
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.8


class Classifier:
    """Vocabulary, weights (n-grams x families), bias and temperature."""

    def __init__(self, texts: list[list[bytes]], known: int):
        """Vocabulary: words and word pairs of the first `known` texts."""
        self.words = {w: k for k, w in enumerate(sorted({w for t in texts[:known] for w in t}))}
        pairs = {(self.words[a], self.words[b]) for t in texts[:known] for a, b in zip(t, t[1:], strict=False)}
        self.pairs = np.array(sorted(a * len(self.words) + b for a, b in pairs), np.int64)
        self.weights = np.zeros((len(self.words) + len(self.pairs) + 1, len(FAMILIES)), np.float32)
        self.bias, self.temperature = np.zeros(len(FAMILIES), np.float32), 1.0

    def features(self, numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, row) of words (-1: none of the vocabulary, the last feature) that stand in rows."""
        v = len(self.words)
        ok = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (row[:-1] == row[1:])
        code = numbers[:-1][ok] * v + numbers[1:][ok]
        at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
        hit = self.pairs[at] == code
        singles = np.where(numbers >= 0, numbers, v + len(self.pairs))
        f, r = np.concatenate([singles, v + at[hit]]), np.concatenate([row, row[:-1][ok][hit]])
        order = np.argsort(r, kind="stable")
        return f[order], r[order]

    def logits(self, numbers: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        out = np.repeat(self.bias[None], rows, 0)
        if len(numbers):
            f, r = self.features(numbers, row)
            start = np.nonzero(changes(r))[0]
            sizes = np.diff(np.append(start, len(r)))
            out[r[start]] += np.add.reduceat(self.weights[f], start) / np.sqrt(sizes)[:, None]
        return out

    def numbered(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        get = self.words.get
        return np.array([get(w, -1) for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits.astype(np.float64) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, texts: list[list[bytes]], labels: np.ndarray, rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> None:
        numbers, row = self.numbered(texts)
        f, r = self.features(numbers, row)
        x = (1 / np.sqrt(np.bincount(r, minlength=len(texts)).clip(1))).astype(np.float32)
        held = np.arange(len(texts)) % 5 == 0
        share = np.bincount(labels, minlength=len(FAMILIES)).clip(1)
        balance = (np.where(held, 0, 1) / share[labels] * share.mean() / len(texts))[:, None]
        target = np.eye(len(FAMILIES))[labels]
        step = np.full(self.weights.shape, 1e-4, np.float32)
        order = np.argsort(f, kind="stable")
        start = np.nonzero(changes(f[order]))[0]
        for _ in range(rounds):
            error = (self.probabilities(self.logits(numbers, row, len(texts))) - target) * balance
            g = decay * self.weights
            g[f[order][start]] += np.add.reduceat((error * x[:, None])[r[order]], start)
            step += g * g
            self.weights -= (rate * g / np.sqrt(step)).astype(np.float32) * 0.1
            self.bias -= (error.sum(0) * rate).astype(np.float32)
        z, y = self.logits(numbers, row, len(texts))[held], labels[held]
        options = np.geomspace(0.3, 4, 30)
        losses = []
        for self.temperature in options:
            losses.append(-np.log(self.probabilities(z)[np.arange(len(y)), y] + 1e-9).mean())
        self.temperature = float(options[int(np.argmin(losses))])


def windows(words: list[bytes]) -> list[list[bytes]]:
    if len(words) <= WINDOW:
        return [words]
    return [words[k : k + WINDOW] for k in range(0, len(words) - WINDOW // 2, WINDOW // 2)]


def train(plain: list[list[bytes]], seed: int = 5) -> Classifier:
    """From varied templates, alone and among the corpus's words, and windows of the corpus's paragraphs without one."""
    rng = random.Random(seed)
    texts, labels, other = [], [], []
    for k, family in enumerate(FAMILIES[:-1]):
        for template in TEMPLATES[family]:
            own = plain_words(template.encode())
            for v in range(VARIANTS):
                words = [w for w in own if v < 5 or rng.random() > 0.06]
                around = rng.choice(plain) if plain and v % 2 else []
                cut = rng.randint(0, min(len(around), 8))
                texts.append(around[:cut] + words + around[cut : cut + rng.randint(0, 12)])
                labels.append(k)
            for _ in range(VARIANTS // 4):  # a few of a notice's words are no notice
                other.append(rng.sample(own, max(1, len(own) // 3)))
    model = Classifier([plain_words(t.encode()) for f in FAMILIES[:-1] for t in TEMPLATES[f]], 10**9)
    notices = [set(plain_words(t.encode())) for f in FAMILIES[:-1] for t in TEMPLATES[f]]
    clean = [w for w in plain if all(len(n & set(w)) < 0.6 * len(n) for n in notices)]
    other += clean + [[b"x%d" % rng.randrange(1000) for _ in range(20)] for _ in range(20)]
    texts, labels = texts + other, np.array(labels + [len(FAMILIES) - 1] * len(other))
    order = np.random.default_rng(seed).permutation(len(texts))
    model.fit([texts[k] for k in order], labels[order])
    return model


class Notices:
    """All families' templates, for comparison with stretches of text."""

    def __init__(self, compared: dict[int, list[list[int]]], n_words: int):
        self.families = [k for k, ts in compared.items() for _ in ts]
        self.templates = [t for ts in compared.values() for t in ts]
        self.count = np.zeros((n_words + 1, len(self.templates)), np.float32)
        self.own = np.zeros_like(self.count)  # words that no other family's templates have
        has = [{w for t in ts for w in t} for ts in compared.values()]
        for j, (k, t) in enumerate(zip(self.families, self.templates, strict=True)):
            own = set(t) - set().union(*(has[o] for o in range(len(has)) if o != k))
            for w in t:
                self.count[w, j] += 1
            self.own[list(own or t), j] = 1
        self.least = np.array([LEAST_SHARE * len(t) for t in self.templates], np.float32) - 1e-3

    def find(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(family, place of a word of it) of the notices in a paragraph's words (-1: in no template)."""
        at = np.nonzero(words >= 0)[0]
        starts = np.unique(np.maximum(np.concatenate([at // STEP * STEP - k * STEP for k in range(STRETCH // STEP)]), 0)) if len(at) else at
        found = set()
        for a in range(0, len(starts), 4096):
            part = starts[a : a + 4096]
            there = np.zeros((len(part), len(self.count)), np.float32)
            for k in range(STRETCH):
                i = part + k
                ok = i < len(words)
                there[np.nonzero(ok)[0], words[i[ok]]] = 1
            there[:, -1] = 0
            hit, template = np.nonzero((there @ self.count >= self.least) & (there @ self.own > 0))
            for r, j in zip(hit.tolist(), template.tolist(), strict=True):
                start, t = int(part[r]), self.templates[j]
                stretch = words[start : start + STRETCH]
                if common_length(t, stretch.tolist()) >= LEAST_SHARE * len(t):
                    found.add((self.families[j], start + int(np.nonzero(np.isin(stretch, t))[0][0])))
        return found


def sampled(docs: DataFrame) -> list[list[bytes]]:
    """Windows of the paragraphs of some whole documents, each document and window chosen by a hash of its own."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(docs.count(), 1))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                found = [b" ".join(w) for t in texts for line in t.split(b"\n") for w in windows(plain_words(line)) if w]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["words"])

    rows = some.mapInArrow(run, "words binary").distinct().orderBy(F.xxhash64("words"), "words").limit(SAMPLE_WINDOWS).collect()
    return [bytes(r.words).split(b" ") for r in rows]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_predicted, n_confirmed, families) for each row: its paragraphs (lines with a
    word), those that the classifier gives a family, those that a template confirms, and the confirmed
    families, sorted and joined by commas. Notices are also looked for across the ends of successive lines with
    words; one that is counts as confirmed in the line that it begins in.

    Null and empty texts have no paragraphs. Rows without an id and repeated rows are scanned each; very
    long texts are scanned whole, and very long paragraphs classified in windows; of families that the
    classifier gives the same probability the first by name is taken; an empty table gives an empty table; other
    columns are ignored.
    """
    docs = documents(df, id_col, text_col)
    model = train(sampled(docs))
    get = model.words.get
    compared = {}
    for k, f in enumerate(FAMILIES[:-1]):
        compared[k] = [[get(w, -1) for w in plain_words(t.encode())] for t in TEMPLATES[f]]

    notices = Notices(compared, len(model.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                numbers, sizes, doc = [], [], []
                paragraphs = np.zeros(len(texts), np.int64)
                owner: list[int] = []
                predicted, confirmed, families = [set() for _ in texts], [set() for _ in texts], [set() for _ in texts]

                def across(d: int, lines: list[list[int]]) -> None:
                    ends = np.cumsum([len(x) for x in lines])
                    for k, place in notices.find(np.array([w for x in lines for w in x], np.int64)):
                        confirmed[d].add(int(paragraphs[d]) - len(lines) + int(np.searchsorted(ends, place, side="right")))  # noqa: B023
                        families[d].add(FAMILIES[k])  # noqa: B023

                for d, text in enumerate(texts):
                    block: list[list[int]] = []
                    for line in text.split(b"\n"):
                        words = plain_words(line)
                        if not words:
                            if block:
                                across(d, block)
                            block = []
                            continue
                        own = [get(w, -1) for w in words]
                        block.append(own)
                        starts = range(0, len(own) - WINDOW // 2, WINDOW // 2) if len(own) > WINDOW else (0,)
                        for at in starts:
                            part = own[at : at + WINDOW]
                            numbers += part
                            sizes.append(len(part))
                            doc.append(d)
                            owner.append(int(paragraphs[d]))
                        paragraphs[d] += 1
                    if block:
                        across(d, block)
                row = np.repeat(np.arange(len(sizes)), sizes)
                flat = np.array(numbers, np.int64)
                p = model.probabilities(model.logits(flat, row, len(sizes))) if sizes else np.zeros((0, len(FAMILIES)))
                best = p.argmax(1)
                ends = np.cumsum([0, *sizes])
                for w in np.nonzero((best < len(FAMILIES) - 1) & (p.max(1) >= LEAST_PROBABILITY))[0].tolist():
                    k, d, words = int(best[w]), doc[w], flat[ends[w] : ends[w + 1]].tolist()
                    predicted[d].add(owner[w])
                    if any(common_length(t, words) >= LEAST_SHARE * len(t) for t in compared[k]):
                        confirmed[d].add(owner[w])
                        families[d].add(FAMILIES[k])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(paragraphs), pa.array([len(x) for x in predicted], pa.int64()), pa.array([len(x) for x in confirmed], pa.int64()), pa.array([",".join(sorted(x)) for x in families], pa.string())], ["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "families"])

    return docs.mapInArrow(run, "doc_id long, n_paragraphs long, n_predicted long, n_confirmed long, families string")
