"""Licence notices in texts: a trained classifier, confirmed by templates.

Paragraphs (lines; long ones in overlapping windows) are scored by a multinomial
logistic regression on hashed runs of one to three words. It is trained here, on
templates that are cropped, garbled and set among words of the corpus, against
plain paragraphs of the corpus. Its probabilities are calibrated on examples kept
back. What is rather a notice than not is compared with the templates of its
likeliest family, and one that fits confirms it. If none fits, it is a notice of
unknown licence where its probability passes a bound that few plain paragraphs pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from rolecall.llm.words import ALPHANUMERIC, gram_hashes, text_slices, word_bounds, word_hashes

# How the notices of common licences read.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0",
        "Licensed under CC BY-SA 4.0",
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
}
FAMILIES = tuple(sorted(TEMPLATES))
UNKNOWN = "unknown"

#: Hashed features, and words of a window and between the starts of two.
FEATURES, WINDOW, STRIDE = 1 << 16, 32, 16

#: Rows of the corpus that plain paragraphs are learned from, and code points of each.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 1000

#: Share of a template's word pairs that a window must hold to confirm it.
CONFIRMED = 0.6

#: Probability of being a notice from which a window is compared with templates.
PROBABLE = 0.5

#: Plain paragraphs among those kept back that may look like a notice which no
#: template confirms.
FALSE_SHARE = 0.001


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of the windows of paragraphs that begin at ``counts``; a
    paragraph's last window ends with it."""
    sizes = np.diff(counts)
    times = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    starts = np.repeat(counts[:-1], times) + nth * STRIDE
    return starts, np.minimum(starts + WINDOW, np.repeat(counts[1:], times))


def _blocks(counts: np.ndarray, lines: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of each line's block: lines of one text without a line between them
    that has no words."""
    first = np.isin(lines[:len(counts) - 1], offsets)
    empty = np.diff(counts) == 0
    return np.cumsum(first | empty | np.concatenate([[False], empty[:-1]])) if len(empty) else np.zeros(0, np.int64)


def _wrapped(counts: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of the windows that cross lines: from the beginning of each line, and
    those of the block as if it were one line."""
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    whole = np.concatenate([counts[:-1][edges], counts[-1:]])
    starts, stops = _windows(whole)
    heads = counts[:-1][np.diff(counts) > 0]
    ends = whole[np.searchsorted(whole, heads, side="right")]
    starts, stops = np.concatenate([starts, heads]), np.concatenate([stops, np.minimum(heads + WINDOW, ends)])
    pairs = np.unique(np.stack([starts, stops]), axis=1)
    crossing = np.searchsorted(counts, pairs[0], side="right") != np.searchsorted(counts, pairs[1] - 1, side="right")
    return pairs[0][crossing], pairs[1][crossing]


def _features(words: np.ndarray, paragraph: np.ndarray) -> list[np.ndarray]:
    """The features of the runs of 1, 2 and 3 words from each word on; -1 where a
    run leaves its paragraph."""
    found = []
    for size in (1, 2, 3):
        ids = np.full(len(words), -1, np.int64)
        n = len(words) - size + 1
        if n > 0:
            same = paragraph[:n] == paragraph[size - 1:]
            ids[:n] = np.where(same, (gram_hashes(words, size) >> np.uint64(44)).astype(np.int64) % FEATURES, -1)
        found.append(ids)
    return found


def _read(text: str) -> tuple[np.ndarray, list[np.ndarray]]:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALPHANUMERIC)
    words = word_hashes(data, starts, ends)
    return words, _features(words, np.zeros(len(words), np.int64))


def _vector(text: str) -> tuple[np.ndarray, float]:
    words, features = _read(text)
    ids = np.concatenate([f[f >= 0] for f in features])
    return ids, 1 / np.sqrt(max(1, len(words)))


def _pairs(words: np.ndarray) -> np.ndarray:
    return np.unique(gram_hashes(words, 2) if len(words) > 1 else words)


def _examples(plain: list[str], rng: np.random.Generator, each: int) -> list[tuple[str, int]]:
    """Templates as they may be met, by family, and plain windows as class 0, half
    of them with words from elsewhere."""
    pool = " ".join(plain).split() or ["word"]

    def some(n: int) -> list[str]:
        at = int(rng.integers(0, max(1, len(pool) - n)))
        return pool[at:at + n]

    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split() if w.isalpha() and w.islower()})
    made = []
    for label, family in enumerate(FAMILIES, 1):
        for _ in range(each):
            words = TEMPLATES[family][rng.integers(len(TEMPLATES[family]))].split()
            if len(words) > WINDOW // 2 and rng.random() < 0.5:
                at = int(rng.integers(0, len(words) - WINDOW // 3))
                words = words[at:at + WINDOW]
            if rng.random() < 0.3:
                words = [w for w in words if rng.random() > 0.1]
            room = max(0, WINDOW - len(words))
            before = int(rng.integers(0, room + 1)) if rng.random() < 0.5 else 0
            after = int(rng.integers(0, room - before + 1)) if rng.random() < 0.5 else 0
            text = " ".join(some(before) + words + some(after))
            made.append((text.lower() if rng.random() < 0.2 else text, label))
    for _ in range(each * len(FAMILIES)):
        words = some(int(rng.integers(1, WINDOW + 1)))
        kind = rng.random()
        if kind < 0.5:
            # Neither words that the sample does not hold nor single common words of
            # a template make a notice, and saying them over and over does not either.
            unseen = [f"w{rng.integers(1 << 40):x}" for _ in words]
            single = rng.choice(vocabulary, len(words)).tolist()
            words = [w[int(rng.choice(3, p=(0.3, 0.4, 0.3)))] for w in zip(words, unseen, single)]
            if kind < 0.25:
                words = (words[:int(rng.integers(1, 9))] * WINDOW)[:WINDOW]
        made.append((" ".join(words), 0))
    return made


@dataclass
class LicenceModel:
    """Weights by class (0: no notice) and feature, a temperature, the least
    probability of being a notice without a template that confirms it, and word
    pairs of the templates."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    pairs: list[tuple[int, str, np.ndarray]]

    def probabilities(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities of the classes from the summed weights of windows."""
        z = (sums / np.sqrt(np.maximum(1, sizes))[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def of(self, texts: list[str]) -> np.ndarray:
        sums, sizes = np.zeros((len(texts), len(self.bias))), np.zeros(len(texts))
        for row, text in enumerate(texts):
            words, features = _read(text)
            sizes[row] = len(words)
            for f in features:
                sums[row] += self.weights[f[f >= 0]].sum(0)
        return self.probabilities(sums, sizes)


def train(plain: list[str], seed: int = 7, each: int = 400, rounds: int = 60) -> LicenceModel:
    """The model from templates and plain paragraphs; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    known = {p for ts in TEMPLATES.values() for t in ts for p in _pairs(_read(t)[0]).tolist()}
    plain = [p for p in plain if not known & set(_pairs(_read(p)[0]).tolist())]
    made, kept = _examples(plain, rng, each), _examples(plain, rng, each // 2)
    vectors = [_vector(text) for text, _ in made]
    labels = np.array([label for _, label in made])
    rows = np.repeat(np.arange(len(made)), [len(ids) for ids, _ in vectors])
    ids = np.concatenate([ids for ids, _ in vectors])
    scale = np.array([s for _, s in vectors])
    classes = len(FAMILIES) + 1
    weights, bias = np.zeros((FEATURES, classes)), np.zeros(classes)
    grown_w, grown_b = np.full((FEATURES, classes), 1e-6), np.full(classes, 1e-6)
    target = np.eye(classes)[labels]
    for _ in range(rounds):
        z = np.zeros((len(made), classes))
        np.add.at(z, rows, weights[ids])
        z = z * scale[:, None] + bias
        z = np.exp(z - z.max(1, keepdims=True))
        error = (z / z.sum(1, keepdims=True) - target) / len(made)
        step = np.zeros((FEATURES, classes))
        np.add.at(step, ids, (error * scale[:, None])[rows])
        step += 1e-6 * weights
        grown_w += step ** 2
        grown_b += error.sum(0) ** 2
        weights -= 0.3 * step / np.sqrt(grown_w)
        bias -= 0.3 * error.sum(0) / np.sqrt(grown_b)
    pairs = [(label, t, _pairs(_read(t)[0])) for label, family in enumerate(FAMILIES, 1) for t in TEMPLATES[family]]
    model = LicenceModel(weights.astype(np.float32), bias, 1.0, PROBABLE, pairs)
    # Calibration on examples kept back: the temperature of least loss, then the
    # bound that few plain paragraphs pass.
    texts, truth = [t for t, _ in kept], np.array([label for _, label in kept])
    losses = {}
    for model.temperature in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        losses[model.temperature] = -np.log(model.of(texts)[np.arange(len(texts)), truth] + 1e-12).mean()
    model.temperature = min(losses, key=losses.get)
    notice = 1 - model.of([t for t, label in kept if label == 0])[:, 0]
    model.least = float(max(PROBABLE, np.quantile(notice, 1 - FALSE_SHARE)))
    return model


def learn(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> LicenceModel:
    """A model whose plain paragraphs are from ``documents``: some ``rows`` of them
    by a hash of the text, ``chars`` from the middle of each, a fixed bound."""
    texts = documents.select(F.col("text").cast("string").alias("text")).where("text is not null")
    picked = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).alias("picked")
    n = texts.select(picked).distinct().count()
    bound = min(1 << 62, int((1 << 62) * rows / max(1, n)))
    middle = F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int") - chars // 2)
    found = texts.select(picked, F.substring("text", middle, F.lit(chars)).alias("part")).where(
        F.col("picked") <= F.lit(bound)).distinct().orderBy("picked", "part").collect()
    return train([line for r in found for line in r.part.split("\n")])


FOUND = "doc_id bigint, n_paragraphs bigint, notices array<struct<family:string,start:bigint,end:bigint,probability:double,template:string,similarity:double>>"
_NOTICE = pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()),
                     ("template", pa.string()), ("similarity", pa.float64())])


def _notices(model: LicenceModel, data: np.ndarray, low: int, starts: np.ndarray, ends: np.ndarray, words: np.ndarray,
             hits: list[tuple[int, int, np.ndarray, bool]]) -> list[dict]:
    """Notices of one document from its windows that look like one; the best of
    those that overlap; of equals one within a line. Places are code points."""
    found = []
    for first, last, p, crosses in hits:
        label = int(np.argmax(p[1:])) + 1
        held = _pairs(words[first:last])
        similarity, template = max(((np.isin(pairs, held).mean(), t) for of, t, pairs in model.pairs if of == label))
        sure = bool(similarity >= CONFIRMED)
        if not sure and 1 - p[0] < model.least:
            continue
        found.append((sure, float(similarity), float(1 - p[0]), first, last, FAMILIES[label - 1] if sure else UNKNOWN,
                      template if sure else None, crosses))
    found.sort(key=lambda f: (-f[0], -f[1], f[7], -f[2], f[3]))
    kept: list[tuple] = []
    for f in found:
        if all(f[4] <= k[3] or k[4] <= f[3] for k in kept):
            kept.append(f)
    def place(at: int) -> int:
        return len(data[low:at].tobytes().decode(errors="replace"))
    return [{"family": f[5], "start": place(starts[f[3]]), "end": place(ends[f[4] - 1]), "probability": f[2],
             "template": f[6], "similarity": f[1]} for f in sorted(kept, key=lambda f: f[3])]


def scan(documents: DataFrame, model: LicenceModel) -> DataFrame:
    """The licence notices of every document: columns :data:`FOUND`.

    ``documents`` holds (doc_id long, text string); other columns are ignored,
    whatever their names. ``notices`` has family (one of :data:`FAMILIES` or
    ``unknown``), start and end in code points, the calibrated probability of
    being a notice, and the template that confirms it with the share of its word
    pairs found (null for unknown ones). A paragraph is a line, but a notice may go on
    over the lines that follow, up to one without words. Null and empty texts have no paragraphs
    and no notices. Repeated rows and null ids come out as they go in; an empty
    table gives no rows.
    """
    # By value, as functions of this package are sent: workers need no copy of it.
    sent = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cloudpickle.loads(sent.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, end, data, offsets in text_slices(batch.column("text"), 1 << 19):
                lines = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
                starts, ends, counts = word_bounds(data, lines, ALPHANUMERIC)
                words = word_hashes(data, starts, ends)
                paragraph = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
                sums = np.zeros((len(words) + 1, len(model.bias)))
                for ids_ in _features(words, paragraph):
                    sums[1:] += np.where(ids_ >= 0, 1, 0)[:, None] * model.weights[np.maximum(ids_, 0)]
                np.cumsum(sums, axis=0, out=sums)
                begin, stop = _windows(counts)
                p = model.probabilities(sums[stop] - sums[begin], stop - begin)
                block, within = _blocks(counts, lines, offsets), len(begin)
                over, until = _wrapped(counts, block)
                if len(over):
                    # Across lines, runs of words that cross them count.
                    sums[:] = 0
                    for ids_ in _features(words, np.repeat(block, np.diff(counts))):
                        sums[1:] += np.where(ids_ >= 0, 1, 0)[:, None] * model.weights[np.maximum(ids_, 0)]
                    np.cumsum(sums, axis=0, out=sums)
                    p = np.concatenate([p, model.probabilities(sums[until] - sums[over], until - over)])
                    begin, stop = np.concatenate([begin, over]), np.concatenate([stop, until])
                of_text = np.searchsorted(offsets, starts[begin], side="right") - 1 if len(begin) else begin
                hits: dict[int, list] = {}
                for w in np.flatnonzero(1 - p[:, 0] >= PROBABLE):
                    hits.setdefault(int(of_text[w]), []).append((int(begin[w]), int(stop[w]), p[w], w >= within))
                filled = starts[counts[:-1][np.diff(counts) > 0]]
                per_text = np.bincount(np.searchsorted(offsets, filled, side="right") - 1, minlength=end - first)
                notices = [_notices(model, data, int(offsets[k]), starts, ends, words, hits[k]) if k in hits else []
                           for k in range(end - first)]
                yield pa.record_batch([ids.slice(first, end - first), pa.array(per_text.astype(np.int64)),
                                       pa.array(notices, pa.list_(_NOTICE))], names=["doc_id", "n_paragraphs", "notices"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, FOUND)
