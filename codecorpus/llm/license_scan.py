"""License scans with a trained paragraph classifier.

Lines and runs of words are described by their words and word pairs. Multinomial logistic regression tells licence families and an
unknown class apart. It is trained on a bounded sample: notice sentences of each family, paragraphs that carry the licence
vocabulary (labelled by the template they resemble, else unknown), and paragraphs with the smallest hashes. A third of the
sample is kept back to calibrate: a temperature for the scores, and the least probability a family needs, above that of every
unknown paragraph kept back. A prediction is confirmed if the line or run also holds most words of one of the family's templates in order.

Besides all lines, runs of words are judged that may lie anywhere in a paragraph (lines up to one without words), so that wrapped
notices and notices inside long paragraphs are found. A template of which most words are in a run has one of its ``KEYS`` there,
so only runs around these are compared with it; the compared run is then cut to the words that match.

Defined results: null and empty texts have no findings; a null id is reported as null; repeated rows are reported each. An empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm.common import table

#: Notice sentences by family (fixed values: the usual wording of each licence's notice).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
}
FAMILIES = ["unknown", *TEMPLATES]
#: Words of which a paragraph must have one to be sampled as licence-like.
LICENCE_WORDS = r"(?i)licen[sc]|copyright|permission|redistribut|spdx|warrant"
#: The sample: licence-like distinct paragraphs and other paragraphs, those with the smallest hashes of each.
SAMPLE_LIKE, SAMPLE_OTHER, SAMPLE_CHARS = 1_000, 2_000, 4_000
#: Shuffled and shortened copies of a template in the sample, training rounds, step and weight decay.
COPIES, ROUNDS, RATE, DECAY = 12, 300, 1.0, 1e-4
#: Share of a template's words that must be in the paragraph in order.
CONFIRMED = 0.7
PLAIN = bytes(32 if chr(c) in "\"'()[]{}<>,;:!?*#$%&|_=+/\\`~^@\t\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(paragraph: bytes) -> list[bytes]:
    """Lower-cased words without punctuation; dots stay inside words, as in version numbers."""
    return [w for w in (x.strip(b".-") for x in paragraph.translate(PLAIN).split()) if w]


@dataclass
class Classifier:
    """Weights of words (row = number in ``vocab``) and of known word pairs (sorted codes), a bias, and the calibration."""

    vocab: dict[bytes, int]
    pairs: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def features(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, paragraph) of the known words and word pairs of concatenated paragraphs."""
        v = len(self.vocab)
        same = (owner[1:] == owner[:-1]) & (ids[1:] < v) & (ids[:-1] < v)
        code = ids[:-1][same].astype(np.int64) * v + ids[1:][same]
        at = np.searchsorted(self.pairs, code)
        hit = at < len(self.pairs)
        hit[hit] = self.pairs[at[hit]] == code[hit]
        known = ids < v
        return np.r_[ids[known], v + at[hit]], np.r_[owner[known], owner[:-1][same][hit]]

    def logits(self, feature: np.ndarray, owner: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Scores by paragraph: the mean weight over its words (known or not) times the square root of their number, plus bias."""
        out = np.tile(self.bias, (len(lens), 1))
        scale = 1 / np.sqrt(np.maximum(lens, 1))
        for c in range(out.shape[1]):
            out[:, c] += np.bincount(owner, self.weights[feature, c], len(lens)) * scale
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def encode(self, paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        get, other = self.vocab.get, len(self.vocab)
        ids = np.array([get(w, other) for p in paragraphs for w in p], np.int64)
        lens = np.array([len(p) for p in paragraphs], np.int64)
        return ids, np.repeat(np.arange(len(lens)), lens), lens

    def judge(self, paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest class of each paragraph, and its probability."""
        ids, owner, lens = self.encode(paragraphs)
        p = self.probabilities(self.logits(*self.features(ids, owner), lens))
        return p.argmax(axis=1), p.max(axis=1)


def covered(template: list[bytes], paragraph: list[bytes]) -> float:
    """Share of the template's words found in order in the paragraph (longest common subsequence)."""
    row = [0] * (len(template) + 1)
    for w in paragraph:
        before = 0
        for k, t in enumerate(template, 1):
            before, row[k] = row[k], before + 1 if t == w else max(row[k], row[k - 1])
    return row[-1] / len(template)


TEMPLATE_WORDS = {f: [tokens(t.encode()) for t in ts] for f, ts in TEMPLATES.items()}


def least_words(template: list[bytes]) -> int:
    """Least words of a template that confirm it."""
    return int(np.ceil(CONFIRMED * len(template) - 1e-9))


#: Frequent words, taken as keys last.
FREQUENT = {b"under", b"this", b"that", b"with", b"following", b"person", b"version", b"public", b"general", b"source", b"either", b"later", b"work", b"free", b"file"}


def keys() -> dict[bytes, list[tuple[str, int]]]:
    """Templates by key word: of each template so many words that one of them is among any ``least_words``."""
    out: dict[bytes, list[tuple[str, int]]] = {}
    for f, templates in TEMPLATE_WORDS.items():
        for n, t in enumerate(templates):
            for w in set(sorted(t, key=lambda w: (w in FREQUENT, -len(w), w))[: len(t) - least_words(t) + 1]):
                out.setdefault(w, []).append((f, n))
    return out


KEYS = keys()


def reached(template: list[bytes], words: list[bytes]) -> list[int]:
    """Length of the longest common subsequence of the template and each beginning of ``words``."""
    row, out = [0] * (len(template) + 1), []
    for w in words:
        before = 0
        for k, t in enumerate(template, 1):
            before, row[k] = row[k], before + 1 if t == w else max(row[k], row[k - 1])
        out.append(row[-1])
    return out


def runs(paragraph: list[bytes]) -> list[tuple[str, int, int]]:
    """(family, start, end) of runs of words that hold most words of a template in order: any stretch of one and a half times the
    template's length lies in one of the stretches compared. Of each there are the run of all the words that match and the
    shortest first one that is enough."""
    near: dict[tuple[str, int], set[int]] = {}
    for p, w in enumerate(paragraph):
        for f, n in KEYS.get(w, ()):
            span = -(-3 * len(TEMPLATE_WORDS[f][n]) // 2)
            near.setdefault((f, n), set()).update((p // span - 1, p // span))
    out = set()
    for (f, n), places in near.items():
        t = TEMPLATE_WORDS[f][n]
        span, least = -(-3 * len(t) // 2), least_words(t)
        for k in places:
            low = max(0, k * span)
            part = paragraph[low : (k + 2) * span]
            have = set(part)
            if sum(w in have for w in t) < least:
                continue
            lengths = reached(t, part)
            for want in {lengths[-1], least} if lengths[-1] >= least else ():
                end = next(e for e, m in enumerate(lengths, 1) if m >= want)
                back = reached(t[::-1], part[:end][::-1])
                start = end - next(e for e, m in enumerate(back, 1) if m >= want)
                out.add((f, low + start, low + end))
    return sorted(out)


def fragment(line: list[bytes]) -> bool:
    """Whether a line is a piece of a notice: most of its words are in a template in order, but not most words of the template."""
    return len(line) > 3 and any(w in KEYS for w in line) and any(covered(line, t) >= CONFIRMED > covered(t, line) for ts in TEMPLATE_WORDS.values() for t in ts)


def closest(paragraph: list[bytes], families: list[str]) -> tuple[float, str, int]:
    """Best covered template: (share, family, number); of equal shares the longer template."""
    return max(((covered(t, paragraph), f, n) for f in families for n, t in enumerate(TEMPLATE_WORDS[f])), key=lambda x: (x[0], len(TEMPLATE_WORDS[x[1]][x[2]])))


def sample(docs: DataFrame, text: str = "text") -> tuple[list[str], list[str]]:
    """Licence-like paragraphs and other ones from all texts, of each those with the smallest hashes; of a long one ``SAMPLE_CHARS`` characters
    from a place that its hash names.

    The paragraphs are counted first. Then only those with a hash below a cut are looked at, so that about twice as many as are wanted are
    moved at all, however many paragraphs and tasks there are."""
    lines = docs.select(F.explode(F.split(text, "\n")).alias("p")).where("length(p) > 0")
    hashed = lines.select("p", F.xxhash64("p").alias("h"), F.col("p").rlike(LICENCE_WORDS).alias("like"))
    counts = {r["like"]: r["n"] for r in hashed.groupBy("like").agg(F.approx_count_distinct("h").alias("n")).collect()}
    at = F.pmod("h", F.greatest(F.length("p") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    short = F.substring("p", at, F.lit(SAMPLE_CHARS)).alias("p")
    share, out = 2.0, {}
    while True:
        wanted = {like: most for like, most in ((True, SAMPLE_LIKE), (False, SAMPLE_OTHER)) if len(out.get(like, [])) < min(most, 0.8 * counts.get(like, 0))}
        cuts = {like: min(1.0, share * most / counts[like]) for like, most in wanted.items()}
        if not cuts:
            break
        below = [(F.col("like") == like) & (F.col("h") <= int(cut * 2**64) - 2**63 - 1) for like, cut in cuts.items()]
        near = hashed.where(functools.reduce(operator.or_, below)).groupBy("like", "h").agg(F.min(short).alias("p"))
        found: dict[bool, list] = {}
        for r in near.collect():  # about twice the sample
            found.setdefault(r["like"], []).append((r["h"], r["p"]))
        out |= {like: [p for _, p in sorted(rows)[: SAMPLE_LIKE if like else SAMPLE_OTHER]] for like, rows in found.items()}
        if all(cut >= 1.0 for cut in cuts.values()):
            break
        share *= 4
    return out.get(True, []), out.get(False, [])


def examples(like: list[str], other: list[str]) -> list[tuple[list[bytes], int]]:
    """(words, class) of the training sample."""
    pick = np.random.default_rng(11)
    out = []
    # Pieces of wrapped notices are neither a notice nor unknown.
    filler = [ws for ws in (tokens(p.encode()) for p in other) if not fragment(ws)] or [[b"text"]]
    for f, templates in TEMPLATE_WORDS.items():
        for t in templates:
            for k in range(COPIES):
                around = filler[int(pick.integers(len(filler)))][: int(pick.integers(0, 8))]
                drop = pick.random(len(t)) < (0.0 if k % 3 == 0 else 0.1)
                kept = [w for w, d in zip(t, drop) if not d]
                out.append((around + kept if k % 2 else kept + around, FAMILIES.index(f)))
    for p in like:
        ws = tokens(p.encode())
        if fragment(ws):
            continue
        share, family, _ = closest(ws, list(TEMPLATES)) if ws else (0.0, "", 0)
        out.append((ws, FAMILIES.index(family) if share >= 0.9 else 0))
    out += [(ws, 0) for ws in filler]
    return out


def train(rows: list[tuple[list[bytes], int]]) -> Classifier:
    """Logistic regression by gradient steps over the sample; every third row is kept back for calibration."""
    vocab: dict[bytes, int] = {}
    for ws, _ in rows:
        for w in ws:
            vocab.setdefault(w, len(vocab))
    v = len(vocab)
    fitted = [r for n, r in enumerate(rows) if n % 3]
    held = [r for n, r in enumerate(rows) if n % 3 == 0]
    pairs = np.unique(np.array([vocab[a] * v + vocab[b] for ws, _ in fitted for a, b in zip(ws, ws[1:])] or [0], np.int64))
    model = Classifier(vocab, pairs, np.zeros((v + len(pairs), len(FAMILIES))), np.zeros(len(FAMILIES)))
    ids, owner, lens = model.encode([ws for ws, _ in fitted])
    feature, row = model.features(ids, owner)
    y = np.eye(len(FAMILIES))[[c for _, c in fitted]]
    balance = (1 / np.maximum(y.sum(axis=0), 1))[y.argmax(axis=1)]
    balance /= balance.sum()
    scale = 1 / np.sqrt(np.maximum(lens, 1))
    squares = np.full(model.weights.shape, 1e-8)
    for _ in range(ROUNDS):
        slope = (model.probabilities(model.logits(feature, row, lens)) - y) * balance[:, None]
        step = DECAY * model.weights
        for c in range(len(FAMILIES)):
            step[:, c] += np.bincount(feature, (slope[:, c] * scale)[row], len(step))
        squares += step * step
        model.weights -= RATE * step / np.sqrt(squares) * 0.1
        model.bias -= RATE * slope.sum(axis=0)
    return calibrate(model, held)


def calibrate(model: Classifier, held: list[tuple[list[bytes], int]]) -> Classifier:
    ids, owner, lens = model.encode([ws for ws, _ in held])
    scores, y = model.logits(*model.features(ids, owner), lens), np.array([c for _, c in held])
    loss = {}
    for t in np.geomspace(0.25, 8, 21):
        model.temperature = float(t)
        loss[float(t)] = -np.log(np.maximum(model.probabilities(scores)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = min(loss, key=loss.get)
    p = model.probabilities(scores)[y == 0, 1:]
    model.least = float(min(max(0.5, p.max(initial=0.0)), 0.9))
    return model


FOUND = "doc_id bigint, paragraph bigint, family string, probability double, template bigint, covered double, confirmed boolean"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def scan(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, template, covered, confirmed) of every line that is not unknown and of every
    confirmed run of words; ``paragraph`` is the number of the (first) line."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Classifier = shared.value
        for batch in batches:
            # Of each line (row, number, words); of each run (row, first line, last line, family, words).
            lines, parts = [], []
            for row, value in enumerate(batch.column(1)):
                ws, at = [], []
                for n, line in enumerate([*(value.as_py() or "").encode("utf-8").split(b"\n"), b""]):
                    here = tokens(line)
                    if here:
                        lines.append((row, n, here))
                        ws += here
                        at += [n] * len(here)
                    elif ws:
                        parts += [(row, at[a], at[b - 1], f, ws[a:b]) for f, a, b in runs(ws)]
                        ws, at = [], []
            found: dict[tuple[int, int, str], tuple] = {}
            if lines:
                best, p = own.judge([x[2] for x in lines])
                for k in np.flatnonzero((best > 0) & (p > own.least)):
                    row, n, ws = lines[k]
                    family = FAMILIES[best[k]]
                    share, _, template = closest(ws, [family])
                    found[row, n, family] = (float(p[k]), template, share, share >= CONFIRMED)
            if parts:
                best, p = own.judge([x[4] for x in parts])
                # Of runs that share lines the one with the most words of its template stays.
                judged = [(*closest(parts[k][4], [parts[k][3]]), k) for k in np.flatnonzero(p > own.least) if FAMILIES[best[k]] == parts[k][3]]
                for share, family, template, k in sorted(judged, key=lambda x: (-x[0], x[3])):
                    row, first, last = parts[k][:3]
                    if share >= CONFIRMED and not any(found.get((row, n, family), (0, 0, 0, False))[3] for n in range(first, last + 1)):
                        found[row, first, family] = (float(p[k]), template, share, True)
            ids = batch.column(0).to_pylist()
            rows = [(ids[row], n, family, *rest) for (row, n, family), rest in found.items()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], FOUND_NAMES)

    return docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(examples(*sample(docs)))).where("confirmed")
