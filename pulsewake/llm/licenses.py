"""Licence scan: a trained classifier for paragraphs, and a comparison with templates that confirms it.

A paragraph is a line. Its features are the word n-grams it shares with the templates; a logistic regression over them tells
the families and the class "no licence" apart. It is trained on variants of the templates and, as no licence, on
paragraphs of a bounded sample of the corpus and on broken templates. Its probabilities are calibrated on variants that the
training didn't see; a paragraph whose best family stays below the cut-off has an unknown licence or none. A prediction is
confirmed if the paragraph holds most word pairs of one of the family's templates.

A licence may be wrapped: runs of neighbouring lines without a blank one between them are judged as well as single lines, as
far as a template can reach. A run counts if its first and its last line both add word pairs of the template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewake.llm.words import ALNUM, Block, block_of, blocks, mix, runs, text_bytes

#: Fixed texts: forms in which works name their licence, by family
TEMPLATES = {
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.",
             "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Released under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "This work is dedicated to the public domain."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL version 2 or later.",
            "it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced or distributed without permission of the owner."],
}
FAMILIES = sorted(TEMPLATES)
NONE = len(FAMILIES)
LONGEST = 3  # words of a feature
SAMPLE_TEXTS = 400
CUTOFF = 0.5
CONFIRMED = 0.6
VARIANTS = 40


def _grams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First word and fingerprint of every n-gram that stays in its text, for each length."""
    left = block.left()
    for n in range(1, LONGEST + 1):
        if len(block.words) >= n:
            grams = mix(runs(block.words, n) + np.uint64(n))
            at = np.flatnonzero(left[: len(grams)] >= n)
            yield at, grams[at]


def _lines(texts: list) -> tuple[list, np.ndarray, np.ndarray]:
    """The paragraphs of texts, how many each has, and which follow another one directly; blank lines are none."""
    out, counts, follows = [], [], []
    for text in texts:
        before, after = len(out), False
        for line in bytes(text).split(b"\n"):
            filled = bool(line.strip())
            if filled:
                out.append(line)
                follows.append(after)
            after = filled
        counts.append(len(out) - before)
    return out, np.array(counts, dtype=np.int64), np.array(follows, dtype=bool)


def _lowered(texts: list[bytes]) -> Block:
    return block_of(texts, ALNUM, lower=True)


@dataclass
class Model:
    """Known n-grams (sorted), their weights for each class, and the pairs that make each template."""

    grams: np.ndarray
    weights: np.ndarray  # [gram, class]
    bias: np.ndarray
    heat: float
    pairs: np.ndarray  # [gram, template]: the gram is a pair of the template
    families: np.ndarray  # of each template

    def found(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, gram) pairs."""
        text_of = np.repeat(np.arange(len(block.counts)), block.counts)
        out = [np.zeros(0, np.int64)]
        for at, prints in _grams(block):
            place = np.minimum(np.searchsorted(self.grams, prints), len(self.grams) - 1)
            hit = self.grams[place] == prints
            out.append(text_of[at[hit]] * np.int64(len(self.grams)) + place[hit])
        both = np.unique(np.concatenate(out))
        return both // len(self.grams), both % len(self.grams)

    def logits(self, text: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        out = np.tile(self.bias, (n, 1))
        np.add.at(out, text, self.weights[gram])
        return out

    def judge(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, probability and likeness to the best template of that family, for each text."""
        n = len(block.counts)
        text, gram = self.found(block)
        some, short = np.unique(text, return_inverse=True)
        best, chance, like = np.full(n, NONE), np.ones(n), np.zeros(n)
        if not len(some):
            return best, chance, like
        p = softmax(self.logits(short, gram, len(some)) / self.heat)
        best[some], chance[some] = p.argmax(axis=1), p.max(axis=1)
        shared = np.zeros((len(some), self.pairs.shape[1]))
        np.add.at(shared, short, self.pairs[gram])
        shared /= np.maximum(self.pairs.sum(axis=0), 1)
        like[some] = np.where(self.families[None, :] == best[some][:, None], shared, 0).max(axis=1)
        return best, chance, like

    def runs_of(self, block: Block, follows: np.ndarray) -> list[tuple[int, int]]:
        """First and last of neighbouring lines that hold most pairs of a template, to which both of them add some."""
        whole = np.cumsum(~follows)
        line_of = np.repeat(np.arange(len(block.counts)), block.counts)
        if len(line_of) < 2:
            return []
        prints = mix(runs(block.words, 2) + np.uint64(2))
        place = np.minimum(np.searchsorted(self.grams, prints), len(self.grams) - 1)
        known = (self.grams[place] == prints) & self.pairs.any(axis=1)[place] & (whole[line_of[1:]] == whole[line_of[:-1]])
        at = np.flatnonzero(known)
        place = place[at]
        sizes = self.pairs.sum(axis=0)

        def shares(first: int, last: int) -> np.ndarray:
            """Of each template, what the lines hold of its pairs."""
            a, b = np.searchsorted(at, block.starts[first]), np.searchsorted(at + 1, block.starts[last + 1])
            return self.pairs[np.unique(place[a:b])].sum(axis=0) / sizes

        # only where the lines between two blank ones hold enough together
        both = np.unique(whole[line_of[at]] * np.int64(len(self.grams)) + place)
        some, short = np.unique(both // len(self.grams), return_inverse=True)
        held = np.zeros((len(some), len(sizes)))
        np.add.at(held, short, self.pairs[both % len(self.grams)])
        likely = some[(held / sizes >= CONFIRMED).any(axis=1)]
        begins = np.unique(line_of[at[np.isin(whole[line_of[at]], likely)]])
        ends = set(line_of[at + 1].tolist())
        out = []
        for first in begins.tolist():
            last, between = first, 0
            while last + 1 < len(follows) and follows[last + 1] and between <= self.reach:
                last += 1
                between += block.counts[last]
            if last == first or (shares(first, last) < CONFIRMED).all():
                continue
            for end in range(first + 1, last + 1):
                if end in ends:
                    own = shares(first, end)
                    if ((own >= CONFIRMED) & (own > shares(first + 1, end)) & (own > shares(first, end - 1))).any():
                        out.append((first, end))
        return out

    @property
    def reach(self) -> int:
        """Words that may lie in the lines between the first and the last one of a template: twice its own."""
        return 2 * (int(self.pairs.sum(axis=0).max()) + 1)

    def wrapped(self, lines: list, block: Block, follows: np.ndarray, single: list[tuple]) -> tuple[list[tuple], list[int]]:
        """Confirmed runs of lines, as first, last, family, probability, likeness, and the ``single`` confirmed lines that give way to one.

        Runs and lines that overlap compete, whatever their families: the likest is taken, of equally like ones the longest.
        """
        found = self.runs_of(block, follows)
        if not found:
            return [], []
        best, chance, like = self.judge(_lowered([b"\n".join(lines[a : b + 1]) for a, b in found]))
        judged = [(a, b, int(f), float(p), float(near)) for (a, b), f, p, near in zip(found, best, chance, like)
                  if f != NONE and p >= CUTOFF and near >= CONFIRMED]
        out, lost, taken = [], [], set()
        for run in sorted(judged + single, key=lambda r: (-r[4], r[0] - r[1], r)):
            own = range(run[0], run[1] + 1)
            if taken.isdisjoint(own):
                taken.update(own)
                if run[1] > run[0]:
                    out.append(run)
            elif run[0] == run[1]:
                lost.append(run[0])
        return sorted(out), lost


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(words: list[str], random: np.random.Generator, filler: list[str], n: int) -> list[bytes]:
    """The template with words around it, a few left out or replaced."""
    out = []
    for _ in range(n):
        own = [w for w in words if random.random() > 0.06]
        own = [w if random.random() > 0.04 else str(random.choice(filler)) for w in own]
        before, after = (list(random.choice(filler, random.integers(0, 12))) for _ in range(2))
        out.append(" ".join([*before, *own, *after]).encode())
    return out


def train(sample: list[str], seed: int = 7) -> Model:
    """Fit the classifier; ``sample`` are texts of the corpus."""
    random = np.random.default_rng(seed)
    templates = [(FAMILIES.index(f), t) for f in FAMILIES for t in TEMPLATES[f]]
    split = [b.decode() for b in _words_of([t.encode() for _, t in templates])]
    block = _lowered([t.encode() for t in split])
    text_of = np.repeat(np.arange(len(templates)), block.counts)
    owners = {n + 1: (prints, text_of[at]) for n, (at, prints) in enumerate(_grams(block))}
    grams = np.unique(np.concatenate([p for p, _ in owners.values()]))
    pairs = np.zeros((len(grams), len(templates)))
    pairs[np.searchsorted(grams, owners[2][0]), owners[2][1]] = 1
    model = Model(grams, np.zeros((len(grams), NONE + 1)), np.zeros(NONE + 1), 1.0, pairs, np.array([f for f, _ in templates]))
    lines, _, _ = _lines([t.encode() for t in sample])
    plain = _lowered(lines) if lines else _lowered([b"nothing here"])
    text, gram = model.found(plain)
    shared = np.zeros((len(plain.counts), len(templates)))
    np.add.at(shared, text, pairs[gram])
    clean = shared.max(axis=1, initial=0) / max(1, pairs.sum(axis=0).min()) < 0.5
    negatives = [line for line, keep in zip(lines, clean) if keep]
    filler = sorted({w for line in negatives[:200] for w in line.decode("utf-8", "replace").split()})[:2000] or ["text", "word"]
    texts, targets = [], []
    for (family, _), t in zip(templates, split):
        words = t.split()
        texts += _variants(words, random, filler, VARIANTS)
        targets += [family] * VARIANTS
        # broken templates: a few of the words in any order, among others
        for _ in range(VARIANTS // 2):
            some = list(random.permutation(words)[: max(1, len(words) // 3)])
            texts.append(" ".join(random.permutation(some + list(random.choice(filler, 10)))).encode())
            targets.append(NONE)
    negatives = negatives[: len(texts)]
    texts, targets = texts + negatives, np.array(targets + [NONE] * len(negatives))
    text, gram = model.found(_lowered(texts))
    x = np.zeros((len(texts), len(grams)))
    x[text, gram] = 1
    kept = random.random(len(texts)) < 0.75
    y = np.eye(NONE + 1)[targets]
    w, b = np.zeros((len(grams), NONE + 1)), np.zeros(NONE + 1)
    velocity = [np.zeros_like(w), np.zeros_like(b)]
    for _ in range(200):
        error = (softmax(x[kept] @ w + b) - y[kept]) / kept.sum()
        for v, g in zip(velocity, (x[kept].T @ error + 1e-5 * w, error.sum(axis=0))):
            v *= 0.9
            v -= 2.0 * g
        w, b = w + velocity[0], b + velocity[1]
    model.weights, model.bias = w, b
    # the heat under which the unseen part is most likely
    z = x[~kept] @ w + b
    heats = np.geomspace(0.25, 4, 33)
    model.heat = float(min(heats, key=lambda h: -np.log(softmax(z / h)[np.arange(len(z)), targets[~kept]] + 1e-12).sum()))
    return model


def _words_of(texts: list[bytes]) -> list[bytes]:
    """Texts as their words, joined by blanks."""
    block = _lowered(texts)
    return [b" ".join(block.buffer[block.begins[i] : block.ends[i]] for i in range(a, b)) for a, b in zip(block.starts[:-1], block.starts[1:])]


def _sample(texts: DataFrame, n: int) -> list[str]:
    """The first ``n`` distinct texts by a hash. Only hashes are ranked; then the few texts below the last one are taken."""
    hashes = texts.select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(n)
    last = hashes.agg(F.max("h")).first()[0]
    if last is None:
        return []
    chosen = texts.select(F.xxhash64("t").alias("h"), "t").where(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t"))
    return [r.t for r in chosen.orderBy("h").limit(n).collect()]


def scan_licenses(docs: DataFrame, text: str = "text", sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``docs`` with ``n_paragraphs`` and ``licenses``: for each paragraph that the classifier takes for a licence or that is
    like one, or that begins a licence wrapped over lines, its number from 0, ``family`` (null: unknown), ``probability``, ``likeness`` (share of a template's word pairs)
    and ``confirmed``.

    A family below the cut-off is unknown; paragraphs without a licence aren't listed, nor are parts of a wrapped licence by
    themselves, unless they are confirmed or taken for another family. Null and empty texts have no
    paragraphs; repeated rows are scanned alike; an empty table gives an empty one. At most ``sample_texts`` texts, the
    first by a hash, are trained on: of their lines as many as there are variants of templates serve as no licence, and the words
    of the first 200 fill the variants up. Columns of ``docs`` with these names are replaced.
    """
    model = train(_sample(docs.select(F.col(f"`{text}`").alias("t")).where("t is not null"), sample_texts))
    made = ["n_paragraphs", "licenses"]
    kept = [c for c in docs.columns if c.lower() not in made]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    place, size = kept.index(text), len(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = text_bytes(batch.column(place))
            first = 0
            while first < len(values):
                last, held = first, 0
                while last < len(values) and (last == first or held + len(values[last]) < 4 << 20):
                    held += len(values[last])
                    last += 1
                lines, counts, follows = _lines(values[first:last])
                block = _lowered(lines)
                best, chance, like = model.judge(block) if lines else (np.zeros(0, int), np.zeros(0), np.zeros(0))
                text_of = np.repeat(np.arange(len(counts)), counts)
                number = np.arange(len(best)) - np.repeat(np.cumsum(counts) - counts, counts)
                good = (best < NONE) & (chance >= CUTOFF) & (like >= CONFIRMED)
                single = [(int(i), int(i), int(best[i]), float(chance[i]), float(like[i])) for i in np.flatnonzero(good)]
                wrapped, lost = model.wrapped(lines, block, follows, single) if lines else ([], [])
                alone = best < NONE
                alone[lost] = False
                for a, b, family, _, _ in wrapped:
                    part = slice(a, b + 1)
                    alone[part] &= good[part] | ((chance[part] >= CUTOFF) & (best[part] != family))
                listed = np.concatenate((np.flatnonzero(alone), np.array([w[0] for w in wrapped], dtype=np.int64)))
                order = np.argsort(listed, kind="stable")
                family, chance, like = (np.concatenate((x[alone], [w[i] for w in wrapped]))[order] for i, x in ((2, best), (3, chance), (4, like)))
                listed = listed[order]
                sure = chance >= CUTOFF
                families = [FAMILIES[int(f)] if s else None for f, s in zip(family.tolist(), sure.tolist())]
                structs = pa.StructArray.from_arrays(
                    [pa.array(number[listed], pa.int32()), pa.array(families, pa.string()), pa.array(chance), pa.array(like), pa.array(sure & (like >= CONFIRMED))],
                    names=["paragraph", "family", "probability", "likeness", "confirmed"])
                ends = np.concatenate(([0], np.cumsum(np.bincount(text_of[listed], minlength=len(counts))))).astype(np.int32)
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(size)), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), structs)], names=[*kept, *made])
                first = last

    listed = "array<struct<paragraph:int,family:string,probability:double,likeness:double,confirmed:boolean>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), f"n_paragraphs bigint, licenses {listed}"])
    return plain.mapInArrow(work, schema)
