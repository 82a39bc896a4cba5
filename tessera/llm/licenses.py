"""Licence families of paragraphs: sparse word n-grams, logistic regression, a calibrated unknown class, templates."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Short notices and opening passages by which each family is known.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is available under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal public domain dedication.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}
#: Prose with licence words that names no licence.
PLAIN = [
    "The driver must hold a valid license and show it to the officer on request.",
    "The library was open in the general public interest until the version of events changed.",
    "She asked for permission to use the software, free of charge, during the course.",
    "This work is the result of three years of research at the university.",
    "The new version of the program will be released under budget next spring.",
    "The fishing license costs four dollars and must be renewed each year.",
    "Apache is also the name of a people and of a helicopter; the museum shows both.",
    "We studied at MIT and published our work in the public domain of ideas.",
    "The conditions were met, the copy was made, and the notice was posted.",
    "El trabajo fue publicado en la universidad con el permiso del autor.",
    "Die Lizenz zum Fahren wurde nach der Prüfung erteilt.",
    "Le travail a été publié sous la direction du professeur.",
    "Warranty claims are handled by the distributor within thirty days.",
    "In version 2.0 we fixed the memory leak and improved the cache.",
    "Share your thoughts with the community and read the terms of service.",
]
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Words of the longest n-gram; rows that the fit draws from the texts above, for each; a paragraph's probability to count.
GRAMS, DRAWN, SURE = 3, 24, 0.5
#: Share of a template's bigrams that a paragraph must hold, or of the paragraph's that the template must hold.
CONFIRM = 0.6
UNKNOWN = "unknown"


def words(text: str) -> list[str]:
    """Words in lower case; points and hyphens inside belong to them."""
    return WORD.findall(text.lower())


def grams(tokens: list[str]) -> list[str]:
    """All n-grams of 1 to GRAMS words."""
    return [" ".join(tokens[k : k + n]) for n in range(1, GRAMS + 1) for k in range(len(tokens) - n + 1)]


@dataclass
class Classifier:
    """Weights of each known n-gram for each class, the classes, and the temperature that calibrates them."""

    ids: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    classes: list[str]
    temperature: float

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """Calibrated class probabilities of paragraphs, given as lists of n-gram ids."""
        scores = np.tile(self.bias, (len(rows), 1))
        for k, r in enumerate(rows):
            if r:
                scores[k] += self.weights[r].sum(0) / math.sqrt(len(r))
        scores /= self.temperature
        scores -= scores.max(1, keepdims=True)
        p = np.exp(scores)
        return p / p.sum(1, keepdims=True)


def training_rows(seed: int = 11) -> list[tuple[list[str], str]]:
    """Labelled paragraphs: templates and plain prose with words dropped, cut and put among others."""
    rnd = random.Random(seed)
    filler = [w for t in PLAIN for w in words(t)]
    made = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, PLAIN)]:
        for t in texts:
            own = words(t)
            made.append((own, family))
            for _ in range(DRAWN):
                kept = [w for w in own if rnd.random() > 0.06] or own
                around = [rnd.choice(filler) for _ in range(rnd.choice([0, 0, 2, 5, 12]))]
                cut = rnd.randrange(len(around) + 1)
                made.append((around[:cut] + kept + around[cut:], family))
    for _ in range(1200):
        made.append(([rnd.choice(filler) for _ in range(rnd.choice([3, 8, 20, 40]))], UNKNOWN))
    names = sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t)})
    for _ in range(600):  # licence words in no order name no licence
        made.append(([rnd.choice(names) for _ in range(rnd.choice([1, 2, 3, 6]))] + [rnd.choice(filler) for _ in range(12)], UNKNOWN))
    return made


def fit(rows: list[tuple[list[str], str]] | None = None, steps: int = 300, ridge: float = 1e-4) -> Classifier:
    """Multinomial logistic regression on n-gram presence, calibrated on every fifth row by temperature."""
    rows = training_rows() if rows is None else rows
    classes = [UNKNOWN, *sorted({f for _, f in rows} - {UNKNOWN})]
    seen: dict[str, int] = {}
    for k, (tokens, _) in enumerate(rows):
        if k % 5:
            for g in grams(tokens):
                seen[g] = seen.get(g, 0) + 1
    ids = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    lists = [sorted({ids[g] for g in grams(t) if g in ids}) for t, _ in rows]
    y = np.array([classes.index(f) for _, f in rows])
    held = np.arange(len(rows)) % 5 == 0
    at = np.array([i for i, r in enumerate(lists) for _ in r], int)
    col = np.array([c for r in lists for c in r], int)
    val = np.array([1 / math.sqrt(len(r)) for r in lists for _ in r])[:, None]
    filled, row_starts = np.unique(at, return_index=True)
    by_col = np.argsort(col, kind="stable")
    columns, col_starts = np.unique(col[by_col], return_index=True)

    def scored(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        scores = np.tile(b, (len(rows), 1))
        scores[filled] += np.add.reduceat(w[col] * val, row_starts, axis=0)
        return scores

    target = np.eye(len(classes))[y]
    w, b = np.zeros((len(ids), len(classes))), np.zeros(len(classes))
    moment, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        scores = scored(w, b)
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - target) * ~held[:, None]
        grade = np.zeros_like(w)
        grade[columns] = np.add.reduceat((error[at] * val)[by_col], col_starts, axis=0)
        grade = grade / (~held).sum() + ridge * w
        moment, second = 0.9 * moment + 0.1 * grade, 0.99 * second + 0.01 * grade**2
        w -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * error.mean(0)
    scores = scored(w, b)
    best = min((_loss(scores[held] / t, y[held]), t) for t in (0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0))
    return Classifier(ids, w, b, classes, best[1])


def _loss(scores: np.ndarray, y: np.ndarray) -> float:
    top = scores.max(1)
    return float((top + np.log(np.exp(scores - top[:, None]).sum(1)) - scores[np.arange(len(y)), y]).mean())


def template_overlap(tokens: list[str], family: str) -> float:
    """How much of a template of the family stands in the paragraph, or of the paragraph in it, by bigrams."""
    mine = set(zip(tokens, tokens[1:], strict=False))
    best = 0.0
    for own in _TEMPLATE_BIGRAMS.get(family, []):
        common = len(mine & own)
        best = max(best, common / max(1, len(own)), common / max(1, len(mine)) if len(mine) >= 4 else 0.0)
    return best


_TEMPLATE_BIGRAMS = {f: [set(zip(w, w[1:], strict=False)) for w in map(words, ts)] for f, ts in TEMPLATES.items()}
_BIGRAMS = frozenset().union(*(b for bs in _TEMPLATE_BIGRAMS.values() for b in bs))
#: Words of the whole lines in a stretch: twice those of the longest template.
INNER = 2 * max(len(words(t)) for ts in TEMPLATES.values() for t in ts)
#: With fewer bigrams of templates than this, no template can confirm, so the paragraph isn't scored.
_LEAST = min(math.ceil(CONFIRM * min(len(b) for bs in _TEMPLATE_BIGRAMS.values() for b in bs)), 2)
FOUND = "array<struct<family:string,probability:double,overlap:double,paragraph:int,start:int,stop:int>>"
_FOUND = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64()), ("paragraph", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))


def scan(text: str | None, model: Classifier) -> list[dict]:
    """The confirmed licence paragraphs of a text: family, probability, overlap, number of the first line, place in characters."""
    if not text:
        return []
    lines, at = [], 0
    for k, line in enumerate(text.split("\n")):
        lines.append((k, at, at + len(line), words(line)))
        at += len(line) + 1
    found = confirmed([[x] for x in lines], model)
    taken = {f["paragraph"] for f in found}
    joined = confirmed(wrapped([x for x in lines if x[0] not in taken]), model)
    for f in sorted(joined, key=lambda f: (-f["overlap"], f["stop"] - f["start"], f["start"])):
        if all(f["stop"] <= o["start"] or o["stop"] <= f["start"] for o in found):
            found.append(f)
    return sorted(found, key=lambda f: f["start"])


def wrapped(lines: list[tuple]) -> list[list[tuple]]:
    """Stretches of two and more lines that follow each other without a blank one, all with bigrams of templates.

    A bigram may lie across two lines. From every line a stretch of each of the lengths 2, 3, 4, 6, 8, 12, ... begins, as
    far as the lines between its first and its last, which would lie within the licence, hold at most INNER words: that
    is a bound of the templates, and makes the stretches of a text proportional to its lines.
    """
    stretches: list[list[tuple]] = []
    run: list[tuple] = []
    for x in lines:
        tokens = x[3]
        follows = bool(run) and bool(tokens) and run[-1][0] + 1 == x[0]
        across = follows and (run[-1][3][-1], tokens[0]) in _BIGRAMS
        if not across and not any(b in _BIGRAMS for b in zip(tokens, tokens[1:], strict=False)):
            tokens = []  # ends the run
        if run and not (follows and tokens):
            stretches.append(run)
            run = []
        if x[3]:
            run.append(x)
    stretches.append(run)
    out = []
    for run in stretches:
        upto = [0, *itertools.accumulate(len(x[3]) for x in run)]
        widths = [w for e in range(1, len(run).bit_length()) for w in (2**e, 3 * 2 ** (e - 1)) if w <= len(run)]
        for k in range(len(run) - 1):
            for w in widths if k else sorted({len(run), *widths}):
                if k + w > len(run) or upto[k + w - 1] - upto[k + 1] > INNER:
                    break
                out.append(run[k : k + w])
    return out


def confirmed(stretches: list[list[tuple]], model: Classifier) -> list[dict]:
    """Those of `stretches` of lines (number, start, stop, words) that are a licence's."""
    found, listed, rows, ids = [], [], [], model.ids
    for lines in stretches:
        tokens = [w for x in lines for w in x[3]]
        if sum(b in _BIGRAMS for b in zip(tokens, tokens[1:], strict=False)) >= _LEAST:
            listed.append((lines[0][0], lines[0][1], lines[-1][2], tokens))
            rows.append(sorted({ids[g] for g in grams(tokens) if g in ids}))
    if not rows:
        return []
    for (k, start, stop, tokens), p in zip(listed, model.probabilities(rows), strict=True):
        c = int(p.argmax())
        if c and p[c] >= SURE:
            overlap = template_overlap(tokens, model.classes[c])
            if overlap >= CONFIRM:
                found.append({"family": model.classes[c], "probability": float(p[c]), "overlap": overlap, "paragraph": k, "start": start, "stop": stop})
    return found


def licences(docs: DataFrame) -> DataFrame:
    """All columns of `docs` with `licences`: the licence paragraphs of each whole text.

    Paragraphs are lines, or lines that follow each other where none of them is one by itself. The classifier is fitted on
    the driver to a bounded set of labelled paragraphs, made from the templates here with a fixed seed, and broadcast (some
    thousand n-grams). A family counts if its calibrated
    probability is SURE or more, above unknown's, and a template of it confirms: CONFIRM of the bigrams in common.

    Null and empty texts hold none. Repeated rows are scanned alike. A column of `docs` named licences is replaced. Empty
    input: empty result. There is no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit())
    rest = docs.drop("licences")
    names, kinds = rest.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, model.value) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _FOUND)], [*names, "licences"])

    return rest.mapInArrow(run, f"{kinds}, licences {FOUND}")
