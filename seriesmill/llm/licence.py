"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import least_hashes, text_or_empty

SAMPLE = 2_000  # unlabelled documents whose paragraphs are learned as unknown, at most
ORDER = 3  # words of the longest n-gram
AGREE = 0.6  # share of a template that one run of a paragraph's words must have to confirm a prediction

#: Wordings by which licences are commonly granted, of each family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["This work is licensed under the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}

#: Words about rights that name no family above; they are learned as unknown.
OTHERS = ["Released under a custom license.", "See the license file for details.", "Licensed under the terms of the agreement.", "This license is subject to change.", "The public may read this work free of charge.", "Version 2.0 of the software is released.", "You may not use this file.", "the general public license debate", "permission is granted by the author", "copyright law and its history"]

#: Licences that are no family above; they are learned as unknown, half of them to fit and half to calibrate.
UNLISTED = [("ISC License", "ISC"), ("zlib License", "Zlib"), ("Artistic License 2.0", "Artistic-2.0"), ("Boost Software License 1.0", "BSL-1.0"), ("European Union Public Licence 1.2", "EUPL-1.2"), ("Academic Free License 3.0", "AFL-3.0"), ("Microsoft Public License", "MS-PL"), ("Common Development and Distribution License 1.1", "CDDL-1.1"), ("SIL Open Font License 1.1", "OFL-1.1"), ("PostgreSQL License", "PostgreSQL"), ("Python Software Foundation License 2.0", "PSF-2.0"), ("Business Source License 1.1", "BUSL-1.1")]

#: Words that name a family; a wording without them, or with others in their place, names none.
NAMING = {"mit", "apache", "gpl", "gnu", "general", "lesser", "lgpl", "affero", "agpl", "bsd", "clause", "mozilla", "mpl", "cc", "by", "sa", "nc", "cc0", "creative", "commons", "attribution", "sharealike", "noncommercial", "1", "2", "3", "4"}
INVENTED = ["acme", "orion", "zephyr", "north", "tulip", "seven"]

#: Contexts of wordings in texts; every other one is kept from the fit and calibrates.
CONTEXTS = ["{}", "# {}", "© 2021 The Authors. {}", "{} See the file for details.", "Copyright (c) 2019 Example Ltd. {}", "This file is part of the project. {}", "{} Contributions are welcome.", "Notice: {}"]

UNKNOWN = "unknown"
PATTERNS = 20_000  # distinct background paragraphs, as the model sees them, that are learned from at most
SHORT = 6  # a run of fewer words confirms only as a whole sentence

#: Whatever is neither a letter nor a digit of ASCII parts words; other bytes are letters.
_PARTS = bytes.maketrans(bytes(range(65, 91)) + bytes(b for b in range(128) if not chr(b).isalnum()), bytes(range(97, 123)) + b" " * sum(not chr(b).isalnum() for b in range(128)))
_COMMENT = re.compile(rb"^(?:#+|/\*+|\*+/?|//+|;+|--+|<!--)\s*|\s*(?:\*+/|-->)$")
_MARKS = frozenset(b"%c" % c for c in b"#/*;-<>")
_ENDS = (b".", b"!", b"?", b":", b";")
_SENTENCES = [re.compile(rb"[.!?;]+(?:\s+|$)"), re.compile(rb"[.!?;:]+(?:\s+|$)")]


def grams(words: list[bytes], order: int = ORDER) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)}


def tokens(paragraph: bytes) -> list[bytes]:
    return paragraph.translate(_PARTS).split()


def paragraphs(text: bytes) -> list[bytes]:
    """The paragraphs of a text: lines between blank ones, without comment marks, joined where a line does not end a sentence."""
    out, held = [], []
    for line in text.split(b"\n"):
        line = line.strip()
        if line[:1] in _MARKS or line[-1:] in _MARKS:
            line = _COMMENT.sub(b"", line)
        if line:
            held.append(line)
        if held and (not line or line.endswith(_ENDS)):
            out.append(b" ".join(held))
            held = []
    return [*out, b" ".join(held)] if held or not out else out


class Template:
    """A wording to compare with: its words, and those of its n-grams that no other family's wording has."""

    def __init__(self, family: str, words: list[bytes], others: set[bytes]):
        self.family, self.words, self.own = family, words, grams(words) - others

    def agreement(self, words: list[bytes]) -> tuple[float, list[bytes]]:
        """(share of the template in the longest run of words that both have, that run)."""
        places: dict[bytes, list[int]] = {}
        for j, w in enumerate(self.words):
            places.setdefault(w, []).append(j)
        best, end, before = 0, 0, {}
        for i, w in enumerate(words):
            now = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
            for n in now.values():
                if n > best:
                    best, end = n, i + 1
            before = now
        return best / len(self.words), words[end - best : end]

    def confirms(self, paragraph: bytes, words: list[bytes]) -> tuple[bool, float]:
        """Whether the longest run is the template, or AGREE of it and holds what sets its family apart; a short one must be a sentence or the paragraph."""
        share, run = self.agreement(words)
        sure = share == 1 or share >= AGREE and not self.own.isdisjoint(grams(run))
        if sure and len(run) < SHORT:
            sure = words == run or any(tokens(x) == run for cut in _SENTENCES for x in cut.split(paragraph))
        return sure, share


def templates() -> list[Template]:
    held = {f: [tokens(t.encode()) for t in lines] for f, lines in TEMPLATES.items()}
    return [Template(f, w, set().union(*(grams(x) for g, rest in held.items() if g != f for x in rest))) for f, lines in held.items() for w in lines]


@dataclass
class Model:
    """Softmax weights of n-grams, a bias and temperature, and the templates."""

    families: list[str]
    index: dict[bytes, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[Template]

    def __post_init__(self):
        split = [tuple(g.split(b" ")) for g in self.index]
        self.known = [{g if n > 1 else g[0]: self.index[b" ".join(g)] for g in split if len(g) == n} for n in range(1, ORDER + 1)]
        self.seen: dict[tuple[int, ...], np.ndarray] = {}

    def pattern(self, words: list[bytes]) -> tuple[int, ...]:
        """The numbers of the model's n-grams in a paragraph."""
        found: list[int] = []
        for n, known in enumerate(self.known):
            held = known.keys() & set(zip(*(words[i:] for i in range(n + 1))) if n else words)
            if not held:
                break  # an n-gram of the model has its parts in the model
            found += map(known.__getitem__, held)
        return tuple(sorted(found))

    def confirmable(self, words: list[bytes], pattern: tuple[int, ...]) -> list[Template]:
        """The templates that may confirm: some n-gram of their own is there, or all their words."""
        held, there = set(pattern), set(words)
        return [t for t in self.templates if any(self.index[g] in held for g in t.own) or there.issuperset(t.words)]

    def probabilities(self, pattern: tuple[int, ...]) -> np.ndarray:
        found = self.seen.get(pattern)
        if found is None:
            z = (self.bias + self.weights[list(pattern)].sum(axis=0)) / self.temperature
            e = np.exp(z - z.max())
            found = e / e.sum()
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[pattern] = found
        return found

    def identify(self, paragraph: bytes) -> tuple[str, float, bool, float]:
        """(family, probability, confirmed, agreement) of a paragraph.

        A paragraph without any word that the model weighs is unknown by the
        bias alone. Agreement is the largest share of a template of the family
        that one run of the paragraph's words has.
        """
        words = tokens(paragraph)
        p = self.probabilities(self.pattern(words))
        best = int(np.argmax(p))
        family = self.families[best]
        if best == 0:
            return family, float(p[0]), False, 0.0
        found = [t.confirms(paragraph, words) for t in self.templates if t.family == family]
        return family, float(p[best]), any(sure for sure, _ in found), max(share for _, share in found)


def _parts(line: str) -> list[str]:
    """A wording, and halves and three quarters of a long one, as found in texts that cut it."""
    words, out = line.split(), [line]
    for share in (0.5, 0.75):
        n = int(len(words) * share)
        if n >= 10:
            out += [" ".join(words[:n]), " ".join(words[-n:])]
    return out


def _renamed(line: str) -> list[str]:
    """A short wording with other names where it names its family."""
    words = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9]+", line)
    if len(line.split()) > 16 or not any(w.lower() in NAMING for w in words):
        return []
    return ["".join(INVENTED[(i + k) % len(INVENTED)] if w.lower() in NAMING else w for i, w in enumerate(words)) for k in range(2)]


def examples() -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
    """Paragraphs and the numbers of their families (0: unknown), to fit and to calibrate; no paragraph is in both."""
    parts: tuple[list, list] = ([], [])
    for number, lines in enumerate(TEMPLATES.values(), 1):
        for line in lines:
            for i, context in enumerate(CONTEXTS):
                for part in _parts(line):
                    parts[i % 2].append((context.format(part), number))
                parts[i % 2].append((context.format(line).upper(), number))
                for other in _renamed(line):
                    parts[i % 2].append((context.format(other), 0))
    for i, context in enumerate(CONTEXTS):
        parts[i % 2].extend((context.format(x), 0) for x in OTHERS)
        for j, (name, short) in enumerate(UNLISTED):
            for frame in (f"Licensed under the {name}.", f"Released under the {name}.", f"This work is licensed under the {name}.", f"SPDX-License-Identifier: {short}"):
                parts[j % 2].append((context.format(frame), 0))
    for i, word in enumerate(sorted(NAMING)):  # a naming word alone names nothing
        for j, frame in enumerate(("{}", "they spoke of {} there", "zu {} und zurück", "{} is what it was")):
            parts[(i + j) % 2].append((frame.format(word), 0))
    fit, rest = ([(x.encode(), y) for x, y in dict.fromkeys(p)] for p in parts)
    seen = {x for x, _ in fit}
    return fit, [(x, y) for x, y in rest if x not in seen]


def _vocabulary() -> dict[bytes, int]:
    return {g: i for i, g in enumerate(sorted(set().union(*(grams(t.words) for t in templates()))))}


def fit(background: list[tuple[list[int], int]], steps: int = 200) -> Model:
    """Fits families against ``background`` and what else names no family as the unknown class.

    ``background`` are (n-gram numbers, times seen) of paragraphs. Multinomial
    logistic regression over n-grams of the wordings, all rows each step and
    each family of equal weight. Every other background row, the contexts and
    the unlisted licences kept from the fit choose the temperature, by their
    likelihood.
    """
    families, index, compared = [UNKNOWN, *TEMPLATES], _vocabulary(), templates()
    model = Model(families, index, np.zeros((len(index), len(families))), np.zeros(len(families)), 1.0, compared)
    to_fit, to_hold = ([(model.pattern(tokens(x)), y, 1) for x, y in rows] for rows in examples())
    to_fit += [(p, 0, n) for p, n in background[::2]]
    to_hold += [(p, 0, n) for p, n in background[1::2]]

    def matrix(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(index)), dtype=np.float32)
        for i, (pattern, _, _) in enumerate(rows):
            x[i, list(pattern)] = 1
        y, count = np.array([y for _, y, _ in rows]), np.array([n for _, _, n in rows], dtype=float)
        weight = np.sqrt(count)  # frequent patterns count more, but do not drown the others
        for k in range(len(families)):
            weight[y == k] /= max(weight[y == k].sum(), 1e-12)
        return x, y, weight / weight.sum()

    x, y, weight = matrix(to_fit)
    target, w, b = np.eye(len(families), dtype=np.float32)[y], model.weights, model.bias
    for _ in range(steps):
        z = x @ w.astype(np.float32) + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - target) * weight[:, None]
        w -= 8 * (x.T @ g + 1e-5 * w)
        b -= 8 * g.sum(axis=0)
    hx, hy, hw = matrix(to_hold)
    hz = hx @ w + b

    def loss(t: float) -> float:
        z = hz / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(hw * (z[np.arange(len(hy)), hy] - np.log(np.exp(z).sum(axis=1)))).sum())

    model.temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    return model


def train(docs: DataFrame, sample: int = SAMPLE, patterns: int = PATTERNS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns the unknown class from paragraphs of at most ``sample`` documents, those of smallest hash of the id.

    Paragraphs become the n-grams of the model that they hold on the executors;
    the driver gets at most ``patterns`` distinct ones, those of smallest hash,
    with their numbers. Paragraphs that a template confirms are left out.
    """
    model = Model([UNKNOWN], _vocabulary(), np.zeros((0, 1)), np.zeros(1), 1.0, templates())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("body"))
    chosen = least_hashes(rows.select("doc_id", F.xxhash64("body").alias("what")), "doc_id", sample, "doc_id", "what").distinct()
    body = rows.withColumn("what", F.xxhash64("body"))
    picked = body.join(F.broadcast(chosen), (body.doc_id.eqNullSafe(chosen.doc_id)) & (body.what == chosen.what), "left_semi").select("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(0):
                for p in paragraphs(x.as_py()):
                    words = tokens(p)
                    pattern = model.pattern(words)
                    if not any(t.confirms(p, words)[0] for t in model.confirmable(words, pattern)):
                        out.append(pattern)
            yield pa.record_batch([pa.array(out, pa.list_(pa.int32()))], names=["pattern"])

    counts = picked.mapInArrow(run, "pattern array<int>").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    found = counts.orderBy(F.xxhash64("pattern"), "pattern").limit(patterns).collect()
    return fit([(list(r.pattern), r.n) for r in found])


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_paragraphs, findings (array of paragraph, family, probability, confirmed, agreement).

    Paragraphs of the whole text are numbered from 0: lines between blank ones,
    without comment marks, joined where a line does not end a sentence, so that
    wrapped notices are read whole. Findings are those of a family other than
    unknown, in order; one is confirmed if a run of its words is AGREE of a
    template of the family and holds what sets that family apart. Null and empty
    texts have one empty paragraph and no finding. Repeated rows and null ids
    stay; an empty table gives an empty table; other columns are not read.
    """
    one = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_()), ("agreement", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found = [], []
            for x in b.column(1):
                parts = paragraphs(x.as_py())
                named = ((i, *model.identify(p)) for i, p in enumerate(parts))
                counts.append(len(parts))
                found.append([dict(zip(("paragraph", "family", "probability", "confirmed", "agreement"), n, strict=True)) for n in named if n[1] != UNKNOWN])
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(one))], names=["doc_id", "n_paragraphs", "findings"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_paragraphs long, findings array<struct<paragraph: long, family: string, probability: double, confirmed: boolean, agreement: double>>")
