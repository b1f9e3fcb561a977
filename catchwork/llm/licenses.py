"""Licence families of paragraphs: a trained sparse n-gram classifier whose predictions a template must confirm."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.llm.words import slices, texts

# Short notices by which works state their licence, by family. They are training seeds and confirmation templates.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the AGPL version 3.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Distributed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the 2-clause BSD license.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 1.0."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL version 2 or any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "isc": ("Licensed under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL version 3 or later."),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This software is licensed under the terms of the MIT license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "mpl-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "proprietary": ("Copyright. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.", "Licensed under the zlib license."),
}
# Words by which a notice of a family states its variant, the first that fits.
VARIANTS: dict[str, tuple[tuple[str, str], ...]] = {
    "agpl": ((r"\b(?:version|v) ?3\b|agplv?3", "agpl-3.0"),),
    "bsd": ((r"\b3 clause\b|neither the name of", "bsd-3-clause"), (r"\b2 clause\b|simplified bsd", "bsd-2-clause")),
    "cc-by": ((r"\b4 0\b", "cc-by-4.0"), (r"\b3 0\b", "cc-by-3.0")),
    "cc-by-nc": ((r"\b4 0\b", "cc-by-nc-4.0"), (r"\b3 0\b", "cc-by-nc-3.0")),
    "cc-by-sa": ((r"\b4 0\b", "cc-by-sa-4.0"), (r"\b3 0\b", "cc-by-sa-3.0")),
    "epl": ((r"\b2 0\b", "epl-2.0"), (r"\b1 0\b", "epl-1.0")),
    "gpl": ((r"\b(?:version|v) ?3\b|gplv?3", "gpl-3.0"), (r"\b(?:version|v) ?2\b|gplv?2", "gpl-2.0")),
    "lgpl": ((r"\b(?:version|v) ?3\b|lgplv?3", "lgpl-3.0"), (r"\b(?:version|v) ?2 1\b|lgplv?2", "lgpl-2.1")),
}
# Sentences that use the same words and state no licence.
OTHERS = (
    "His driving license was renewed by the office in May.",
    "The version 2.0 of the report was released under pressure.",
    "You need a fishing license to use this lake, with or without a boat.",
    "The public library is open to any person free of charge.",
    "Students at MIT released the results in version 3 of the paper.",
    "The general public may copy and use this map.",
    "Apache helicopters flew over the valley.",
    "Mozilla is the source of this form.",
    "The terms of the agreement are subject to change.",
    "All rights of the workers are reserved by law.",
    "The restaurant lost its license to sell wine.",
    "This work is done under the guidance of the foundation.",
)
STATES = re.compile(rb"licen|copyright|gpl|apache|creative commons|public domain|mozilla|rights reserved|redistribut|permission")  # spans with these are no negatives
FAMILIES = tuple(TEMPLATES)
SPAN, STRIDE = 48, 24  # a paragraph longer than SPAN words is read in overlapping spans
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b in b"\n+" else 32 for b in range(256))


def paragraphs(text: bytes) -> list[list[bytes]]:
    """Words of each line that has any: A-Z lower-cased, other ASCII signs as white space."""
    return [w for line in text.translate(_TABLE).split(b"\n") if (w := line.split())]


_MARKS = re.compile(rb"^[ \t\r]*(?:(?://+!?|/\*+|\*+/?|#+|;+|--+|%+|<!--|(?i:rem|dnl)(?=[ \t]))[ \t\r]*)+|[ \t\r]*(?:\*+/|-->)[ \t\r]*$", re.MULTILINE)


def blocks(text: bytes) -> list[list[tuple[int, list[bytes]]]]:
    """Runs of two or more lines up to one without a word, comment marks dropped: (number of the line among paragraphs(text), words) of each."""
    out: list[list[tuple[int, list[bytes]]]] = [[]]
    n = 0
    for whole, line in zip(text.translate(_TABLE).split(b"\n"), text.split(b"\n"), strict=True):
        if not whole.split():
            out.append([])
            continue
        if w := _MARKS.sub(b"", line).translate(_TABLE).split():
            out[-1].append((n, w))
        n += 1
    return [b for b in out if len(b) > 1]


def variant(family: str, words: list[bytes]) -> str:
    """The family's variant that the words state, else the family."""
    text = b" ".join(words).decode(errors="replace")
    return next((name for rule, name in VARIANTS.get(family, ()) if re.search(rule, text)), family)


def _pairs(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False)) or {(w, b"") for w in words}


class Model(NamedTuple):
    """words: numbers of the vocabulary; codes and rows: its word pairs (sorted) and their weight rows; the last class is unknown."""

    words: dict[bytes, int]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float
    report: dict


class _Features:
    """Sparse counts of vocabulary words and word pairs for spans of words."""

    def __init__(self, words: dict[bytes, int], codes: np.ndarray) -> None:
        self.words, self.codes, self.n = words, codes, len(words)

    def __call__(self, spans: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(span number, feature number) of every hit."""
        sizes = np.array([len(s) for s in spans], dtype=np.int64)
        get = self.words.get
        ids = np.fromiter((get(w, -1) for s in spans for w in s), dtype=np.int64, count=int(sizes.sum()))
        of = np.repeat(np.arange(len(spans)), sizes)
        one = np.flatnonzero(ids >= 0)
        a, b = ids[:-1], ids[1:]
        two = np.flatnonzero((a >= 0) & (b >= 0) & (of[:-1] == of[1:]))
        code = a[two] * self.n + b[two]
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), dtype=bool)
        return np.concatenate([of[one], of[two[known]]]), np.concatenate([ids[one], self.n + at[known]])


def _spans(words: list[bytes]) -> list[list[bytes]]:
    return [words] if len(words) <= SPAN else [words[i : i + SPAN] for i in range(0, len(words) - STRIDE, STRIDE)]


def _wrapped(block: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first line, last line, words) of overlapping spans over the joined lines of a block that reach over a line's end."""
    words = [w for _, line in block for w in line]
    line = [i for i, own in block for _ in own]
    for a in range(0, max(1, len(words) - STRIDE), STRIDE):
        z = min(len(words), a + SPAN) - 1
        if line[a] != line[z]:
            yield line[a], line[z], words[a : z + 1]


def _variants(words: list[bytes], filler: list[bytes], r: np.random.Generator, n: int) -> Iterator[list[bytes]]:
    """The words themselves, then copies with words dropped, the ends cut or foreign words around."""
    yield words
    for _ in range(n - 1):
        size = max(min(3, len(words)), int(len(words) * r.uniform(0.75, 1.0)))
        at = int(r.integers(0, len(words) - size + 1))
        part = [w for w in words[at : at + size] if r.random() > 0.06] or words
        before, after = (int(x) for x in r.integers(0, 9, 2) * (r.random() < 0.5))
        yield [filler[i] for i in r.integers(0, len(filler), before)] + part + [filler[i] for i in r.integers(0, len(filler), after)]


def negative_spans(docs: DataFrame, sample: int, most: int, longest: int, seed: int) -> list[list[bytes]]:
    """At most `most` spans of words, none over `longest` bytes, without a licence word, of the `sample` documents whose ids have the least hash. Equal ids count once, with their least text."""
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").distinct().withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id").limit(sample)
    picked = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # `sample` rows bound the broadcast
    picked = picked.groupBy("doc_id", "h").agg(F.min("text").alias("text")).select("h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), texts(batch, "text"), strict=True):
                spans = [b" ".join(s) for p in paragraphs(text) for s in _spans(p)]
                spans = [s.decode(errors="replace") for s in spans if len(s) <= longest and not STATES.search(s)]
                if spans:
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(spans)), pa.array(range(len(spans)), pa.int32()), pa.array(spans, pa.string())], names=["h", "i", "span"])

    spans = picked.mapInArrow(run, "h long, i int, span string").withColumn("o", F.xxhash64("h", "i"))
    return [r.span.encode().split() for r in spans.orderBy("o", "h", "i").limit(most).collect()]  # most * longest bytes


def _features(rows: list[tuple[list[bytes], int]]) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of the words, and codes of the word pairs, that stand in 5 or more of the rows."""
    seen: Counter[bytes] = Counter()
    pairs: Counter[tuple[bytes, bytes]] = Counter()
    for w, _ in rows:
        seen.update(set(w))
        pairs.update(set(zip(w, w[1:], strict=False)))
    words = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= 5))}
    return words, np.array(sorted(words[a] * len(words) + words[b] for (a, b), n in pairs.items() if n >= 5), dtype=np.int64)


def _regression(row: np.ndarray, at: np.ndarray, y: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression on sparse rows; each class counts alike."""
    n, classes = len(y), len(FAMILIES) + 1
    target = np.eye(classes)[y]
    cost = 1.0 / np.bincount(y, minlength=classes).clip(1)[y]
    cost /= cost.sum()
    w, bias = np.zeros((size, classes)), np.zeros(classes)
    m, v = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    for i in range(1, rounds + 1):
        z = _scores(row, at, w, bias, n)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        e = (p / p.sum(axis=1, keepdims=True) - target) * cost[:, None]
        g = np.stack([np.bincount(at, e[row, c], minlength=size) for c in range(classes)], axis=1) + 1e-5 * w
        g = np.vstack([g, e.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * np.sqrt(1 - 0.999**i) / (1 - 0.9**i) * m / (np.sqrt(v) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, bias


def _scores(row: np.ndarray, at: np.ndarray, w: np.ndarray, bias: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, w[at, c], minlength=n) for c in range(w.shape[1])], axis=1) + bias


def fit(docs: DataFrame, sample: int = 300, most: int = 1500, longest: int = 2000, seed: int = 13, rounds: int = 250, try_new: bool = False) -> Model:
    """Softmax regression over the families and an unknown class.

    Positives are variants of the templates. Negatives are the fixed other sentences and at most `most` spans, none over `longest`
    bytes, of the `sample` documents whose ids have the least hash, without those that hold a licence word. A fifth is held out
    from a first fit, which sets the temperature that calibrates probabilities and measures accuracy. The final weights come from
    all rows. With try_new, which costs a fit more, the report also has `new_templates`: the accuracy on the last template of each family with
    three or more, when no variant of it is in the training rows.
    """
    r = np.random.default_rng(seed)
    negatives = negative_spans(docs, sample, most, longest, seed)
    filler = sorted({w for s in negatives for w in s}) or [b"text"]
    rows: list[tuple[list[bytes], int]] = []
    fresh = []  # of the last template of a family with several
    unknown = len(FAMILIES)
    for k, family in enumerate(FAMILIES):
        for j, t in enumerate(TEMPLATES[family]):
            own = [(v, k) for v in _variants(paragraphs(t.encode())[0], filler, r, 40)]
            fresh += [j > 1 and j == len(TEMPLATES[family]) - 1] * len(own)
            rows += own
    for t in OTHERS:
        rows += [(v, unknown) for v in _variants(paragraphs(t.encode())[0], filler, r, 15)]
    rows += [(s, unknown) for s in negatives]
    new = np.array(fresh + [False] * (len(rows) - len(fresh)))
    words, codes = _features(rows)
    row, at = _Features(words, codes)([w for w, _ in rows])
    y, n, size = np.array([k for _, k in rows]), len(rows), len(words) + len(codes)

    def without(out: np.ndarray) -> np.ndarray:
        number = np.cumsum(~out) - 1
        used = ~out[row]
        return _scores(row, at, *_regression(number[row[used]], at[used], y[~out], size, rounds), n)[out]

    held = r.random(n) < 0.2
    z = without(held)
    best = None
    for heat in np.geomspace(0.25, 8, 41):
        q = z / heat
        loss = (np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1)) - (q - q.max(axis=1, keepdims=True))[np.arange(len(q)), y[held]]).mean()
        if best is None or loss < best[0]:
            best = loss, float(heat)
    guess = z.argmax(axis=1)
    report = {"rows": n, "held_out": int(held.sum()), "accuracy": float((guess == y[held]).mean()), "unknown_kept": float((guess == y[held])[y[held] == unknown].mean())}
    if try_new:
        report["new_templates"] = float((without(new).argmax(axis=1) == y[new]).mean())
    w, bias = _regression(row, at, y, size, rounds)
    w[np.abs(w) < 1e-3] = 0
    return Model(words, codes, w.astype(np.float32), bias, best[1], report)


def license_scan(docs: DataFrame, model: Model, least_probability: float = 0.6, least_similarity: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_paragraphs, n_predicted, n_confirmed, families, hits and variants.

    A paragraph is a line with a word; longer ones are read in overlapping spans of 48 words, so whole texts are scored. Lines up to a blank one
    are also read joined, comment marks dropped, in such spans, so wrapped notices count once, for the line in which
    their span begins, unless one of its lines states the family alone. A span is
    predicted as a family whose calibrated probability is at least least_probability, else it is unknown. It is confirmed if
    it holds at least least_similarity of the word pairs of one of the family's templates. hits lists confirmed
    paragraph:family pairs (paragraphs from 0), each once, and families their names, both sorted and comma-joined; variants lists the versions or clauses that confirmed spans state (bsd-3-clause, gpl-2.0), or the family. A null text is an
    empty one; ids may be null or repeat; an empty table gives an empty one. Further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary of a bounded training set
    shapes = [[_pairs(paragraphs(t.encode())[0]) for t in TEMPLATES[f]] for f in FAMILIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        features, classes = _Features(model.words, model.codes), len(FAMILIES) + 1
        for batch in batches:
            for part in slices(batch, "text"):
                raw = texts(part, "text")
                bodies = [paragraphs(t) for t in raw]
                spans, of = [], []
                for d, body in enumerate(bodies):
                    for i, p in enumerate(body):
                        own = _spans(p)
                        spans += own
                        of += [(d, i, i)] * len(own)
                    for block in blocks(raw[d]):  # after the lines, so that what a line states alone counts for it
                        for i, j, own in _wrapped(block):
                            spans.append(own)
                            of.append((d, i, j))
                predicted = [0] * len(bodies)
                found: list[set[tuple[int, str]]] = [set() for _ in bodies]
                stated: list[set[tuple[str, str]]] = [set() for _ in bodies]
                upto: dict[tuple[int, str], int] = {}  # last line of the latest wrapped notice of a family
                if spans:
                    row, at = features(spans)
                    hit = model.weights[at].any(axis=1)
                    row, at = row[hit], at[hit]
                    z = np.stack([np.bincount(row, model.weights[at, c], minlength=len(spans)) for c in range(classes)], axis=1)
                    z = (z + model.bias) / model.heat
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    top = p[:, :-1].argmax(axis=1)
                    for s in np.flatnonzero(p[np.arange(len(p)), top] >= least_probability).tolist():
                        d, i, j = of[s]
                        predicted[d] += 1
                        own = _pairs(spans[s])
                        if any(len(own & t) >= least_similarity * len(t) for t in shapes[top[s]]):
                            family = FAMILIES[top[s]]
                            stated[d].add((family, variant(family, spans[s])))
                            if i == j:
                                found[d].add((i, family))
                            elif upto.get((d, family), -1) < i and not any((x, family) in found[d] for x in range(i, j + 1)):
                                found[d].add((i, family))
                                upto[d, family] = j
                names = [",".join(sorted({f for _, f in x})) for x in found]
                hits = [",".join(f"{i}:{f}" for i, f in sorted(x)) for x in found]
                told = [{f for f, v in x if v != f} for x in stated]  # a notice that names no version says nothing beside one that does
                variants = [",".join(sorted({v for f, v in x if v != f or f not in t})) for x, t in zip(stated, told, strict=True)]
                columns = [part.column("doc_id"), pa.array([len(b) for b in bodies], pa.int64()), pa.array(predicted, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(names), pa.array(hits), pa.array(variants)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "families", "hits", "variants"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_paragraphs long, n_predicted long, n_confirmed long, families string, hits string, variants string")
