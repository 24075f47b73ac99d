"""Licence statements in paragraphs.

A logistic regression over word n-grams names the licence family of a paragraph, or none.  It is trained on the
notices below, varied, against paragraphs drawn from the corpus.  Its chances are calibrated on paragraphs held
out from training, and a family counts as confirmed when the paragraph also holds most of one of its notices.

Paragraphs of the corpus that speak of licences teach nothing, however many they are: neither are they plain, nor
do their words count as ordinary ones.  A paragraph can announce several licences.

A paragraph is a line.  Most lines hold none of the n-grams that speak for a family; for those every family's
score is its negative bias, so they have no licence, and the search for such n-grams is all they cost.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How the licences are usually announced.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT license.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
    ),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."),
}
# Sentences with the same words that announce nothing.
DECOYS = (
    "The license plate was registered under the version of the form.",
    "He was released under bail by the general public.",
    "A driver must carry a valid license at all times.",
    "This version of the work is free of charge.",
    "The apache helicopter was released in 1986.",
    "Students at MIT released the software.",
    "All rights of way are reserved for cyclists.",
    "The terms of the contract are subject to change.",
    "The public license office is open to any person.",
    "Creative work is under common attribution.",
)
# Words that make a paragraph of the corpus unfit as an example without licence.
LICENCE_WORDS = frozenset(
    b"license licenses licensed licence licences licenced licensing licencing sublicense copyright copyrighted copyleft "
    b"redistribute redistribution noncommercial sharealike trademark warranty patent".split()
)
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


@dataclass(frozen=True)
class LicenceParams:
    """``sample_rows`` bounds the paragraphs drawn from the corpus for training, at most one from each document."""

    sample_rows: int = 4000
    variants: int = 150  # of each family's notices
    n_grams: int = 3
    steps: int = 300
    rate: float = 0.2
    shrink: float = 2e-4
    min_similarity: float = 0.6


def tokens_of(data: bytes) -> list[bytes]:
    return data.translate(PLAIN).split()


def grams_of(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)}


class LicenceModel:
    """Sparse weights over n-grams; a paragraph without licence has the score 0."""

    def __init__(self, p: LicenceParams):
        self.p, self.families = p, sorted(NOTICES)
        self.notices = {f: [set(zip(w, w[1:])) for n in NOTICES[f] if (w := tokens_of(n.encode()))] for f in self.families}
        self.index: dict[bytes, int] = {}
        self.weights = np.zeros((0, len(self.families)))
        self.bias = np.full(len(self.families), -3.0)
        self.temperature, self.anchors = 1.0, frozenset()
        # licences of one kind differ by a number or a suffix; words that only one kind uses name it
        self.kind = {f: f.split("-")[0] for f in self.families}
        used = {k: {t for f in self.families if self.kind[f] == k for n in NOTICES[f] for t in tokens_of(n.encode())} for k in set(self.kind.values())}
        self.naming = {k: w - set().union(*(o for j, o in used.items() if j != k)) for k, w in used.items()}

    def varied(self, plain: list[list[bytes]]) -> list[tuple[list[bytes], int]]:
        """Notices with words left out, and with words of the corpus before and behind."""
        rng, out = np.random.default_rng(13), []
        for y, family in enumerate(self.families):
            for v in range(self.p.variants):
                words = tokens_of(NOTICES[family][v % len(NOTICES[family])].encode())
                if v >= len(NOTICES[family]):
                    if len(words) > 8:
                        words = [w for w in words if rng.random() > 0.08]
                    for front in (True, False):
                        if plain and rng.random() < 0.4:
                            near = plain[rng.integers(len(plain))][: rng.integers(1, 12)]
                            words = near + words if front else words + near
                out.append((words, y))
        return out

    def fit(self, plain: list[list[bytes]]) -> None:
        """``plain``: token lists of corpus paragraphs; those that speak of licences teach nothing."""
        corpus = [w for w in plain if LICENCE_WORDS.isdisjoint(w) and not self.near_notice(w)]
        plain = corpus + [tokens_of(d.encode()) for d in DECOYS] * 20
        rows = self.varied(plain) + [(w, -1) for w in plain]
        order = np.random.default_rng(17).permutation(len(rows))
        rows = [rows[i] for i in order]
        held = len(rows) // 5
        positive = set().union(*(grams_of(tokens_of(n.encode()), self.p.n_grams) for v in NOTICES.values() for n in v))
        self.index = {g: i for i, g in enumerate(sorted(positive))}
        cells = [np.array(sorted(self.index[g] for g in grams_of(w, self.p.n_grams) if g in self.index), np.int64) for w, _ in rows]
        y = np.array([c for _, c in rows])
        x = np.zeros((len(rows), len(self.index)))
        for i, c in enumerate(cells):
            x[i, c] = 1 / np.sqrt(max(1, len(c)))
        k = len(self.families)
        wanted = np.zeros((len(rows), k + 1))
        wanted[np.arange(len(rows)), np.where(y < 0, k, y)] = 1
        self.weights = np.zeros((len(self.index), k))
        train = slice(held, None)
        power, power_bias = np.full(self.weights.shape, 1e-8), np.full(k, 1e-8)
        for _ in range(self.p.steps):
            g = (self.chances(x[train] @ self.weights + self.bias) - wanted[train])[:, :k] / (len(rows) - held)
            gw, gb = x[train].T @ g, g.sum(0)
            power += gw * gw
            power_bias += gb * gb
            step = self.p.rate / np.sqrt(power)
            moved = self.weights - step * gw
            self.weights = np.sign(moved) * np.maximum(np.abs(moved) - step * self.p.shrink / 10, 0)
            self.bias = np.minimum(self.bias - self.p.rate * gb / np.sqrt(power_bias), -0.1)
        # words that ordinary paragraphs use speak for no family on their own
        common: dict[bytes, int] = {}
        for w in corpus:
            for t in set(w):
                common[t] = common.get(t, 0) + 1
        # (an ordinary paragraph holds no licence word, so those always anchor)
        usual = {t for t, n in common.items() if n > 0.002 * len(corpus) + 5}
        anchors = set()
        for g, i in self.index.items():
            if (self.weights[i] > 0).any():
                rare = [t for t in g.split(b" ") if t not in usual]
                if rare:
                    anchors.add(min(rare, key=lambda t: (common.get(t, 0), t)))
                else:
                    self.weights[i] = np.minimum(self.weights[i], 0)
        self.anchors = frozenset(anchors)
        # calibration: the temperature with the smallest loss on the paragraphs held out
        z, target = x[:held] @ self.weights + self.bias, wanted[:held]
        loss = {t: -np.log((self.chances(z / t) * target).sum(1) + 1e-12).mean() for t in np.geomspace(0.1, 4, 40)}
        self.temperature = float(min(loss, key=loss.get)) if held else 1.0

    @staticmethod
    def chances(z: np.ndarray) -> np.ndarray:
        z = np.hstack([z, np.zeros((len(z), 1))])
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def near_notice(self, words: list[bytes]) -> bool:
        """Whether the paragraph holds half of the word pairs of a notice."""
        pairs = set(zip(words, words[1:]))
        return any(2 * len(n & pairs) >= len(n) for v in self.notices.values() for n in v)

    def strongest(self, words: list[bytes], found: set[str]) -> tuple[str, float] | None:
        """The family that a window speaks for, other than those of kinds found already, unless it speaks for none."""
        cells = [self.index[g] for g in grams_of(words, self.p.n_grams) if g in self.index]
        if not cells:
            return None
        z = self.weights[cells].sum(0) / np.sqrt(len(cells)) + self.bias
        z[[self.kind[f] in found for f in self.families]] = -np.inf
        p = self.chances(z[None] / self.temperature)[0]
        y = int(p.argmax())
        return (self.families[y], float(p[y])) if y < len(self.families) else None

    def families_in(self, words: list[bytes]) -> list[tuple[str, float, float]]:
        """``(family, chance, similarity)`` of a paragraph, the likeliest first.

        A long one is looked at in windows, so that other words don't thin a notice out.  In a window with a family the words
        that name its kind are taken out, and what is left is asked for the other kinds.  Beside the likeliest family of all, one of each
        other kind counts if a word names it and its notice confirms it.
        """
        first, others = None, {}
        for a in range(0, max(1, len(words) - 15), 15):
            part, kinds = words[a : a + 30], set()
            while (found := self.strongest(part, kinds)) is not None:
                kind = self.kind[found[0]]
                if not kinds and (first is None or found[1] > first[1]):
                    first = found
                if not self.naming[kind].isdisjoint(part) and (kind not in others or found[1] > others[kind][1]):
                    others[kind] = found
                kinds.add(kind)
                part = [w for w in part if w not in self.naming[kind]]
        if first is None:
            return []
        more = [(f, c, s) for k, (f, c) in others.items() if k != self.kind[first[0]] and (s := self.similarity(words, f)) >= self.p.min_similarity]
        return [(*first, self.similarity(words, first[0]))] + sorted(more, key=lambda x: (-x[1], x[0]))

    def similarity(self, words: list[bytes], family: str) -> float:
        """The largest share of a notice's word pairs that the paragraph holds."""
        pairs = set(zip(words, words[1:]))
        return max(len(n & pairs) / len(n) for n in self.notices[family])

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str, float, float]]]:
        """Number of paragraphs with a word, and ``(place, family, chance, similarity)`` of those with a licence."""
        if not text:
            return 0, []
        data = text.encode()
        lines = data.split(b"\n")
        n = sum(1 for x in lines if x and not x.isspace())
        if self.anchors.isdisjoint(data.translate(PLAIN).split()):
            return n, []
        found = []
        for place, line in enumerate(lines):
            words = tokens_of(line)
            if self.anchors.isdisjoint(words):
                continue
            found += [(place, *x) for x in self.families_in(words)]
        return n, found


def fit(docs: DataFrame, p: LicenceParams = LicenceParams()) -> LicenceModel:
    """Train with one paragraph from each of about ``sample_rows`` documents of ``(doc_id, text)``, chosen by hashes."""
    n = max(1, docs.count())
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, p.sample_rows / n))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    picked = docs.where(draw & F.col("text").isNotNull()).select("doc_id", lines.alias("lines"))
    one = F.get("lines", F.pmod(F.xxhash64("doc_id", F.lit("line")), F.greatest(F.size("lines"), F.lit(1))).cast("int"))
    rows = picked.select("doc_id", one.alias("line")).where("line IS NOT NULL").limit(2 * p.sample_rows).toPandas().sort_values(["doc_id", "line"])
    model = LicenceModel(p)
    model.fit([w for t in rows["line"] if (w := tokens_of(t.encode()))])
    return model


FOUND = "array<struct<paragraph:int,family:string,chance:double,similarity:double,confirmed:boolean>>"


def scan(docs: DataFrame, model: LicenceModel, text: str = "text") -> DataFrame:
    """``docs`` with ``n_paragraphs`` and ``licences``: place, family, chance, similarity and confirmation of each licence of each paragraph.

    The place is that of the line, from 0.  Null and empty texts have no paragraph.  Ties between families go to the name that
    sorts first.  Columns of the two names are replaced.
    """
    least = model.p.min_similarity

    @F.pandas_udf(f"n_paragraphs bigint, licences {FOUND}")
    def look(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = [model.scan(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame({
                "n_paragraphs": [n for n, _ in rows],
                "licences": [[{"paragraph": a, "family": f, "chance": c, "similarity": s, "confirmed": s >= least} for a, f, c, s in found] for _, found in rows],
            })

    kept = [c for c in docs.columns if c not in ("n_paragraphs", "licences")]
    return docs.select(*kept, look(F.col(text)).alias("_found")).select(*kept, "_found.*")


# workers get this module's functions with the task, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
